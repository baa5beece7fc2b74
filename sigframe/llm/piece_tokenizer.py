"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

A text's pieces are those with the greatest sum of scores (ties: the longer last piece). The lattice is built one character at a time. A
piece has at most `longest` characters, so only that many last positions can be extended; whenever the back pointers of all of
them lead through one boundary, what lies before is settled, its ids are given out and the window moves there. Time is proportional to a text's length.
Memory is bounded by the window from the last settled boundary; it is short in ordinary text, but grows with a run in which the paths never meet
(one character repeated, if there are pieces of two or more of it: which cut is best is only known at the end of the run), by four numbers a character.

Where no piece can span a boundary (before a run of spaces, between two characters that are neighbours in no piece), all paths meet
by construction. Texts are cut there, and the ids of up to `KNOWN` such units are remembered between texts.

Characters outside the vocabulary become byte pieces, at the score of an unknown character. Decoding joins the pieces, turns byte pieces
back into bytes, and drops the leading space that encoding adds. Every text without U+2581 comes back as it was; U+2581 is the
vocabulary's sign for a space and comes back as one.

Nulls: a null text has null ids; an empty text has none. Each input row gives one row.

The vocabulary at hand was trained by merges; this finds the best-scored pieces, not the order of merges, so ids can differ from the
library's while both decode to the same text.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.words import pieces

SPACE = "▁"
KNOWN = 500_000
FEED = 1 << 16


class Vocabulary:
    """Pieces, scores and byte pieces of a model file (its bytes)."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.encode("  aé ") and sp.decode(sp.encode("  aé\n ")) != "  aé\n ":
            raise ValueError("only models without text normalisation are supported")
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.tail = {p[k:]: -math.inf for p in self.ids for k in range(len(p))} | self.score  # all endings of pieces
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours within a piece
        self.raw = [b""] * n
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.spans_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.prefix = sp.encode("a", out_type=str)[0].startswith(SPACE) and sp.decode([self.ids[SPACE]] if SPACE in self.ids else []) == ""
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        word = rf"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")
        self.units = re.compile(".+" if self.spans_space else word, re.S)

    def unknown_ids(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """Feed text, get settled ids.

    Positions are relative to `text`, whose start is not behind `root`, the last settled boundary. Back pointers form a tree; `kids` and `sums` are the number of a position's
    live children and the sum of their positions. A position that can no longer be extended and has no children dies, and so may its parent. While
    the root has one child, the step to it is settled. Each position is added, dies and is settled once, so a text takes time in
    proportion to its length.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.v, self.text, self.best, self.back = vocab, "", [0.0], [0]
        self.kids, self.sums, self.root, self.old = [0], [0], 0, 0

    def feed(self, text: str) -> list[int]:
        out, step = [], self.v.longest * 4
        for k in range(0, len(text), step):
            start = len(self.text)
            self.text += text[k : k + step]
            self._extend(start)
            if len(self.text) > step:
                out += self._settle()
        return out

    def _extend(self, start: int) -> None:
        """Best scores and back pointers of the positions after `start`."""
        tail, unknown, line, best, back = self.v.tail.get, self.v.unknown, self.text, self.best, self.back
        for end in range(start + 1, len(line) + 1):
            at = a = end - 1
            s = tail(line[a])
            if s is None:  # no piece ends in this character
                best.append(best[a] + unknown)
                back.append(a)
                continue
            top = best[a] + (s if s > -math.inf else unknown)
            while a:
                a -= 1
                s = tail(line[a:end])
                if s is None:  # nor does a longer piece
                    break
                s += best[a]
                if s >= top:
                    top, at = s, a
            best.append(top)
            back.append(at)

    def _settle(self) -> list[int]:
        """Ids up to the boundary where all paths that can still win converge."""
        back, kids, sums = self.back, self.kids, self.sums
        for p in range(len(kids), len(back)):
            kids.append(0)
            sums.append(0)
            kids[back[p]] += 1
            sums[back[p]] += p
        live = max(0, len(self.text) - self.v.longest + 1)
        for p in range(self.old, live):
            while not kids[p] and p > self.root:
                up = back[p]
                kids[up] -= 1
                sums[up] -= p
                p = up
        self.old = max(self.old, live)
        ids: list[int] = []
        while self.root < live and kids[self.root] == 1:
            ids += self._ids(self.root, sums[self.root])
            self.root = sums[self.root]
        if self.root > len(self.text) // 2:
            self._forget(self.root)
        return ids

    def _forget(self, end: int) -> None:
        """Drop what lies before `end`, the settled boundary."""
        base = self.best[end]
        self.text = self.text[end:]
        self.best = [b - base for b in self.best[end:]]
        self.back = [max(0, b - end) for b in self.back[end:]]
        self.kids, self.sums = self.kids[end:], [s - end * k for s, k in zip(self.sums[end:], self.kids[end:])]
        self.root, self.old = 0, max(0, self.old - end)

    def _ids(self, a: int, b: int) -> list[int]:
        piece = self.text[a:b]
        i = self.v.ids.get(piece)
        return self.v.unknown_ids(piece) if i is None else [i]

    def finish(self) -> list[int]:
        cut = [len(self.text)]
        while cut[-1] > self.root:
            cut.append(self.back[cut[-1]])
        cut.reverse()
        return [i for a, b in zip(cut, cut[1:]) for i in self._ids(a, b)]


class Codec:
    """Encodes and decodes whole texts, remembering units."""

    def __init__(self, model: bytes) -> None:
        self.v = Vocabulary(model)
        self.known: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        inside, known = self.v.inside, self.known
        cut = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in inside]  # no piece spans these either
        if cut:
            raw = b"".join([known.get(x) or self._path(x) for x in map(unit.__getitem__, map(slice, [0, *cut], [*cut, len(unit)]))])
        else:
            raw = self._path(unit)
        if len(unit) <= 64:
            known[unit] = raw
        return raw

    def _path(self, unit: str) -> bytes:
        path = StreamingViterbi(self.v)
        ids = [i for k in range(0, len(unit), FEED) for i in path.feed(unit[k : k + FEED])] + path.finish()
        raw = struct.pack(f"<{len(ids)}i", *ids)
        if len(unit) <= 64:
            self.known[unit] = raw
        return raw

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        line = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        if len(self.known) > KNOWN:
            self.known.clear()
        get = self.known.get
        return np.frombuffer(b"".join([get(u) or self._unit(u) for u in self.v.units.findall(line)]), np.int32)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.v.raw.__getitem__, ids))
        text = raw.decode("utf-8", "surrogatepass")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


_made: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per worker process, kept between tasks."""
    key = zlib.crc32(model)
    if key not in _made:
        _made.clear()
        _made[key] = Codec(model)
    return _made[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, n_ids, exact (decoding the ids gives the text, U+2581 counting as a space)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in pieces(batch):
                texts = [t.as_py() for t in part.column(1)]
                ids = [c.encode(t or "") for t in texts]
                none = np.array([t is None for t in texts], bool)
                size = np.array([len(x) for x in ids], np.int64)
                exact = [c.decode(x.tolist()) == (t or "").replace(SPACE, " ") for t, x in zip(texts, ids)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids)), mask=pa.array(none))
                yield pa.record_batch([part.column(0), lists, pa.array(size, mask=none), pa.array(exact, pa.bool_(), mask=none)], ["doc_id", "ids", "n_ids", "exact"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, exact boolean")


def decode(tokens: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
