"""Substring dedup with repeated-phrase automata.

A window is `WINDOW` consecutive words of one text. A word goes if a window that covers it also starts in a text with a
smaller id. The work:

1. anchors: of the hashed `GRAM`-word phrases inside a window the smallest names the window, so equal windows have equal
   anchors, and about one anchor per 22 words is shuffled instead of every window. Anchors of two texts or more recur.
2. confirmation: texts with recurring anchors give the stretches that such windows cover; their windows are counted by
   (min id, max id), an aggregate that combines before the shuffle, also for a passage that most texts hold.
3. phrases: in the first text of each recurring window, runs of such windows with one anchor become a phrase: a core that
   all its windows contain, and the words on either side.
4. automata: texts are dealt to shards by id, and a phrase goes (once) to each shard that holds its anchor in a later text. Each
   shard compiles the cores into an Aho-Corasick automaton over words, streams all its texts through it, and compares the words of
   and around every occurrence.

Nulls: a null text has no words; a row with a null id is never changed and never the earlier text. Rows that share an id are
not earlier than one another. Texts under `WINDOW` words cannot change. Each input row gives one row. Windows are compared
by 64-bit hash until step 4, which compares words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.words import pieces, runs, sliding_min, starts_inside, text_buffers, window_hashes, word_hashes, word_spans
from sigframe.session import materialize

WINDOW, GRAM = 50, 8
SHARDS = 1  # per partition
SPAN = WINDOW - GRAM + 1  # phrases in a window


def _hashed(batch: pa.RecordBatch, text: int = 1):
    """Anchors of all windows of a piece, which windows lie inside a text, and the words' places."""
    data, off = text_buffers(batch.column(text))
    s, e, first = word_spans(data, off)
    words = word_hashes(data, s, e)
    anchor = sliding_min(window_hashes(words, GRAM), SPAN)
    return data, s, e, first, words, anchor, starts_inside(first, WINDOW, len(anchor))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            _, _, _, first, _, anchor, inside = _hashed(part)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            keep = np.ones(len(at), bool)
            keep[1:] = (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]])
            at = at[keep]
            owner, value = _distinct(np.searchsorted(first, at, "right") - 1, anchor[at])
            yield pa.record_batch([pa.array(_ids(part)[owner]), pa.array(value.view(np.int64))], ["doc_id", "anchor"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their recurring anchors -> the stretches covered by windows with such an anchor, one per line."""
    for batch in batches:
        for part in pieces(batch):
            data, s, e, first, _, anchor, inside = _hashed(part)
            ids, raw, out_id, out = _ids(part), data.tobytes(), [], []
            for i, known in enumerate(part.column(2)):
                a, b = int(first[i]), min(int(first[i + 1]) - WINDOW + 1, len(anchor))
                if b <= a:
                    continue
                hit = np.isin(anchor[a:b].view(np.int64), known.values.to_numpy(zero_copy_only=False))
                lines = [b" ".join(raw[s[a + x] : e[a + y + WINDOW - 2]].split()) for x, y in zip(*runs(hit & inside[a:b]))]
                if lines:
                    out_id.append(ids[i])
                    out.append(b"\n".join(lines).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])


def _lines(part: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row per stretch, and the row of `part` that it comes from."""
    texts = [(x or "").split("\n") for x in part.column(1).to_pylist()]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    ids = pa.array(_ids(part)[owner])
    return pa.record_batch([ids, pa.array([y for x in texts for y in x], pa.string())], ["doc_id", "text"]), owner


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            lines, _ = _lines(part)
            _, _, _, first, words, anchor, inside = _hashed(lines)
            at = np.flatnonzero(inside)
            owner = _ids(lines)[np.searchsorted(first, at, "right") - 1]
            owner, value = _distinct(owner, window_hashes(words, WINDOW)[at])
            yield pa.record_batch([pa.array(owner), pa.array(value.view(np.int64))], ["doc_id", "window"])


def _stretch_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            yield from _anchors(iter([_lines(part)[0]]))


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with the windows that first occur there -> phrases (anchor, first_doc, core, lead, phrase)."""
    names = ["anchor", "first_doc", "core", "lead", "phrase"]
    for batch in batches:
        for part in pieces(batch):
            lines, owner = _lines(part)
            data, s, e, first, words, anchor, inside = _hashed(lines)
            whole, raw, ids, rows = window_hashes(words, WINDOW).view(np.int64), data.tobytes(), _ids(lines), set()
            known = [x.values.to_numpy(zero_copy_only=False) for x in part.column(2)]
            for i in range(lines.num_rows):
                a, b = int(first[i]), min(int(first[i + 1]) - WINDOW + 1, len(anchor))
                if b <= a:
                    continue
                hit, own = np.isin(whole[a:b], known[owner[i]]) & inside[a:b], anchor[a:b]
                for x, y in zip(*runs(hit)):
                    turns = np.concatenate([[x], x + 1 + np.flatnonzero(own[x + 1 : y] != own[x : y - 1]), [y]])
                    for p, q in zip(turns, turns[1:]):
                        for u in range(p, q, SPAN):  # windows u .. v of one anchor, few enough to share a core
                            v = min(u + SPAN, q) - 1
                            core = raw[s[a + v] : e[a + u + WINDOW - 1]]
                            rows.add((int(own[u].view(np.int64)), int(ids[i]), core, int(v - u), raw[s[a + u] : e[a + v + WINDOW - 1]]))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.record_batch([c.cast(pa.string()) if pa.types.is_binary(c.type) else c for c in cols], names)


_OTHER = "\0"
_RUN = re.compile(f"[^{_OTHER}]{{{GRAM},}}")
_SIGNS = 1_000_000


class _Shard:
    """The automaton of one shard, over texts with one character per word: its own for a word of the shard's phrases (a million
    different ones; what is found is compared in full), `_OTHER` for any word else. A core has `GRAM` words or more, so only runs of
    that many phrase words go through the automaton."""

    def __init__(self) -> None:
        self.sign: dict[bytes, str] = {}
        self.phrases: dict[str, list[tuple[int, int, list[bytes]]]] = {}
        self.automaton = None

    def add(self, first_doc: int, core: str, lead: int, phrase: str) -> None:
        words = phrase.encode().split()
        for w in words:
            if w not in self.sign:
                n = 1 + len(self.sign) % _SIGNS
                self.sign[w] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        key = "".join(self.sign[w] for w in core.encode().split())
        self.phrases.setdefault(key, []).append((first_doc, lead, words))

    def _occurrences(self, words: list[bytes]) -> Iterator[tuple[int, str]]:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for key in self.phrases:
                self.automaton.add_word(key, key)
            self.automaton.make_automaton()
        for run in _RUN.finditer("".join(map(self.sign.get, words, repeat(_OTHER)))):
            for end, key in self.automaton.iter(run[0]):
                yield run.start() + end + 1 - len(key), key

    def covered(self, doc_id: int | None, words: list[bytes]) -> np.ndarray | None:
        """Which words a window of an earlier text covers; None if none."""
        if doc_id is None or len(words) < WINDOW or not self.phrases:
            return None
        out = None
        for start, key in self._occurrences(words):
            stop = start + len(key)
            for first_doc, lead, phrase in self.phrases[key]:
                if first_doc >= doc_id or words[start:stop] != phrase[lead : lead + len(key)]:
                    continue
                a, b = max(start - lead, 0), min(start - lead + len(phrase), len(words))
                if out is not None and out[a:b].all():
                    continue
                x, y = start, stop
                while x > a and words[x - 1] == phrase[x - 1 - start + lead]:
                    x -= 1
                while y < b and words[y] == phrase[y - start + lead]:
                    y += 1
                if y - x >= WINDOW:
                    if out is None:
                        out = np.zeros(len(words), bool)
                    out[x:y] = True
        return out


_FIELDS = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_text", pa.string()), pa.field("kept_sha256", pa.string())]
RESULT = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def _locate(carried: list[int]):
    """Rows of a shard, its phrases first, then its texts -> one result per text, after the columns `carried`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, _Shard()
        for batch in batches:
            rows, places, held = [], [], 0

            def out() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(places)) for i in carried]
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)]
                return pa.record_batch([*own, *new], [*(batch.schema.names[i] for i in carried), *(f.name for f in _FIELDS)])

            numbers, kinds, ids, texts, leads, phrases = (c.to_pylist() if i in (0, 1, 2, 4) else c for i, c in enumerate(batch.columns[:6]))
            for place, (number, kind, doc_id, text, lead, phrase) in enumerate(zip(numbers, kinds, ids, texts, leads, phrases)):
                if number != at:
                    at, shard = number, _Shard()
                if kind == 0:
                    shard.add(doc_id, text.as_py(), lead, phrase.as_py())
                    continue
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = shard.covered(doc_id, words)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                changed = None if gone is None else joined.decode("utf-8", "surrogatepass")
                rows.append((len(words), len(words) - len(kept), changed, hashlib.sha256(joined).hexdigest()))
                places.append(place)
                held += len(joined)
                if held > 8 << 20:
                    yield out()
                    rows, places, held = [], [], 0
            if rows:
                yield out()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by a space; null where nothing is
    removed, so that an unchanged text is not copied), kept_sha256 (of the kept words joined by a space). With `keep` also a
    struct `row` of the input's columns."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if keep and c not in (id_col, text_col)]
    extra = [F.col(c).alias(f"c{i}") for i, c in enumerate(others)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    named = docs.filter("doc_id is not null and text is not null")
    anchors = materialize(named.mapInArrow(_anchors, "doc_id long, anchor long"), "anchors")
    twice = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    known = anchors.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("known"))
    stretches = materialize(named.join(known, "doc_id").select("doc_id", "text", "known").mapInArrow(_stretches, "doc_id long, text string"), "stretches")
    firsts = (
        stretches.mapInArrow(_windows, "doc_id long, window long")
        .groupBy("window")
        .agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi"))
        .filter("doc_id < hi")
        .groupBy("doc_id")
        .agg(F.collect_list("window").alias("known"))
    )
    found = stretches.join(firsts, "doc_id").select("doc_id", "text", "known")
    phrases = materialize(found.mapInArrow(_phrases, "anchor long, first_doc long, core string, lead int, phrase string").distinct(), "phrases")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS * parts)).cast("int").alias("shard")
    where = (
        stretches.mapInArrow(_stretch_anchors, "doc_id long, anchor long")
        .groupBy("anchor", shard)
        .agg(F.max("doc_id").alias("hi"))
    )
    sent = (
        phrases.join(where, "anchor")
        .filter("hi > first_doc")
        .select("shard", F.lit(0).alias("kind"), F.col("first_doc").alias("doc_id"), F.col("core").alias("text"), "lead", "phrase")
    )
    own = [f"c{i}" for i in range(len(others))]
    texts = docs.select(shard, F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("int").alias("lead"), F.lit(None).cast("string").alias("phrase"), *own)
    rows = sent.unionByName(texts, allowMissingColumns=True).repartitionById(parts, "shard").sortWithinPartitions("shard", "kind")
    carried = ["doc_id", *["text"] * keep, *own]
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    out = rows.mapInArrow(_locate([rows.columns.index(c) for c in carried]), f"{kind}, {RESULT}")
    if not keep:
        return out
    names = {id_col: "doc_id", text_col: "text", **dict(zip(others, own))}
    row = F.struct(*[F.col(names[c]).alias(c) for c in [id_col, text_col, *others]])
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", row.alias("row"))
