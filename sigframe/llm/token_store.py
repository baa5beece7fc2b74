"""Token ids of all texts in one long array, with Elias-Fano coded text boundaries.

A store is a Parquet table of segments in the order of the ids' array. A segment holds whole texts, about `SEGMENT` ids or one longer
text, as one binary value:

    b"TIDS", version, bytes per id (2 or 4), texts and ids as u32, the ids (little-endian), Elias-Fano ends of its texts, CRC-32 of all that

Beside it stand its place (part, seq), its counts and its texts' ids, so starts in the whole array are sums of a small
manifest, not a stored table of 64-bit offsets. Spark's writer commits the files, so a lost executor or a second try leaves no half
segment, and any store that Spark can write will do.

Texts are in ascending order of id (nulls first, equal ids by hash of the text, then text). A null text is empty: its only id
is the end id. Each input row gives one text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigframe.llm.elias_fano import EliasFano, encode
from sigframe.llm.words import pieces

SEGMENT = 1 << 20
END = 1
KNOWN = 700_000
_HEAD = struct.Struct("<4sBBII")
_WORD = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


def _byte_signs() -> dict[int, int]:
    """Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for signs from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_SIGNS = _byte_signs()


class _Known(dict):
    """Ids by word; a missing word is looked up once."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key):
        self[key] = got = self.find(key)
        return got


class WordIds:
    """Ids of words under a tokenizer that drops white space, so that a text's ids are its words' ids in a row.

    Ids of up to `KNOWN` words are remembered between texts and tasks. If the tokenizer lower-cases, separates letters from other
    characters and works on bytes (tried on a few words at the start), a word of Latin letters and trailing ASCII punctuation is
    given to its piece model as those two parts, which are remembered too.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.wide = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) > 0xFFFF
        self.known, self.parts = _Known(self._find), _Known(self._part)
        probe = ["The", "Über", "naïve...", "ÇÀ!!", "qwrtzu,", "eßen.###", "x"]
        self.direct = True
        self.direct = all(self._find(w.encode()) == self._plain(w) for w in probe)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() else part.encode().decode("latin-1").translate(_SIGNS)
        ids = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _find(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        m = _WORD.fullmatch(text) if self.direct else None
        if m is None:
            return self._plain(text)
        letters, marks = m.groups()
        if not (letters.isascii() or max(letters) < "İ" and letters.isalpha()):
            return self._plain(text)
        ids = self.parts[letters.lower()]
        return ids + self.parts[marks] if marks else ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        for memory in (self.known, self.parts):
            if len(memory) > KNOWN:
                memory.clear()
        get = self.known.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


class TextIds:
    """Ids of whole texts under any tokenizer."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.wide = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) > 0xFFFF

    def ids(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]


_made: dict[tuple[type, int], WordIds | TextIds] = {}


def _encoder(kind: type, spec: str):
    """One encoder per worker process, kept between tasks."""
    key = (kind, zlib.crc32(spec.encode()))
    if key not in _made:
        _made.clear()
        _made[key] = kind(spec)
    return _made[key]


def pack(ids: list[bytes], wide: bool) -> bytes:
    """A segment out of its texts' ids."""
    ends = np.cumsum([len(x) // 4 for x in ids])
    joined = np.frombuffer(b"".join(ids), "<u4").astype("<u4" if wide else "<u2")
    raw = _HEAD.pack(b"TIDS", 1, 4 if wide else 2, len(ids), len(joined)) + joined.tobytes() + encode(ends, int(ends[-1]) if len(ends) else 0)
    return raw + struct.pack("<I", zlib.crc32(raw))


def unpack(raw: bytes) -> tuple[np.ndarray, EliasFano]:
    """The ids of a segment and the ends of its texts."""
    magic, version, width, n, total = _HEAD.unpack_from(raw)
    if magic != b"TIDS" or version != 1 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(memoryview(raw)[:-4]):
        raise ValueError("not a whole segment of token ids")
    ids = np.frombuffer(raw, f"<u{width}", total, _HEAD.size)
    return ids, EliasFano(memoryview(raw)[_HEAD.size + width * total :])


_STORE = "part int, seq int, n_docs long, n_ids long, doc_ids array<long>, segment binary"
_LISTS = pa.list_(pa.int64())


def write_store(docs: DataFrame, path: str, spec: str, end: int | None = END, by_word: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the store of all rows to `path`. `spec` is the tokenizer's JSON text; `by_word` says that it drops white space."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    tail = b"" if end is None else struct.pack("<I", end)
    kind = WordIds if by_word else TextIds

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(kind, shared.value), TaskContext.get().partitionId()
        seq, held, ids, docs = 0, 0, [], []

        def out() -> pa.RecordBatch:
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], _LISTS), pa.array([pack(ids, encoder.wide)], pa.binary())]
            return pa.record_batch(cols, ["part", "seq", "n_docs", "n_ids", "doc_ids", "segment"])

        for batch in batches:
            for piece in pieces(batch):
                texts = [x.as_py() if x.is_valid else b"" for x in piece.column(1).cast(pa.binary())]
                for doc_id, got in zip(piece.column(0).to_pylist(), encoder.ids(texts)):
                    ids.append(got + tail)
                    docs.append(doc_id)
                    held += len(ids[-1]) // 4
                    if held >= SEGMENT:
                        yield out()
                        seq, held, ids, docs = seq + 1, 0, [], []
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).mapInArrow(segments, _STORE).write.parquet(path)


def _starts(store: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each segment. Sums per part first, so one small row per part meets in one place."""
    line = store.select("part", "seq", "n_ids")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per = line.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumn("here", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return line.join(per, "part").select("part", "seq", (F.col("before") + F.col("here")).alias("base"))


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per text: doc_id, start (in the whole array), n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) and,
    if asked for, ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, doc_ids, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ends = unpack(raw)
                ends = ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array([part] * len(crc), pa.int32()), pa.array([seq] * len(crc), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(wide.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    store = spark.read.parquet(path)
    kind = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = store.select("part", "seq", "doc_ids", "segment").mapInArrow(texts, kind)
    start = (F.col("at") + F.col("base")).alias("start")
    return rows.join(_starts(store), ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the texts whose ids are in `wanted`, by select inside the segments that hold them."""
    store = spark.read.parquet(path)
    keys = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    place = store.select("part", "seq", F.posexplode("doc_ids").alias("i", "doc_id")).join(keys, "doc_id")
    asked = place.groupBy("part", "seq").agg(F.collect_list("i").alias("asked"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, raw, asked in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ends = unpack(raw)
                got = [ids[ends[i - 1] if i else 0 : ends[i]].astype(np.int32) for i in asked]
                yield pa.record_batch([pa.array([doc_ids[i] for i in asked], pa.int64()), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = store.join(asked, ["part", "seq"]).select("doc_ids", "segment", "asked")
    return rows.mapInArrow(select, "doc_id long, ids array<int>")
