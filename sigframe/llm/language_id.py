"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts of length 0 to `ORDER` with counts of the next byte is learned, then frozen. The probability of
a byte is its share in the longest known context; an unseen byte pays that context's escape probability (distinct bytes
/ (rows + distinct bytes)) and is looked up in the next shorter context, and below length 0 all 256 bytes are alike. A text's code
length under a language is the sum over all its bytes, in units of 2^-16 bit, so it is exact and free of order effects. The
language with the shortest code wins, the first in name order on a tie; the score is its posterior under equal priors.

Because the statistics are frozen, every (context, byte) has a fixed cost: the union of all trees becomes one table, and texts are
scored by gathers over whole pieces of a batch.

Learning takes about `ROWS_PER_LANG` labelled rows of each language (chosen by hash of the id, whole texts); that and `CONTEXTS`, the
most frequent contexts of full length that are kept, bound the model that is sent to the executors. All rows are scored, whole.

Nulls: a null text or one without a letter gives `und`, score 0. Rows without id or language are not learned from. Without
anything to learn from, every row is `und`. Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.words import pieces, text_buffers

ORDER = 3
ROWS_PER_LANG = 600
CONTEXTS = 1 << 15
UNIT = 1 << 16
_BITS = 9  # a symbol: 0 before the text, else byte + 1
_FULL = (1 << _BITS) - 1


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # byte -> class; class 0 stands before a text, the last one for bytes never seen
    row: np.ndarray  # the last three classes -> context
    cost: np.ndarray  # language x (context, class)


def held_out(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _before(sym: np.ndarray, off: np.ndarray, none: int = 0) -> list[np.ndarray]:
    """The symbols 1, 2 and 3 places before each position, `none` where that is before its text."""
    starts, out = off[:-1][off[:-1] < len(sym)], []
    for back in range(1, ORDER + 1):
        p = np.concatenate([np.full(back, none, sym.dtype), sym[:-back]])[: len(sym)]
        for k in range(back):
            at = starts + k
            p[at[at < len(sym)]] = none
        out.append(p)
    return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (three symbols before, symbol) per language; shorter contexts are sums of these."""
    for batch in batches:
        for part in pieces(batch, text=1):
            langs = np.array(part.column(0).to_pylist(), dtype=object)
            data, off = text_buffers(part.column(1))
            sym = data.astype(np.int64) + 1
            gram = sym.copy()
            for k, p in enumerate(_before(sym, off), 1):
                gram |= p << (_BITS * k)
            owner = np.repeat(np.arange(len(langs)), np.diff(off))
            for lang in sorted(set(langs)):
                got, n = np.unique(gram[(langs == lang)[owner]], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(got), pa.string()), pa.array(got), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, contexts: int = CONTEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled rows; see the module's text for the bounds."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.filter("id is not null and lang is not null and text is not null")
    count = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    share = F.create_map(*[F.lit(x) for lang, n in sorted(count.items()) for x in (lang, rows_per_lang / n)]) if count else F.lit(None).cast("map<string,double>")
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(chance < F.element_at(share, F.col("lang"))).select("lang", "text")
    grams = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    return _compile(np.array(table["lang"].to_pylist(), dtype=object), table["gram"].to_numpy(), table["n"].to_numpy(), contexts)


def _compile(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, contexts: int) -> Model:
    langs = sorted(set(lang.tolist()))
    which = np.searchsorted(langs, lang) if langs else np.zeros(0, np.int64)
    seen = np.unique(gram & _FULL)
    classes = np.zeros(_FULL + 1, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 2  # with the start and the byte never seen
    symbol = np.full(256, a - 1, np.int64)
    symbol[seen - 1] = classes[seen]
    place = [classes[gram >> (_BITS * k) & _FULL] for k in range(ORDER + 1)]  # place[0] is the byte itself
    ctx3 = (place[3] * a + place[2]) * a + place[1]
    kept, first = np.unique(ctx3, return_inverse=True)
    heavy = np.argsort(-np.bincount(first, n, len(kept)) if len(kept) else np.zeros(0), kind="stable")[:contexts]
    kept = np.sort(kept[heavy])
    ctx2, ctx1 = np.arange(a * a), np.arange(a)
    pairs = np.unique(place[2] * a + place[1])
    row = np.zeros((a, a, a), np.int32)
    one = 1 + ctx1
    row[:, :, :] = one[None, None, :]
    two = np.zeros(a * a, np.int32)
    two[pairs] = 1 + a + np.arange(len(pairs))
    both = two[ctx2].reshape(1, a, a)
    row = np.where(both > 0, both, row)
    base = 1 + a + len(pairs)
    row.ravel()[kept] = base + np.arange(len(kept))
    total = base + len(kept)
    cost = np.zeros((max(len(langs), 1), total, a), np.int32)
    for j in range(len(langs)):
        mine = which == j
        sym, w = place[0][mine], n[mine].astype(np.float64)
        c1, c2, c3 = place[1][mine], (place[2] * a + place[1])[mine], ctx3[mine]
        at = np.searchsorted(kept, c3)
        inside = (at < len(kept)) & (kept[np.minimum(at, max(len(kept) - 1, 0))] == c3) if len(kept) else np.zeros(len(c3), bool)
        p = np.zeros((total, a))
        levels = [(np.zeros(len(sym), np.int64), np.ones(len(sym), bool)), (1 + c1, np.ones(len(sym), bool)), (two[c2].astype(np.int64), np.ones(len(sym), bool)), (base + at, inside)]
        spans = [(0, 1), (1, 1 + a), (1 + a, base), (base, total)]
        below = np.full((1, a), 1 / 256)
        parents = [np.zeros(1, np.int64), np.zeros(a, np.int64), 1 + pairs % a, two[kept % (a * a)].astype(np.int64)]
        for (rows, ok), (lo, hi), parent in zip(levels, spans, parents):
            counts = np.bincount((rows[ok] - lo) * a + sym[ok], w[ok], (hi - lo) * a).reshape(hi - lo, a)
            rows_n, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            shorter = below if lo == 0 else p[parent]
            share = counts / np.maximum(rows_n + kinds, 1)
            escape = np.where(rows_n > 0, kinds / np.maximum(rows_n + kinds, 1), 1.0)
            p[lo:hi] = np.where(counts > 0, share, escape * shorter)
        cost[j] = np.rint(-np.log2(p) * UNIT)
    return Model(langs, symbol, row.ravel(), cost.reshape(len(cost), -1))


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code length of each text (rows) under each language (columns), in units of 2^-16 bit."""
    out = np.zeros((len(off) - 1, len(model.cost)), np.int64)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    a = int(model.symbol.max()) + 1
    sym = model.symbol[data]
    p1, p2, p3 = _before(sym, off)
    at = model.row[(p3 * a + p2) * a + p1] * np.int64(a) + sym
    for j, cost in enumerate(model.cost):
        out[full, j] = np.add.reduceat(cost[at], off[full], dtype=np.int64)
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, code_bits (null for `und`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch):
                lengths = code_lengths(m, *text_buffers(part.column(1))) / UNIT
                best = lengths.argmin(1)
                least = lengths[np.arange(len(best)), best]
                sure = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
                ok = np.array([bool(m.langs) and t.is_valid and any(map(str.isalpha, t.as_py())) for t in part.column(1)], bool)
                names = [m.langs[b] if k else "und" for b, k in zip(best, ok)]
                bits = pa.array(least, pa.float64(), mask=~ok)
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(np.where(ok, sure, 0.0)), bits], ["doc_id", "lang_pred", "score", "code_bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, code_bits double")
