"""Quality scores: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

A text becomes a vector of statistics (lengths, shares of kinds of characters and words, repetition). Random Fourier features
approximate a Gaussian kernel over the standardised vector; ridge regression on them solves normal equations whose parts are summed
per partition; the pool-adjacent-violators algorithm turns raw scores of rows not used for the ridge into probabilities.

Learning takes about `SAMPLE` labelled rows (chosen by hash of the id, whole texts); that bounds every table of the fit, and the
model is a few arrays. All rows are scored, whole, by the same formula.

Nulls: a null text is scored as an empty one. Label rows without id or label are not learned from; of several labels of an id the
lowest counts. Without labels of both kinds the score is the mean label (1/2 without any). Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.words import pieces, runs, text_buffers, word_hashes, word_spans
from sigframe.session import materialize

SAMPLE, FEATURES, GAMMA, RIDGE, THRESHOLD, SEED = 20_000, 256, 0.05, 1e-3, 0.7, 7
PARTS = 16
_MARKS = {"loud": b"!?", "symbol": b"#*$%&|<>~^=+_@\\/{}[]", "stop": b".,;:", "digit": b"0123456789"}
STATS = ["words", "bytes", "mean_word", "spread_word", "upper", *_MARKS, "other", "lines", "capital", "shout", "distinct", "twins", "repeated_line"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per text of a piece."""
    n = len(off) - 1
    s, e, first = word_spans(data, off)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    chars, words = np.diff(off).astype(float), np.diff(first).astype(float)
    c, w = np.maximum(chars, 1), np.maximum(words, 1)

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    def per_word(value: np.ndarray) -> np.ndarray:
        return np.bincount(word_doc, value, n)

    upper = (data >= 65) & (data <= 90)
    size = (e - s).astype(float)
    mean = per_word(size) / w
    spread = np.sqrt(np.maximum(per_word(size**2) / w - mean**2, 0))
    marks = []
    for m in _MARKS.values():
        table = np.zeros(256, bool)
        table[list(m)] = True
        marks.append(per_text(table[data]) / c)
    h = word_hashes(data, s, e)
    order = np.lexsort((h, word_doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    distinct = np.bincount(word_doc[order][new], minlength=n) / w
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
    capital = upper[s] if len(s) else np.zeros(0, bool)
    shout = capital & upper[np.minimum(s + 1, e - 1)] & (size > 1) if len(s) else capital
    line = data == 10
    starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(line) + 1]))
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    filled = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends = starts[filled], ends[filled]
    first_word, last_word = np.searchsorted(s, starts), np.searchsorted(s, ends)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    line_hash = sums[last_word] - sums[first_word]
    line_doc = np.searchsorted(off, starts, "right") - 1
    pair = np.lexsort((line_hash, line_doc))
    again = np.zeros(len(pair), bool)
    again[1:] = (line_hash[pair][1:] == line_hash[pair][:-1]) & (line_doc[pair][1:] == line_doc[pair][:-1])
    repeated = np.bincount(line_doc[pair], again, n) / np.maximum(np.bincount(line_doc, minlength=n), 1)
    other = per_text(data >= 128) / c
    columns = [np.log1p(words), np.log1p(chars), mean, spread, per_text(upper) / c, *marks, other, per_text(line) / w, per_word(capital) / w, per_word(shout) / w, distinct, per_word(twin) / w, repeated]
    return np.stack(columns, 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    raw: np.ndarray  # increasing raw scores and the calibrated score at each
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.calibrated), 0, 1)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw score and mean label of each block, both increasing."""
    blocks: list[list[float]] = []
    for value in np.unique(raw):
        mine = label[raw == value] if len(raw) < 2 else label[np.searchsorted(raw, value, "left") : np.searchsorted(raw, value, "right")]
        blocks.append([value * len(mine), float(mine.sum()), len(mine)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ...) -> (id, statistics, ...)."""
    for batch in batches:
        for part in pieces(batch):
            x = statistics(*text_buffers(part.column(1)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([part.column(0), flat, *part.columns[2:]], ["doc_id", "x", *part.schema.names[2:]])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on rows of `docs` that `labels` marks 0 or 1."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = max(marks.count(), 1)
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marks.filter(chance * rows < sample)  # about `sample` small rows, so they may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(4)) == 0
    vectors = labelled.mapInArrow(_vectors, "doc_id long, x array<double>, y int").withColumn("held", held)
    vectors = materialize(vectors.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "y", "x"), "vectors")

    moments = vectors.select("x").agg(
        F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    get = lambda k: np.array([moments[f"{k}{i}"] or 0.0 for i in range(len(STATS))])
    rng = np.random.default_rng(SEED)
    model = Model(get("m"), np.maximum(get("s"), 1e-3), rng.normal(0, np.sqrt(2 * GAMMA), (len(STATS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    if not moments["n"]:
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's share of the normal equations."""
        total, right, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
            total, right, n = total + z.T @ z, right + z.T @ y, n + len(y)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.ravel()]), pa.array([right])], ["n", "a", "b"])

    sums = vectors.filter("not held").select("x", "y").mapInArrow(equations, "n long, a array<double>, b array<double>").collect()  # at most PARTS rows, whatever the input
    sums = sorted(sums, key=lambda r: (r.n, r.b))
    a, b, n = sum(np.array(r.a) for r in sums).reshape(FEATURES + 1, -1), sum(np.array(r.b) for r in sums), sum(r.n for r in sums)
    model.weight = np.linalg.solve(a + RIDGE * max(n, 1) / FEATURES * np.eye(FEATURES + 1), b)

    rest = vectors.filter("held").select("x", "y").toArrow()  # a quarter of the sample
    if rest.num_rows:
        raw, y = model.raw_scores(_matrix(rest["x"].combine_chunks())), rest["y"].to_numpy().astype(float)
        order = np.argsort(raw, kind="stable")
        model.raw, model.calibrated = isotonic(raw[order], y[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1); with `keep` the input's columns, in `row`, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns if keep else [id_col]
    text = names.index(text_col) if keep else 1

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                got = pa.array(shared.value.scores(statistics(*text_buffers(part.column(text)))))
                yield pa.record_batch([*part.columns[: len(names)], got], [*part.schema.names[: len(names)], "score"])

    columns = [F.col(c).cast("long").alias("doc_id") if not keep else F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*columns, *[] if keep else [F.col(text_col).cast("string").alias("text")])
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    out = rows.mapInArrow(scores, f"{kind}, score double")
    return out.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]).alias("row"), "score") if keep else out
