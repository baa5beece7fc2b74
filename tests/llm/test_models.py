"""Language identification and quality scores: exact code lengths, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigframe.llm import language_id, quality_classifier
from sigframe.llm.language_id import held_out
from sigframe.llm.words import text_buffers
from tests.llm.conftest import SMALL, clashing


@pytest.fixture(scope="module")
def langs(docs):
    return language_id.learn(docs.filter(~language_id.held_out()), rows_per_lang=10**9)


def plain_bits(texts, text):
    """PPM code length of `text` by the definition, learned from `texts`."""
    seen = defaultdict(Counter)
    for t in texts:
        b = [None] * 3 + list(t.encode())
        for i in range(3, len(b)):
            for k in range(4):
                seen[tuple(b[i - k : i])][b[i]] += 1
    b, bits = [None] * 3 + list(text.encode()), 0.0
    for i in range(3, len(b)):
        p, k = 1.0, 3
        while True:
            c = seen.get(tuple(b[i - k : i])) if k >= 0 else None
            if k < 0:
                p /= 256
                break
            if c:
                total = sum(c.values()) + len(c)
                if b[i] in c:
                    p *= c[b[i]] / total
                    break
                p *= len(c) / total
            k -= 1
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_those_of_ppm(docs, langs):
    rows = docs.filter(~language_id.held_out()).select("lang", "text").collect()
    for text in ["the and\nerth", "Über ß zz", "", "日本", rows[5].text[:400]]:
        data = np.frombuffer(text.encode(), np.uint8)
        got = language_id.code_lengths(langs, data, np.array([0, len(data)]))[0] / language_id.UNIT
        for lang, bits in zip(langs.langs, got):
            want = plain_bits([r.text for r in rows if r.lang == lang], text)
            assert abs(bits - want) <= 0.001 + 1e-4 * len(data)


def test_kept_contexts_only_shorten_the_tree(docs):
    model = language_id.learn(docs.filter(~language_id.held_out()), contexts=200)
    assert language_id.identify(docs, model).filter("lang_pred = 'und'").isEmpty()


def test_held_out_languages(docs, langs):
    held = docs.filter(language_id.held_out())
    got = {r.doc_id: r.lang_pred for r in language_id.identify(held, langs).collect()}
    want = {r.doc_id: r.lang for r in held.collect() if r.lang is not None}
    assert sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want) > 0


def test_languages_of_odd_rows(odd, none, docs, langs):
    df = clashing(odd, "lang_pred", "score", "id")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.lang_pred, r.score) for r in language_id.identify(df, langs).collect())
    assert len(got) == odd.count()
    texts = {(r.doc_id is None, r.doc_id or 0): r.text for r in odd.collect()}
    for key, lang, score in got:
        letters = any(c.isalpha() for c in texts[key] or "")
        assert (lang in langs.langs) == letters and 0 <= score <= 1 and (lang == "und") == (score == 0)
    assert language_id.identify(none, langs).isEmpty()
    empty = language_id.learn(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert set(language_id.learn(odd).langs) == {"en", "de", "fr"}


def test_held_out_matches_crc(docs):
    for r in docs.select("doc_id", language_id.held_out().alias("h")).limit(50).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet")


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")


def test_quality_of_held_out_rows(more, labels):
    model = quality_classifier.fit(more, labels.filter(~language_id.held_out()))
    got = quality_classifier.score(more, model).join(labels.filter(language_id.held_out()), "doc_id").collect()
    right = sum((r.score >= quality_classifier.THRESHOLD) == (r.quality == 1) for r in got)
    assert right >= 0.95 * len(got) > 0


def test_quality_scores_do_not_depend_on_partitions(more, labels):
    a = quality_classifier.fit(more, labels)
    b = quality_classifier.fit(more.repartition(7), labels.repartition(3))
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.calibrated, b.calibrated)


def test_quality_of_odd_rows(odd, none, more, labels):
    model = quality_classifier.fit(more, labels)
    got = quality_classifier.score(clashing(odd, "x", "y", "score", "held"), model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(none, model).isEmpty()
    blank = quality_classifier.fit(none, labels)
    assert {r.score for r in quality_classifier.score(odd, blank).collect()} == {0.5}
    kept = quality_classifier.score(odd, model, keep=True)
    assert kept.select("row.*").exceptAll(odd).isEmpty()


def test_statistics_by_hand():
    texts = ["A b b\nA b b\n\nTHE!! 12", "", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = dict(zip(quality_classifier.STATS, quality_classifier.statistics(data, off)[0]))
    assert got["words"] == pytest.approx(math.log1p(8)) and got["distinct"] == pytest.approx(4 / 8)
    assert got["twins"] == pytest.approx(2 / 8) and got["repeated_line"] == pytest.approx(1 / 3)
    assert got["shout"] == pytest.approx(1 / 8) and got["capital"] == pytest.approx(3 / 8)
    assert got["loud"] == pytest.approx(2 / len(texts[0])) and got["digit"] == pytest.approx(2 / len(texts[0]))


def test_isotonic_is_the_monotone_least_squares_fit():
    raw, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 0.0])
    x, p = quality_classifier.isotonic(raw, y)
    assert np.allclose(p, [0.0, 0.5, 0.6666667], atol=1e-6) and np.allclose(x, [0.1, 0.25, 0.4666667], atol=1e-6)


def test_label_columns_are_no_inputs(more, labels):
    model = quality_classifier.fit(more, labels)
    a = quality_classifier.score(more, model).collect()
    b = quality_classifier.score(more.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "n_chars": F.lit(0)}), model).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_scores_match_a_plain_fit(spark, docs):
    """The whole model again: one matrix of all labelled rows, and calibration by the max-min formula."""
    qc = quality_classifier
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(~held_out())
    got = {r.doc_id: r.score for r in qc.score(docs, qc.fit(docs, labels)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("calibration")), F.lit(4)) == 0
    known = {r.doc_id: (r.y, r.held) for r in labels.groupBy("doc_id").agg(F.min("quality").alias("y")).select("doc_id", "y", held.alias("held")).collect() if r.y in (0, 1) and r.doc_id in texts}
    stats = lambda t: qc.statistics(*text_buffers(pa.array([t or ""])))[0]
    x = np.array([stats(texts[d]) for d in known])
    y, cal = np.array([v[0] for v in known.values()], float), np.array([v[1] for v in known.values()])
    rng = np.random.default_rng(qc.SEED)
    turn, shift = rng.normal(0, np.sqrt(2 * qc.GAMMA), (x.shape[1], qc.FEATURES)), rng.uniform(0, 2 * np.pi, qc.FEATURES)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)

    def features(v):
        return np.append(np.sqrt(2 / qc.FEATURES) * np.cos(np.clip((v - mean) / scale, -8, 8) @ turn + shift), 1.0)

    z = np.array([features(v) for v in x])
    fit = ~cal
    weight = np.linalg.solve(z[fit].T @ z[fit] + qc.RIDGE * fit.sum() / qc.FEATURES * np.eye(qc.FEATURES + 1), z[fit].T @ y[fit])
    order = np.argsort(z[cal] @ weight, kind="stable")
    raw, target = (z[cal] @ weight)[order], y[cal][order]
    n = len(raw)
    iso = np.array([max(min(target[j : k + 1].mean() for k in range(i, n)) for j in range(i + 1)) for i in range(n)])
    values = np.unique(np.round(iso, 12))
    blocks = [np.flatnonzero(np.round(iso, 12) == v) for v in values]
    at, to = [raw[b].mean() for b in blocks], [target[b].mean() for b in blocks]
    want = {d: float(np.clip(np.interp(features(stats(t)) @ weight, at, to), 0, 1)) for d, t in texts.items()}
    assert n > 10 and want.keys() == got.keys()
    assert max(abs(want[d] - got[d]) for d in want) < 1e-6
