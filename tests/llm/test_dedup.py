"""Substring dedup and SimHash near-dedup against their plain versions."""

import random

from pyspark.sql import functions as F

from sigframe.llm import simhash
from sigframe.llm.components import components
from sigframe.llm.repeated_phrases import remove_repeats
from sigframe.llm.simhash import near_duplicates
from tests.llm import brute
from tests.llm.conftest import clashing, pairs


def _op5(df):
    return [tuple(r) for r in remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


def test_substring_dedup_documents(docs):
    got = _op5(docs)
    assert brute.multiset(got) == brute.multiset(brute.op5(pairs(docs)))
    assert sum(r[2] for r in got) > 0


def test_substring_dedup_odd_rows(odd):
    df = clashing(odd, "known", "shard", "kind", "anchor", "n_words")
    assert brute.multiset(_op5(df)) == brute.multiset(brute.op5(pairs(odd)))


def test_substring_dedup_random_overlaps(spark):
    r = random.Random(3)
    base = [str(i) for i in range(400)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            a = r.randint(0, 330)
            w += base[a : a + r.randint(40, 120)] + [f"n{r.randint(0, 9)}"] * r.randint(0, 2)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert brute.multiset(_op5(df)) == brute.multiset(brute.op5(rows))


def test_substring_dedup_empty(none):
    assert _op5(none) == []


def test_kept_text_is_null_where_nothing_goes(odd):
    df = clashing(odd, "c0", "row", "kept_text")
    out = remove_repeats(df, keep=True)
    assert out.filter("(n_removed = 0) <> (kept_text is null)").isEmpty()
    rows = out.select("row.*").select(*df.columns)
    assert rows.count() == df.count() and rows.exceptAll(df).isEmpty()


def _op7(df):
    return [tuple(r) for r in near_duplicates(df).collect()]


def test_simhash_documents(docs):
    assert brute.multiset(_op7(docs)) == brute.multiset(brute.op7(pairs(docs)))


def test_simhash_odd_rows(odd, none):
    df = clashing(odd, "fp", "fingerprint", "component_id", "root", "t", "key")
    assert brute.multiset(_op7(df)) == brute.multiset(brute.op7(pairs(odd)))
    assert _op7(none) == []


def test_every_near_pair_meets_in_a_table():
    for bits in [(0, 15, 30), (1, 16, 2), (63, 0, 7), (5,), (11, 12, 13), (60, 61, 62)]:
        assert any(all(not m >> b & 1 for b in bits) for m in simhash.FIRST)
    assert all(bin(m & (1 << 64) - 1).count("1") >= 32 for m in simhash.FIRST)


def test_crowded_buckets_keep_every_link(spark, monkeypatch):
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(150):
            y = x
            for b in r.sample(range(64), r.randint(0, 4)):
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "CROWDED", 4)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    root = {r.node: r.root for r in components(edges).collect()}
    want = {x: x for x in fps}
    grew = True
    while grew:
        grew = False
        for x in fps:
            least = min(want[y] for y in fps if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3)
            if least < want[x]:
                want[x], grew = least, True
    assert {x: root.get(x, x) for x in fps} == want


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star + star + [(5, 5)], "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert root == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(edges.filter(F.lit(False))).isEmpty()
