"""The pipeline, stage by stage, against the plain versions; registration; unusual tables."""

import hashlib
import importlib.util

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sigframe.llm import piece_tokenizer, quality_classifier
from sigframe.llm.language_id import held_out
from sigframe.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import SMALL, clashing
from tests.llm.test_tables import plain_contained
from tests.llm.test_tokens import MODEL


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def plain_stage(name, rows, spark, docs, sf_dir):
    if name == "quality":
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
        model = quality_classifier.fit(docs, labels)
        good = [r.score >= quality_classifier.THRESHOLD for r in quality_classifier.score(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
        return [r for r, g in zip(rows, good) if g]
    if name == "near_dedup":
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest()))
        found = brute.op7([(k, rows[i][1]) for k, i in enumerate(order)])
        return [rows[order[k]] for k, _, c in found if c == k]
    if name == "substring_dedup":
        first, out = {}, []
        for d, text, *_ in rows:
            w = (text or "").split()
            if d is not None:
                for i in range(len(w) - 49):
                    k = tuple(w[i : i + 50])
                    first[k] = min(first.get(k, d), d)
        for d, text, *rest in rows:
            w = (text or "").encode().split()
            s = [x.decode() for x in w]
            gone = set()
            if d is not None:
                for i in range(len(s) - 49):
                    if first.get(tuple(s[i : i + 50]), d) < d:
                        gone |= set(range(i, i + 50))
            if not gone:
                out.append((d, text, *rest))
            elif len(gone) < len(s):
                kept = " ".join(x for i, x in enumerate(s) if i not in gone)
                out.append((d, kept, rest[0], rest[1], len(kept)))
        return out
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    drop = {d for d, *_ in plain_contained([(i, r[1]) for i, r in enumerate(rows)], items)}
    return [r for i, r in enumerate(rows) if i not in drop]


def check_stages(spark, docs, sf_dir, rows):
    from sigframe.session import materialize

    for name, stage in cp.STAGES[:-1]:
        want = sorted(plain_stage(name, rows, spark, docs, sf_dir), key=str)
        out = materialize(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns, name
        got = rows_of(out)
        assert got == want, name
        docs, rows = out, got
    last = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert last.filter("not exact").isEmpty() and last.count() == len(rows)
    return docs, last


def test_stages_on_documents(spark, docs):
    _, last = check_stages(spark, docs, SMALL, rows_of(docs))
    got = cp.run(spark, SMALL)
    key = lambda df: sorted((r.doc_id, r.ids) for r in df.collect())
    assert key(got) == key(last) and got.count() > 0


def test_stages_on_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(quality_classifier, "THRESHOLD", 0.0)
    docs, _ = check_stages(spark, clashing(odd, "row", "score", "component_id", "kept_text", "c0"), SMALL, rows_of(odd))
    assert docs.filter("row is null or row <> 'extra'").isEmpty()


def test_exactly_the_rows_found_go(spark, docs):
    word = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("text is not null").first().text
    rows = [(1, word(0, 60)), (1, word(0, 60)), (1, word(900, 60)), (2, word(0, 60)), (None, word(0, 60)), (None, word(300, 60)), (None, word(300, 60)), (3, item), (3, word(500, 60)), (None, item)]
    made = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], docs.schema)
    left = rows_of(cp.near_dedup(spark, made, SMALL))
    assert sorted(r[:2] for r in left if r[0] is not None) == sorted([(1, word(0, 60)), (1, word(900, 60)), (3, item), (3, word(500, 60))])
    assert [r[1] for r in left if r[0] is None] == [word(300, 60)]
    clean = rows_of(cp.decontamination(spark, made, SMALL))
    assert [r[:2] for r in clean] == sorted((r for r in rows if r[1] != item), key=str)


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.isEmpty()


def test_every_operator_is_registered():
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLES) <= set(entry.oracle_sql()) and [len(n) > 4 for n in QUERIES]


def test_piece_codec_in_the_last_stage(spark, docs):
    out = cp.tokens(spark, docs, SMALL)
    back = piece_tokenizer.decode(out, MODEL)
    assert back.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").filter("text <> t").isEmpty()
