"""Stateful streams: a stream with most of the rows, sessions that close."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigframe.catalog import streams
from sigframe.catalog.registry import QUERIES
from sigframe.streaming import operators as so
from sigframe.streaming.runs import append_to_table, replay, stage, update_to_table


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "150")
    yield
    spark.conf.set(name, before)


def hot(spark):
    """9,000 of 10,000 samples belong to stream 1, in two micro-batches, far out of order."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"stream": [1] * 9000 + [2 + i % 10 for i in range(1000)], "seq": [*range(9000), *[i // 10 for i in range(1000)]], "x": rng.normal(size=10_000), "cc": rng.integers(0, 64, 10_000), "v": rng.integers(0, 128, 10_000)})
    df = spark.createDataFrame(pdf).repartition(3, F.rand(3))
    path, files = stage(df, F.col("seq") >= 5000, "hot")
    return pdf, replay(spark, path, df.schema, files)


def test_hot_stream_is_taken_in_bounded_stretches(spark, small_batches):
    pdf, rows = hot(spark)

    def step(state, frame):
        seq = frame["seq"].to_numpy()
        assert (np.diff(seq) == 1).all() and seq[0] == state.get("next", 0)
        return {"next": int(seq[-1]) + 1}, pd.DataFrame({"first": [int(seq[0])], "size": [len(seq)]})

    out = append_to_table(so.stateful(rows.select("stream", "seq", "x"), "stream", "seq", step, "stream long, first long, size long", span=400), "sizes").collect()
    mine = [r for r in out if r.stream == 1]
    assert sum(r.size for r in mine) == 9000 and max(r.size for r in out) <= 400 and len(mine) >= 23
    assert sum(r.size for r in out) == len(pdf)


def test_operators_on_a_hot_stream(spark, small_batches, monkeypatch):
    monkeypatch.setattr(so.stateful, "__defaults__", (300,))
    pdf, rows = hot(spark)
    got = append_to_table(so.stream_limiter(rows.select("stream", "seq", "x")), "limit").toPandas().set_index(["stream", "seq"])["y"].sort_index()
    peak = pdf.assign(a=pdf.x.abs()).groupby("stream").a.cummax()
    want = (pdf.x / np.maximum(peak, 1)).set_axis(pd.MultiIndex.from_frame(pdf[["stream", "seq"]])).sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy()) and len(got) == 10_000
    blocks = append_to_table(so.reblock(rows.select("stream", "seq", "x"), 64), "blocks").collect()
    xs = pdf[pdf.stream == 1].x.to_numpy()
    mine = {r.block_no: r.xs for r in blocks if r.stream == 1}
    assert all(r.error is None for r in blocks) and sorted(mine) == list(range(9000 // 64))
    assert all(np.array_equal(mine[k], xs[64 * k : 64 * k + 64]) for k in mine)
    paired = append_to_table(so.stream_paired_controller(rows.select("stream", "seq", "cc", "v")), "pairs").toPandas()
    last = pdf.groupby("stream")[["cc", "v"]].shift().fillna(255).astype("int64")
    cc, v, pcc, pv = (x.to_numpy() for x in (pdf.cc, pdf.v, last.cc, last.v))
    want = np.where((pcc < 32) & (cc == pcc + 32), v | (pv << 7), v << 7)
    key = pd.MultiIndex.from_frame(pdf[["stream", "seq"]])
    assert paired.set_index(["stream", "seq"])["value"].sort_index().equals(pd.Series(want, key, name="value").sort_index())


def sessions_of(spark, batches, gap="10 minutes", delay="30 minutes"):
    """`batches`: lists of (stream, minute)."""
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(s, base + dt.timedelta(minutes=m), k) for k, b in enumerate(batches) for s, m in b]
    df = spark.createDataFrame(rows, "stream long, ts timestamp, k int")
    path, files = stage(df, "k", "sessions")
    stream = so.sessions(replay(spark, path, df.schema, files), gap, delay)
    found = {}
    raw = update_to_table(stream, ["stream", "start"], "sessions")
    for r in raw.select("stream", (F.unix_seconds("start") / 60).alias("a"), (F.unix_seconds("end") / 60).alias("b"), "events", "status").collect():
        found[r.stream, r.a - base.timestamp() / 60] = (r.b - base.timestamp() / 60, r.events, r.status)
    return found


def test_open_closed_merged_and_late_sessions(spark):
    got = sessions_of(spark, [[(1, 0), (1, 5), (1, 20), (2, 3)], [(1, 12), (2, 50)], [(1, 100), (2, 0), (2, 2)], [(2, 1), (1, 69), (1, 75), (1, 104)]])
    assert got[1, 0] == (30, 4, "closed")  # 12 joined 0..15 and 20..30
    assert got[1, 20][2] == "merged"
    assert got[2, 3] == (13, 1, "closed") or got[2, 3][2] == "merged"
    assert got[2, 50] == (60, 1, "closed")
    assert got[1, 100] == (114, 2, "open")
    assert got[1, 69] == (85, 2, "open") and (2, 1) not in got  # late is what lies before the watermark of the batch before, 50 - 30


def test_a_session_closes_when_the_watermark_reaches_its_end(spark):
    assert sessions_of(spark, [[(1, 0)], [(2, 40)]])[1, 0] == (10, 1, "closed")
    assert sessions_of(spark, [[(1, 0)], [(2, 39)]])[1, 0] == (10, 1, "open")


def test_gain_rises_after_calm_blocks():
    state, y = so.gain_control_step({}, np.array([30000] * 4 + [100] * 28), 20000, 4, 8, 2)
    assert y[:4].tolist() == [30000, 30000, 29970, 29970] and state["gain"] == 1024
    state, y = so.gain_control_step({}, np.array([30000] * 4 + [100] * 12), 20000, 4, 8, 2)
    assert state["gain"] == 1023 and state["calm"] == 1


def test_streams_share_slots(spark, small_batches, monkeypatch):
    monkeypatch.setattr(so, "SLOTS", 3)
    assert spark.range(500).select(so.slot_of("id").alias("k")).distinct().count() == 3
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 40}" if i % 41 else None, i // 5, float(v)) for i, v in enumerate(rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "stream string, seq long, x double").repartition(3, F.rand(3))
    path, files = stage(df, F.col("seq") >= 200, "slots")
    got = append_to_table(so.stream_limiter(replay(spark, path, df.schema, files), "string"), "slots").collect()
    peak, want = {}, []
    for s, n, x in sorted(rows, key=lambda r: r[1]):
        peak[s] = max(peak.get(s, 1.0), abs(x))
        want.append((str(s), n, round(x / peak[s], 9)))
    assert sorted((str(r.stream), r.seq, round(r.y, 9)) for r in got) == sorted(want)
    assert any(r.stream is None for r in got)


def test_sessions_of_many_streams_in_few_slots(spark, small_batches, monkeypatch):
    monkeypatch.setattr(so, "SLOTS", 2)
    got = sessions_of(spark, [[(s, s % 7 + 20 * k) for s in range(100) for k in range(3)], [(s, 55) for s in range(0, 100, 2)], [(500, 200)]])
    want = {(s, s % 7 + 20 * k): (s % 7 + 20 * k + 10, 1, "closed") for s in range(100) for k in range(3)}
    for s in range(0, 100, 2):
        want[s, s % 7 + 40] = (want[s, s % 7 + 40][0], 1, "closed")
        if s % 7 == 6:
            want[s, 46] = (65, 2, "closed")
        else:
            want[s, 55] = (65, 1, "closed")
    assert got == want | {(500, 200): (210, 1, "open")}


def test_only_what_the_queries_use_is_staged(spark, monkeypatch, tmp_path):
    staged = []
    monkeypatch.setattr(streams, "stage", lambda df, *a: staged.append(df) or stage(df, *a))
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i % 30), i % 7, "click", float(i), "x" * 100) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["dedupe_stream"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i % 7, i, round(i / 250 - 1, 6)) for i in range(90))
    assert set(staged[0].columns) == {"stream", "seq", "x", "ts", "event_type", "copy"} and staged[0].count() == 180
