"""Streaming operators. Plans that Structured Streaming has built in are composed from it; the others keep a small
state per stream with `transformWithStateInPandas`.

The streams' states lie in `SLOTS` slots (hash of the stream), the keys of the handlers: a call costs far more than a few rows, and a slot's streams share it.
Within a micro-batch the rows of a stream arrive unordered and are put in sequence order inside the handler. If a slot has more than `HELD` stretches of rows,
they wait in map state on disk, by stream and stretch of `SPAN` sequence numbers, and are taken out stretch by stretch, so a stream with most of
the rows needs no more memory than that. These recursions are not linear, so one stream of a micro-batch is sequential work; streams run in parallel.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigframe.session import shared_path
from sigframe.streaming.runs import use_rocksdb

Step = Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]]


SPAN = 16_384  # sequence numbers of a stream that a handler sorts at a time
HELD = 8  # stretches' worth of rows of a slot that a handler keeps in memory
SLOTS = 4096  # keys that the streams' states are dealt to


def _to_bytes(pdf: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def slot_of(key: str) -> Column:
    """The slot of a stream, the key of its state: a call of a handler and its state calls then serve many streams. Rows without a stream have
    a slot of their own, so that the others keep their type."""
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(SLOTS))).cast("int")


def by_stream(pdf: pd.DataFrame, key: str, order: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """The rows of each stream, in order."""
    codes = pd.factorize(pdf[key])[0]
    at = np.lexsort((pdf[order].to_numpy(), codes))
    pdf, codes = pdf.take(at), codes[at]
    cut = np.flatnonzero(np.diff(codes)) + 1
    streams = pdf[key].tolist()
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(pdf)]):
        yield None if codes[a] < 0 else streams[a], pdf.iloc[a:b]


class OrderedStep(StatefulProcessor):
    """Keeps one JSON state per stream of a slot and applies `step(state, rows in order) -> (state, output)` to one stretch after the other."""

    def __init__(self, step: Step, order: str, key: str, kind: str, span: int):
        self.step, self.order, self.key, self.kind, self.span = step, order, key, kind, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("state", f"stream {self.kind}", "doc string")
        self.waiting = handle.getMapState("waiting", f"stream {self.kind}, stretch long, part long", "rows binary")

    def _stretches(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
        head: list[pd.DataFrame] = []
        for pdf in rows:
            head.append(pdf)
            if sum(map(len, head)) > HELD * self.span:
                break
        else:
            yield from by_stream(pd.concat(head), self.key, self.order)
            return
        parts: Counter[tuple] = Counter()
        for pdf in chain(head, rows):
            for stream, mine in by_stream(pdf, self.key, self.order):
                at = mine[self.order].to_numpy() // self.span
                for k in np.unique(at).tolist():
                    self.waiting.updateValue((stream, k, parts[stream, k]), (_to_bytes(mine[at == k]),))
                    parts[stream, k] += 1
        head.clear()
        for stream, k in sorted(parts):
            held = []
            for n in range(parts[stream, k]):
                held.append(_from_bytes(self.waiting.getValue((stream, k, n))[0]))
                self.waiting.removeKey((stream, k, n))
            yield stream, pd.concat(held).sort_values(self.order, kind="stable")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states = {k[0]: v[0] for k, v in self.state.iterator()}
        touched, outs = set(), []
        for stream, pdf in self._stretches(iter(rows)):
            state, out = self.step(json.loads(states.get(stream, "{}")), pdf)
            states[stream] = json.dumps(state)
            touched.add(stream)
            if len(out):
                out.insert(0, self.key, [stream] * len(out))
                outs.append(out)
            if sum(map(len, outs)) >= self.span:
                yield pd.concat(outs, ignore_index=True)
                outs = []
        if outs:
            yield pd.concat(outs, ignore_index=True)
        for stream in touched:
            self.state.updateValue((stream,), (states[stream],))

    def close(self) -> None:
        pass


def stateful(df: DataFrame, key: str, order: str, step: Step, schema: str, span: int = SPAN) -> DataFrame:
    """`schema` is the output's DDL, the key first; the key is of an atomic type."""
    use_rocksdb(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.withColumn("_slot", slot_of(key)).groupBy("_slot").transformWithStateInPandas(
        statefulProcessor=OrderedStep(step, order, key, kind, span), outputStructType=schema, outputMode="append", timeMode="none"
    )


def reblock(df: DataFrame, size: int, key_type: str = "long") -> DataFrame:
    """Fixed blocks of `size` samples from `stream, seq, x`; the remainder waits in the state. A missing or repeated
    sequence number gives a row with `error` and restarts the block at that point."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        held, nxt, block = state.get("held", []), state.get("next", 0), state.get("block", 0)
        out = []
        for seq, x in zip(pdf["seq"].tolist(), pdf["x"].tolist()):
            if seq < nxt:
                out.append((block, None, f"repeated {seq}"))
                continue
            if seq > nxt:
                out.append((block, None, f"missing {nxt}..{seq - 1}"))
                held = []
            held.append(x)
            nxt = seq + 1
            if len(held) == size:
                out.append((block, held, None))
                held, block = [], block + 1
        return {"held": held, "next": nxt, "block": block}, pd.DataFrame(out, columns=["block_no", "xs", "error"])

    return stateful(df, "stream", "seq", step, f"stream {key_type}, block_no long, xs array<double>, error string")


def meter(df: DataFrame, window: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """RMS and peak per stream and event-time window (tumbling, or sliding with `slide`); `ts` must be a TIMESTAMP."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        df.withWatermark("ts", delay)
        .groupBy("stream", w.alias("w"))
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), F.count(F.lit(1)).alias("samples"))
        .select("stream", F.col("w.start").alias("start"), "rms", "peak", "samples")
    )


class SessionStep(StatefulProcessor):
    """Keeps the open sessions of each stream of a slot (JSON lists of start, end, events; in microseconds) and a timer at the slot's first end."""

    def __init__(self, gap: int, kind: str):
        self.gap, self.kind = gap, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", f"stream {self.kind}", "doc string")

    def _load(self) -> dict[object, list[tuple[int, int, int]]]:
        return {k[0]: [tuple(s) for s in json.loads(v[0])] for k, v in self.open.iterator()}

    def _keep(self, stream, sessions: list[tuple[int, int, int]]) -> None:
        if sessions:
            self.open.updateValue((stream,), (json.dumps(sessions),))
        else:
            self.open.removeKey((stream,))

    def _wake(self, ends: Iterator[int]) -> None:
        first = min(ends, default=None)
        if first is not None:
            self.handle.registerTimer(first // 1000)

    def _cut(self, pdf: pd.DataFrame) -> Iterator[tuple[object, list[tuple[int, int, int]]]]:
        """Sessions of each stream of one batch."""
        codes, streams = pd.factorize(pdf["stream"])
        ts = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        at = np.lexsort((ts, codes))
        codes, ts = codes[at], ts[at]
        cut = np.flatnonzero((np.diff(ts) >= self.gap) | (np.diff(codes) != 0)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(ts)]))
        names = [*streams.tolist(), None]  # code -1: no stream
        found: dict[object, list[tuple[int, int, int]]] = {}
        for c, s, e, n in zip(codes[first].tolist(), ts[first].tolist(), (ts[last - 1] + self.gap).tolist(), (last - first).tolist()):
            found.setdefault(names[c], []).append((s, e, n))
        yield from found.items()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """What the watermark has passed is closed here, so that a start has one row in a micro-batch."""
        due = timerValues.getCurrentWatermarkInMs()
        loaded = self._load()
        now: dict[object, list[tuple[int, int, int]]] = {}
        for pdf in rows:
            for stream, some in self._cut(pdf):
                now[stream] = self._merged(now.get(stream, loaded.get(stream, [])) + some)
        out, ends = [], [e for stream, held in loaded.items() if stream not in now for _, e, _ in held]
        for stream, sessions in now.items():
            before, after = set(loaded.get(stream, [])), {s for s, _, _ in sessions}
            closed = [x for x in sessions if x[1] // 1000 <= due]
            kept = [x for x in sessions if x[1] // 1000 > due]
            out += [(stream, *x, "closed") for x in closed] + [(stream, *x, "open") for x in kept if x not in before]
            out += [(stream, s, s, 0, "merged") for s, _, _ in before if s not in after]
            self._keep(stream, kept)
            ends += [e for _, e, _ in kept]
        self._wake(ends)
        if out:
            yield self._frame(out)

    @staticmethod
    def _merged(sessions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for s, e, n in sorted(sessions):
            if out and s < out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]), n + out[-1][2])
            else:
                out.append((s, e, n))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes all that the watermark has passed; a timer is of no account if its session has grown or closed since."""
        due = timerValues.getCurrentWatermarkInMs()
        out, ends = [], []
        for stream, sessions in self._load().items():
            kept = [x for x in sessions if x[1] // 1000 > due]
            if len(kept) < len(sessions):
                out += [(stream, *x, "closed") for x in sessions if x[1] // 1000 <= due]
                self._keep(stream, kept)
            ends += [e for _, e, _ in kept]
        self._wake(ends)
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["stream", "start", "end", "events", "status"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c], unit="us", utc=True)
        return out

    def close(self) -> None:
        pass


def sessions(df: DataFrame, gap: str, delay: str = "1 hour", key_type: str = "long") -> DataFrame:
    """Activity sessions per stream, for update mode: `stream, start, end, events, status`. A micro-batch gives a row for every session that it opened or
    changed (`open`), for every start that another session has taken over (`merged`, without events), and one for each session whose end the
    watermark has passed (`closed`); a closed session leaves the state. The newest row of a (stream, start) holds."""
    use_rocksdb(df.sparkSession)
    length = df.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {gap})").first()[0]
    schema = f"stream {key_type}, start timestamp, end timestamp, events long, status string"
    kind = df.schema["stream"].dataType.simpleString()
    return df.withWatermark("ts", delay).select("stream", "ts", slot_of("stream").alias("_slot")).groupBy("_slot").transformWithStateInPandas(
        statefulProcessor=SessionStep(length, kind), outputStructType=schema, outputMode="update", timeMode="eventTime"
    )


def dedupe_stream(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop replayed (stream, seq) pairs that come within the watermark delay of each other. The state has a row for each pair of that time, in the
    session's state store."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stream", "seq"])


def stream_limiter(df: DataFrame, key_type: str = "long") -> DataFrame:
    """Running limiter on `stream, seq, x`: the peak so far is the state; `y` never exceeds 1."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        x = pdf["x"].to_numpy(dtype=float)
        peak = np.maximum.accumulate(np.maximum(np.abs(x), state.get("peak", 0.0)))
        y = x / np.maximum(peak, 1.0)
        return {"peak": float(peak[-1])}, pd.DataFrame({"seq": pdf["seq"].to_numpy(), "y": y})

    return stateful(df, "stream", "seq", step, f"stream {key_type}, seq long, y double")


UNITY = 1024  # fixed value: gain steps per unit
ATTACK_STEPS = {"stock": 1, "gentle": 4}  # fixed values: clips per step down


def gain_control_step(state: dict, x: np.ndarray, limit: int, block: int, timeout: int, attack_every: int) -> tuple[dict, np.ndarray]:
    """Integer gain control over one run of samples, in steps of 1/1024.

    A sample beyond the limit counts as a clip, and every `attack_every` clips lower the gain at once. Blocks have `block` samples. A block without clips
    makes the count start anew. A block below unity in which the gain did not fall is calm; as soon as calm blocks in a row last for `timeout` samples, the gain rises
    one step and the calm starts anew.

    Between two steps the gain is constant, so a whole stretch up to the block's end is scaled and compared at once, and cut
    behind the clip that makes the gain fall.
    """
    s = {"gain": UNITY, "attack": 0, "calm": 0, "at": 0, "clips": 0, "fell": False} | state
    patience = max(1, math.ceil(timeout / block))
    done, out = 0, [np.empty(0, dtype=np.int64)]
    while done < len(x):
        stretch = (x[done : done + block - s["at"]] * s["gain"]) >> 10
        clips = np.flatnonzero(np.abs(stretch) > limit)
        missing = attack_every - s["attack"]
        if falls := len(clips) >= missing:
            clips = clips[:missing]
            stretch = stretch[: clips[-1] + 1]
        out.append(stretch)
        done += len(stretch)
        s["attack"] = 0 if falls else s["attack"] + len(clips)
        s |= {"at": s["at"] + len(stretch), "clips": s["clips"] + len(clips), "gain": s["gain"] - falls, "fell": s["fell"] or falls}
        if s["at"] == block:
            calm = s["calm"] + 1 if s["gain"] < UNITY and not s["fell"] else 0
            rise, calm = divmod(calm, patience)
            s |= {"gain": s["gain"] + rise, "calm": calm, "attack": s["attack"] if s["clips"] else 0, "at": 0, "clips": 0, "fell": False}
    return s, np.concatenate(out)


def gain_control(df: DataFrame, limit: int, block: int, timeout: int, profile: str = "stock", key_type: str = "long") -> DataFrame:
    """Automatic gain control on integer samples `stream, seq, x`; gives `y` and the gain after the micro-batch."""
    every = ATTACK_STEPS[profile]

    def step(state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        new, y = gain_control_step(state, pdf["x"].to_numpy(dtype=np.int64), limit, block, timeout, every)
        return new, pd.DataFrame({"seq": pdf["seq"].to_numpy(), "y": y})

    return stateful(df, "stream", "seq", step, f"stream {key_type}, seq long, y long")


def levels(x: np.ndarray) -> np.ndarray:
    """1 + log2|x| / 32, at least 0."""
    with np.errstate(divide="ignore"):
        return np.maximum(1.0 + np.log2(np.abs(x)) / 32.0, 0.0)


def follower_step(peak: float, x: np.ndarray, attack: float, release: float, threshold: float, ratio: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Peak follower over `levels` and the gain 2^(32 (c - 1)) with
    c = (threshold - peak) * ratio + 0.9999999 for peaks above the threshold."""
    peaks = np.empty(len(x))
    for i, v in enumerate(levels(x).tolist()):
        peak = v + (peak - v) * (attack if peak <= v else release)
        peaks[i] = peak
    c = (threshold - np.maximum(peaks, threshold)) * ratio + 0.9999999
    return peak, peaks, x * np.exp2(32.0 * (c - 1.0))


def follower(df: DataFrame, attack: float, release: float, threshold: float, ratio: float, key_type: str = "long") -> DataFrame:
    """Compressor on `stream, seq, x`: follower level and compressed sample."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        peak, peaks, y = follower_step(state.get("peak", 0.0), pdf["x"].to_numpy(dtype=float), attack, release, threshold, ratio)
        return {"peak": peak}, pd.DataFrame({"seq": pdf["seq"].to_numpy(), "peak": peaks, "y": y})

    return stateful(df, "stream", "seq", step, f"stream {key_type}, seq long, peak double, y double")


def _message_length(status: int) -> int:
    high = status & 0xF0
    if high in (0xC0, 0xD0):
        return 2
    if high == 0xF0:
        return {0xF1: 2, 0xF3: 2, 0xF2: 3}.get(status, 1)
    return 3


def split_messages(state: dict, data: list[tuple[int, int]]) -> tuple[dict, list[tuple[int, list[int]]]]:
    """Cut (seq, byte) pairs into messages (seq of the last byte, bytes). A byte below 0x80 without a message to
    belong to starts one with the last status below 0xF0, or is dropped if there was none. 0xF0 starts a message of
    four bytes if 0xF0 or 0xF1 follows, else one up to 0xF7. An unfinished message stays in the state."""
    last, cur, need = state.get("last", 0), state.get("cur", []), state.get("need", 0)
    out = []
    for seq, b in data:
        if not cur:
            if b == 0xF0:
                cur, need = [b], -1
            elif b < 0x80:
                if not last:
                    continue
                cur, need = [last, b], _message_length(last)
            else:
                cur, need = [b], _message_length(b)
        else:
            cur.append(b)
            if need == -1 and len(cur) == 2:
                need = 4 if b in (0xF0, 0xF1) else 0
        if len(cur) == need or (need == 0 and b == 0xF7):
            if cur[0] < 0xF0:
                last = cur[0]
            out.append((seq, cur))
            cur, need = [], 0
    return {"last": last, "cur": cur, "need": need}, out


def running_status(df: DataFrame, key_type: str = "long") -> DataFrame:
    """Messages of a byte stream `stream, seq, b`: `seq` of the last byte, `message` as hex text."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        new, msgs = split_messages(state, list(zip(pdf["seq"].tolist(), pdf["b"].tolist())))
        return new, pd.DataFrame({"seq": [s for s, _ in msgs], "message": [bytes(m).hex() for _, m in msgs]})

    return stateful(df, "stream", "seq", step, f"stream {key_type}, seq long, message string")


def stream_paired_controller(df: DataFrame, key_type: str = "long") -> DataFrame:
    """Paired controllers on `stream, seq, cc, v`; the previous control change is the state."""

    def step(state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        cc, v = pdf["cc"].to_numpy(dtype=np.int64), pdf["v"].to_numpy(dtype=np.int64)
        before = np.concatenate(([state.get("cc", 255)], cc[:-1]))
        value = np.concatenate(([state.get("v", 0)], v[:-1]))
        pair = (before < 32) & (cc == before + 32)
        out = np.where(pair, v | (value << 7), v << 7)
        return {"cc": int(cc[-1]), "v": int(v[-1])}, pd.DataFrame({"seq": pdf["seq"].to_numpy(), "cc": cc, "value": out})

    return stateful(df, "stream", "seq", step, f"stream {key_type}, seq long, cc long, value long")


def late_split(stream: DataFrame, ts: str, delay: str, label: str = "late") -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows older than the greatest event time of the earlier micro-batches minus `delay` go to the
    side table. Each batch writes its two parts and its own maximum under its number, so a retried batch rewrites
    the same rows."""
    spark = stream.sparkSession
    base, state = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")

    def split(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            marks = spark.read.parquet(f"{base}/marks").filter(F.col("batch") < batch_id)
            limit: Column = marks.agg(F.max("top").alias("_top")).scalar() - F.expr(f"INTERVAL {delay}")
            late = F.coalesce(F.col(ts) < limit, F.lit(False))
        else:
            late = F.lit(False)
        tagged = batch.withColumn("late", late)
        tagged.write.mode("overwrite").partitionBy("late").parquet(f"{base}/rows/batch={batch_id}")
        batch.agg(F.max(ts).alias("top")).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(split).start().awaitTermination()
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows").drop("batch")
    is_late = F.col("late") == "true"
    return rows.filter(~is_late).drop("late"), rows.filter(is_late).drop("late")
