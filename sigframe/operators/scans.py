"""Batch forms of two stream operators that are not linear, as scans over blocks.

What a block does to any state it may be entered with is worked out first, for all blocks at once; the summaries of a stream's blocks are then followed in
order (a small row per block), which gives every block its true entry; then all blocks are worked out again. So one stream is spread over
as many tasks as it has blocks.

* follower: one step maps the peak by an increasing function of two straight pieces, so a block is an increasing function of straight pieces. As steps contract, it
  soon is a constant.
* running status: of a parser's state only its class counts for what it does next (kind of the last status, place in an unfinished message): 33 classes. A block maps each
  to another. Messages that lie in a block come from its task; bytes of a message that crosses blocks are put together while the blocks are followed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.plans.blocked import block_of
from sigframe.session import materialize
from sigframe.streaming.operators import follower_step, levels, split_messages

BLOCK = 4096
TOP = 64.0  # no level is higher: 1 + log2(largest double) / 32


def _blocks(df: DataFrame, value: str, size: int) -> DataFrame:
    """`stream, block, seqs, xs`: the values of each block in order."""
    rows = df.groupBy("stream", block_of("seq", size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("seq", value))).alias("_s"))
    return materialize(rows.select("stream", "block", F.transform("_s", lambda s: s["seq"]).alias("seqs"), F.transform("_s", lambda s: s[value]).alias("xs")), "blocks")


def peak_map(level: np.ndarray, attack: float, release: float) -> tuple[list[float], list[float], list[float]]:
    """The peak behind a block as a function of the peak before it (0 .. `TOP`): starts, slopes and offsets of its straight pieces."""
    starts, slopes, offsets = [0.0], [1.0], [0.0]
    for v in level.tolist():
        if slopes[-1] * TOP + offsets[-1] - offsets[0] < 1e-17:  # the same for all peaks
            p = offsets[0]
            starts, slopes, offsets = [0.0], [0.0], [v + (p - v) * (attack if p <= v else release)]
            continue
        values = [a * s + b for s, a, b in zip(starts, slopes, offsets)]
        k = bisect_right(values, v)  # pieces that start at or below v
        if k and slopes[k - 1] > 0:
            cross = (v - offsets[k - 1]) / slopes[k - 1]
            if cross < (starts[k] if k < len(starts) else TOP):
                starts.insert(k, cross)
                slopes.insert(k, slopes[k - 1])
                offsets.insert(k, offsets[k - 1])
        factors = [attack] * k + [release] * (len(starts) - k)
        slopes = [a * f for a, f in zip(slopes, factors)]
        offsets = [v + (b - v) * f for b, f in zip(offsets, factors)]
    return starts, slopes, offsets


def follower(df: DataFrame, attack: float, release: float, threshold: float, ratio: float, size: int = BLOCK) -> DataFrame:
    """`stream, seq, peak, y` of `stream, seq, x`, as the stream operator gives them."""
    blocks = _blocks(df, "x", size)
    kind = df.schema["stream"].dataType.simpleString()

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            maps = [peak_map(levels(np.asarray(x, float)), attack, release) for x in pdf["xs"]]
            yield pdf[["stream", "block"]].assign(**{n: [m[i] for m in maps] for i, n in enumerate(("starts", "slopes", "offsets"))})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        peak, entry = 0.0, []
        for starts, slopes, offsets in zip(pdf["starts"], pdf["slopes"], pdf["offsets"]):
            entry.append(peak)
            k = bisect_right(starts, peak) - 1
            peak = slopes[k] * peak + offsets[k]
        return pdf[["stream", "block"]].assign(entry=entry)

    def outputs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for stream, seqs, xs, entry in zip(pdf["stream"], pdf["seqs"], pdf["xs"], pdf["entry"]):
                x = np.asarray(xs, float)
                _, peaks, y = follower_step(entry, x, attack, release, threshold, ratio)
                yield pd.DataFrame({"stream": stream, "seq": seqs, "peak": peaks, "y": y})

    maps = blocks.select("stream", "block", "xs").mapInPandas(summaries, f"stream {kind}, block long, starts array<double>, slopes array<double>, offsets array<double>")
    entries = maps.groupBy("stream").applyInPandas(follow, f"stream {kind}, block long, entry double")
    return blocks.join(entries, ["stream", "block"]).select("stream", "seqs", "xs", "entry").mapInPandas(outputs, f"stream {kind}, seq long, peak double, y double")


# Classes of parser states, each with one state that stands for it. A placeholder stands for bytes that only earlier blocks know.
_LAST = {0: 0, 2: 0xC0, 3: 0x90}  # by the length of messages with that status
_PENDING = [([], 0), ([0xC0], 2), ([0xF1], 2), ([0x90], 3), ([0x90, 1], 3), ([0xF2], 3), ([0xF2, 1], 3), ([0xF0], -1), ([0xF0, 0xF0], 4), ([0xF0, 0xF0, 1], 4), ([0xF0, 1], 0)]
_STATES = [{"last": _LAST[k], "cur": list(cur), "need": need} for k, (cur, need) in product(_LAST, _PENDING)]


def _class_of(state: dict) -> int:
    cur, need = state["cur"], state["need"]
    last = 0 if not state["last"] else 1 if state["last"] & 0xE0 == 0xC0 else 2
    seen = ([], 0) if not cur else ([0xF0, 1], 0) if need == 0 else next(p for p in _PENDING if p[1] == need and len(p[0]) == len(cur) and (p[0][0] >= 0xF0) == (cur[0] >= 0xF0))
    return last * len(_PENDING) + _PENDING.index(seen)


def _steps() -> np.ndarray:
    """Class after class and byte."""
    return np.array([[_class_of(split_messages({**s, "cur": list(s["cur"])}, [(0, b)])[0]) for s in _STATES] for b in range(256)])


def running_status(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """`stream, seq, message` of `stream, seq, b`, as the stream operator gives them."""
    blocks = _blocks(df.withColumn("b", F.col("b").cast("int")), "b", size)
    kind = df.schema["stream"].dataType.simpleString()
    steps = _steps()

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ends = []
            for xs in pdf["xs"]:
                to = np.arange(len(_STATES))
                for b in xs:
                    to = steps[b][to]
                ends.append(to.tolist())
            yield pdf[["stream", "block"]].assign(ends=ends)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        at, entry = 0, []
        for ends in pdf["ends"]:
            entry.append(at)
            at = int(ends[at])
        return pdf[["stream", "block"]].assign(entry=entry)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Messages inside a block, and one row with what its neighbours need: bytes that end or continue the pending message, bytes left over, whether the last
        status before still holds."""
        for pdf in frames:
            for stream, block, seqs, xs, entry in zip(pdf["stream"], pdf["block"], pdf["seqs"], pdf["xs"], pdf["entry"]):
                state, old = {**_STATES[entry], "cur": list(_STATES[entry]["cur"])}, len(_STATES[entry]["cur"])
                rows, head, head_end, status, data = [], b"", -1, -1, list(zip(map(int, seqs), map(int, xs)))
                if old:
                    for k, pair in enumerate(data):
                        state, done = split_messages(state, [pair])
                        if done or k == len(data) - 1:
                            head, head_end = bytes(x for _, x in data[: k + 1]), pair[0] if done else -1
                            data = data[k + 1 :]
                            break
                    whole = head_end >= 0
                    status = -2 if whole and _STATES[entry]["cur"][0] < 0xF0 else -1  # -2: that of the pending message, -1: as before
                known, open_unsure, pending_done = False, False, not old or head_end >= 0
                if pending_done:
                    for pair in data:
                        fresh = not state["cur"]
                        implied = fresh and pair[1] < 0x80 and bool(state["last"])
                        unsure = implied and not known
                        state, done = split_messages(state, [pair])
                        if fresh and state["cur"] or done and fresh:
                            open_unsure = unsure
                        for seq, m in done:
                            rows.append((stream, block, seq, bytes(m[1:] if open_unsure else m), open_unsure, "message", -1))
                            if m[0] < 0xF0 and not open_unsure:
                                known, status = True, m[0]
                    tail_unsure = bool(state["cur"]) and open_unsure
                    tail = bytes(state["cur"][1:] if tail_unsure else state["cur"])
                else:
                    tail, tail_unsure = b"", False
                rows.append((stream, block, head_end, head, bool(old), "head", status))
                rows.append((stream, block, -1, tail, tail_unsure, "tail" if state["cur"] and pending_done else "none", status))
                yield pd.DataFrame(rows, columns=["stream", "block", "seq", "raw", "implied", "part", "status"])

    def join_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        """Messages across blocks, and the status that implied bytes of each block have."""
        heads = pdf[pdf["part"] == "head"].sort_values("block", ignore_index=True)
        tails = pdf[pdf["part"] != "head"].sort_values("block", ignore_index=True)
        last, pending, out = 0, b"", []
        for (_, h), (_, t) in zip(heads.iterrows(), tails.iterrows()):
            if h["implied"]:
                pending += h["raw"]
                if h["seq"] >= 0:
                    out.append((h["stream"], h["block"], h["seq"], pending, "message", 0))
                    last = pending[0] if pending[0] < 0xF0 else last
                    pending = b""
            out.append((h["stream"], h["block"], -1, b"", "status", last))
            if t["part"] == "tail":
                pending = (bytes([last]) if t["implied"] else b"") + t["raw"]
            if t["status"] >= 0:
                last = t["status"]
        return pd.DataFrame(out, columns=["stream", "block", "seq", "raw", "part", "status"])

    ends = blocks.select("stream", "block", "xs").mapInPandas(summaries, f"stream {kind}, block long, ends array<int>")
    entries = ends.groupBy("stream").applyInPandas(follow, f"stream {kind}, block long, entry int")
    parsed = blocks.join(entries, ["stream", "block"]).mapInPandas(parse, f"stream {kind}, block long, seq long, raw binary, implied boolean, part string, status int")
    parsed = materialize(parsed, "parsed")
    across = materialize(parsed.filter("part <> 'message'").groupBy("stream").applyInPandas(join_ends, f"stream {kind}, block long, seq long, raw binary, part string, status int"), "across")
    status = across.filter("part = 'status'").select("stream", "block", F.lpad(F.lower(F.hex("status")), 2, "0").alias("_last"))
    digits = F.lower(F.hex("raw"))
    inside = parsed.filter("part = 'message'").join(status, ["stream", "block"])
    inside = inside.select("stream", "seq", F.when(F.col("implied"), F.concat("_last", digits)).otherwise(digits).alias("message"))
    return inside.unionByName(across.filter("part = 'message'").select("stream", "seq", digits.alias("message")))
