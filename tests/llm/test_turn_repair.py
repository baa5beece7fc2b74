"""Conversation repair against a plain version that tries every edit in one table of costs and letters."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from sigframe.llm import turn_repair as op
from tests.llm.conftest import SMALL, clashing

SCHEMA = "conv_id long, turn long, role string, text string"
W = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out, s = [], lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        h, role, text = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20, s(role), s(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Forward over the rows: for each role before, the cheapest and then least letters, with the result they give."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(W)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", [])}

    def better(table, q, way):
        if q not in table or way[:2] < table[q][:2]:
            table[q] = way

    def inserted(table):
        for _ in range(4):
            for q, (cost, letters, out) in list(table.items()):
                better(table, NEXT[q], (cost + 5, letters + "I", [*out, (NAME[NEXT[q]], "")]))
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        table = {}
        for q, (cost, letters, out) in inserted(dict(best)).items():
            better(table, q, (cost + 2, letters + "D", out))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if role[:1] and (role[:1] == NEXT[q] or q == "" and role[:1] == "s"):
                    better(table, role[:1], (cost + more, letters + "K", [*out, (role, text)]))
                better(table, NEXT[q], (cost + 1 + more, letters + "R", [*out, (NAME[NEXT[q]], text)]))
        best = table
    ends = [best[q] for q in ("", "a") if q in best]
    for q, n in (("u", 1), ("s", 2)):
        if q in best:
            cost, letters, out = best[q]
            ends.append((cost + 5 * n, letters + "I" * n, out + [("user", ""), ("assistant", "")][-n:]))
    cost, audit, out = min(ends, key=lambda w: w[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{a}:{b}" for a, b in out)
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def check(df, damage=True):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    convs = {r[0] for r in rows}
    rows = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: plain_repair([r for r in rows if r[0] == c]) for c in convs}
    args = op.damage(df) if damage else (df, None)
    got = op.report(*args).collect()
    assert len(got) == len(convs) and {r.conv_id: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()}
    out = {}
    for r in op.repaired(*args).orderBy("conv_id", "at").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    assert out == {c: w[1] for c, w in want.items() if w[1]}
    return {r.conv_id: r for r in got}


def everything(rows, most):
    """The answer by trying all letters and all places, for very short conversations."""
    found = []
    for letters in (x for n in range(most + 1) for x in product("DIKR", repeat=n)):
        i, q, cost, ok = 0, "", 0, True
        for x in letters:
            if x == "I":
                q, cost = NEXT[q], cost + 5
                continue
            if i == len(rows):
                ok = False
                break
            (first, fault), i = rows[i], i + 1
            if x == "D":
                cost += 2
            elif fault in (op.BLANK, op.DUPLICATE) or x == "K" and first != NEXT[q] and not (q == "" and first == "s"):
                ok = False
                break
            else:
                q, cost = first if x == "K" else NEXT[q], cost + (x == "R") + 5 * (fault == op.CUT)
        if ok and i == len(rows) and q in ("", "a"):
            found.append((cost, "".join(letters)))
    return min(found)


def test_search_finds_the_least_of_all_sequences():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suat "), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 4))]
        assert op.cheapest(rows, op.START, op.END) == everything(rows, 6)


def test_given_conversations(spark):
    check(spark.read.parquet(f"{SMALL}/conversations.parquet"))


def odd():
    r = random.Random(6)
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünder"])
    text = lambda: r.choice(["Yes.", "No!", "Why?", "cut", "", " \n", None, "Yes.  \n", "ends ö", "日本。", f"{r.random()}.", f"{r.random()}.", f"{r.random()}"])
    rows = [(c, t, role(), text()) for c in range(1, 60) for t in range(r.randint(1, 9))]
    rows += [(None, r.choice([None, 1, 2, 9]), role(), text()) for _ in range(30)]
    rows += [(70, r.choice([None, -5, 3]), role(), text()) for _ in range(30)] + [(71, None, "user", "Same.")] * 30 + [(72, 5, "user", "x" * 300_000 + "."), (72, 6, "assistant", " " * 100_000)]
    rows += [(73, -(2**63), "user", "A."), (73, 2**63 - 1, "assistant", "B."), (74, 2, "assistant", "only."), (75, 0, "system", "only.")]
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows(spark, damage):
    df = spark.createDataFrame(odd(), SCHEMA)
    got = check(clashing(df, "copies", "h", "digest", "letters", "fault").repartition(4), damage)
    if not damage:
        assert got[71].audit == "D" * 30 and got[71].duplicate == 29 and got[73].gaps == 2**63 - 1


def test_long_conversations_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    rows = [(1, t, "user" if t % 2 else "assistant", f"{r.choice(['Right', 'Wrong', t])}{r.choice('.!?.!?,')}") for t in range(1500) if r.random() > 0.05]
    rows += [(2, t // 3, r.choice(["user", "assistant", "system"]), f"{t % 50}.") for t in range(400)] + [(3, t, "user", "Hm.") for t in range(500)]
    rows += [(c, t, r.choice(["user", "assistant"]), f"{t}.") for c in range(4, 30) for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df)
    spans = op.edits(op._keyed(df, None)).select("conv_id").groupBy("conv_id").count()
    assert {x.conv_id: x["count"] for x in spans.collect()}[1] > 1000
    monkeypatch.setattr(op, "BLOCK", 3)
    check(df.filter("conv_id <> 1 or turn < 200"))


def test_dropped_and_no_rows(spark):
    lone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = check(spark.createDataFrame([(c, 0, "user", "Hm.") for c in lone], SCHEMA))
    assert all(tuple(r)[1:] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for r in got.values()) and len(got) == 3
    none = spark.createDataFrame([], SCHEMA)
    assert op.report(*op.damage(none)).collect() == [] and op.repaired(none).collect() == []


def test_other_id_types(spark):
    df = spark.createDataFrame(odd()[:200], SCHEMA).withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    check(df)
