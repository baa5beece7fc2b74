"""Quality rules, decontamination, sharding and tool calls against plain versions."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigframe.llm import quality_rules, tool_calls
from sigframe.llm.decontaminate import contained
from sigframe.llm.queries import TOOLS, tool_messages
from sigframe.llm.quality_rules import apply_rules
from sigframe.llm.sharding import interleave
from tests.llm.conftest import SMALL, clashing


def plain_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def plain_rules(rows):
    """(doc_id, text, lang, source) -> counts, squared distance, by the module's own definition in numpy."""
    q = quality_rules
    out, x = [plain_counts(r[1]) for r in rows], {}
    for i, (r, c) in enumerate(zip(rows, out)):
        if not c[5]:
            lines = [y for y in r[1].split("\n") if y.split()]
            v = [math.log(c[1] / c[0]), math.sqrt(c[2] / c[1]), math.sqrt(len(re.findall("[A-Z]", r[1])) / c[1]), math.sqrt(c[4] / c[0]), math.sqrt(c[3] / len(lines))]
            x[i] = [math.floor(y * q.UNIT + 0.5) if y >= 0 else -math.floor(-y * q.UNIT + 0.5) for y in v]
    levels = defaultdict(list)  # every passing row of a pair, a language, the table
    for i in x:
        for k in ((rows[i][2], rows[i][3]), (rows[i][2],), ()):
            levels[k].append(i)
    judge = lambda i: next((k for k in ((rows[i][2], rows[i][3]), (rows[i][2],), ()) if len(levels[k]) >= q.MIN_ROWS), ())
    floor = np.diag((np.array(q.FLOOR) * q.UNIT) ** 2)
    estimate = lambda m: (m.mean(0), np.cov(m.T, bias=True) + floor)

    def d2(m, mean, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (m - mean).T)
        return (y**2).sum(0)

    dist = {}
    for level in {judge(i) for i in x}:
        members = levels[level]
        m = np.array([x[i] for i in members], float)
        mid = np.median(m, 0)
        starts = [estimate(m), (mid, np.diag((np.median(np.abs(m - mid), 0) * 1.4826) ** 2) + floor)]
        for k, (mean, cov) in enumerate(starts):
            for _ in range(q.STEPS):
                bins = np.floor(np.log(d2(m, mean, cov) + 1e-9) * 64)
                cut = np.sort(bins)[math.ceil(q.SHARE * len(m)) - 1]
                mean, cov = estimate(m[bins <= cut])
            starts[k] = (mean, cov)
        mean, cov = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
        mean, cov = estimate(m[d2(m, mean, cov) / q.NEAR_FACTOR <= q.FAR_LIMIT])
        dist.update((i, d) for i, d in zip(members, d2(m, mean, cov) / q.FAR_FACTOR) if judge(i) == level)
    return [(r[0], *c, dist.get(i) if len(x) >= q.MIN_ROWS else None) for i, (r, c) in enumerate(zip(rows, out))]


def check_rules(df):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:7])
    want = sorted(plain_rules(rows), key=key)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.distance, r.kept) for r in apply_rules(df).collect()), key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for g, w in zip(got, want):
        assert (g[7] is None) == (w[7] is None) and (g[7] is None or g[7] == pytest.approx(w[7], rel=1e-6, abs=1e-6))
        assert g[8] == (not g[6] and (g[7] or 0) <= quality_rules.CUTOFF)
    return got


def test_rules_on_documents(spark):
    df = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    got = check_rules(df)
    assert any(not r[8] and not r[6] for r in got)


def test_rules_on_odd_rows(odd, none, monkeypatch):
    check_rules(clashing(odd, "words", "grp", "salt", "kept", "n_words"))
    monkeypatch.setattr(quality_rules, "MIN_ROWS", 10)
    check_rules(odd)
    assert apply_rules(none).isEmpty()


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_contained(docs, items):
    out = Counter()
    texts = {(d, t) for d, t in docs if d is not None and t is not None}
    held = {}
    for item, text in items:
        w = plain_words(text)
        width = min(5, len(w))
        if w and item is not None:
            held[item, tuple(dict.fromkeys(tuple(w[i : i + width]) for i in range(len(w) - width + 1)))] = width
    for (item, grams), width in held.items():
        for doc_id, doc in texts:
            d = plain_words(doc)
            both = set(grams) & {tuple(d[i : i + width]) for i in range(len(d) - width + 1)}
            if 5 * len(both) >= 4 * len(grams):
                out[doc_id, item, len(grams), len(both)] += 1
    return out


def test_containment(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    run = lambda d, b: Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contained(d, b).collect())
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = run(docs, bench)
    assert got == plain_contained(texts, items) and got
    long_text = next(r.text for r in odd.collect() if r.doc_id == 14)
    w = long_text.split()
    near = w[100:140]
    near[20] = "other"
    own = [(1, " ".join(w[500:540])), (2, " ".join(near)), (3, "one"), (4, "Same, SAME"), (5, ""), (6, None), (None, "one"), (7, " ".join(w[:20] + ["x"] * 20)), (8, "日本語"), (9, " ".join(w[2:4]))]
    b = clashing(spark.createDataFrame(own, "item_id long, text string"), "hash", "shingles", "width")
    d = clashing(odd, "item_id", "words", "own")
    want = plain_contained([(r.doc_id, r.text) for r in odd.collect()], own)
    assert run(d, b) == want and {(14, 1), (14, 2), (8, 3), (10, 4), (9, 8), (14, 9)} <= {w[:2] for w in want}
    assert run(none, b) == Counter() == run(d, b.filter("false"))


def test_containment_with_shared_ids(spark):
    word = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    items = [(1, word(0, 14)), (1, word(100, 14)), (2, word(200, 9)), (2, word(200, 9)), (None, word(0, 14))]
    half = f"{word(0, 9)} x {word(100, 9)}"
    docs = [(5, half), (6, word(0, 9)), (6, word(5, 9)), (7, word(0, 14)), (7, word(95, 25)), (7, word(95, 25)), (8, word(200, 9)), (None, word(0, 14))]
    got = contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect())
    assert found == plain_contained(docs, items) == Counter({(7, 1, 10, 10): 2, (8, 2, 5, 5): 1})


def test_containment_without_broadcast(spark, docs, monkeypatch):
    from sigframe.llm import decontaminate

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = sorted(map(tuple, contained(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert sorted(map(tuple, contained(docs, bench).collect())) == want


def plain_shards(rows, shards=24):
    """rows: (doc_id, source, text)."""
    per = Counter(r[1] for r in rows)
    low = lambda v: (v is not None, v if v is not None else 0)
    named = []
    for doc_id, source, text in rows:
        raw = (text or "").encode()
        order = hashlib.md5(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        named.append(((source is not None, source or ""), order, low(doc_id), len(raw) + 8, zlib.crc32(raw), source, doc_id))
    named.sort()
    seen, placed = Counter(), []
    for r in named:
        placed.append(((seen[r[5]] + 0.5) / per[r[5]], *r))
        seen[r[5]] += 1
    placed.sort()
    total, first, out = len(placed), {}, []
    for i, r in enumerate(placed):
        shard = i * shards // total
        out.append((r[7], r[4], r[5], shard, i - first.setdefault(shard, i)))
    return out


def test_shards(docs, odd, none):
    for df in (docs, clashing(odd, "rank", "place", "part", "total", "order")):
        rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
        got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in interleave(df).collect()]
        assert Counter(got) == Counter(plain_shards(rows))
        size = Counter(r[3] for r in got)
        assert max(size.values()) - min(size.get(s, 0) for s in range(24)) <= 1
    assert interleave(none).isEmpty()


def test_shards_match_the_mixture(docs):
    rows = interleave(docs, shards=4).groupBy("shard", "source").count().collect()
    per, share = defaultdict(dict), Counter()
    for r in rows:
        per[r.source][r.shard] = r["count"]
        share[r.source] += r["count"]
    for source, n in share.items():
        assert all(abs(per[source].get(s, 0) - n / 4) <= 1.5 for s in range(4))


def plain_links(calls, results):
    """Statuses of all rows, and for each conversation the order constraints."""
    low = lambda v: (v is not None, v if v is not None else "")
    by_id, out = defaultdict(list), Counter()
    for c in calls:
        if c[0] is None or c[2] is None:
            out[c[0], c[2], "no result"] += 1
        else:
            by_id[c[0], c[2]].append(c)
    got = defaultdict(list)
    for r in results:
        if r[0] is not None and r[2] is not None and (r[0], r[2]) in by_id:
            got[r[0], r[2]].append(r)
        else:
            out[r[0], r[2], "orphan result"] += 1
    for k, cs in by_id.items():
        out[(*k, "linked" if got[k] else "no result")] += 1
        if len(cs) > 1:
            out[(*k, "duplicate call")] += len(cs) - 1
        if len(got[k]) > 1:
            out[(*k, "further result")] += len(got[k]) - 1
    return out, {k: min(cs, key=lambda c: (low(c[1]), low(c[3]), low(c[4]))) for k, cs in by_id.items()}, {k: min(v, key=lambda r: (low(r[1]), low(r[3]))) for k, v in got.items() if v}


def check_links(calls, results, tools):
    rows = [tuple(r) for r in calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on").collect()]
    answers = [tuple(r) for r in results.select("conv_id", "turn", "call_id", "content").collect()]
    got = tool_calls.link(calls, results, tools).collect()
    want, first, answer = plain_links(rows, answers)
    assert Counter((r.conv_id, r.call_id, r.status) for r in got) == want and len(got) == len(rows) + len(answers) - len(answer)
    place = {(r.conv_id, r.call_id): r for r in got if r.position is not None}
    assert place.keys() == first.keys()
    per = defaultdict(list)
    for (conv, _), r in place.items():
        per[conv].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in per.values())
    for k, r in place.items():
        made = json.loads(r.json)
        assert tool_calls.canonical(made) == r.json
        assert "\\ud" in r.json or json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
        assert made.get("result") == (answer[k][3] if k in answer else None) and made["id"] == k[1]
        if "dependency cycle" not in r.errors:
            for dep in set(filter(None, first[k][5] or [])):
                assert place[k[0], dep].position < r.position if (k[0], dep) in first else f"unknown dependency {dep}" in r.errors
    return got


def test_tool_calls_of_conversations(spark):
    calls, results = tool_messages(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    got = check_links(calls, results, TOOLS)
    said = " ".join(x for r in got for x in r.errors)
    for word in ("not JSON", "unknown tool", "above maximum", "not in enum", "unknown dependency"):
        assert word in said


def test_tool_calls_odd(spark):
    kind = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, status string"
    rows = [
        (1, 0, "a", "t", '{"b": 1.0, "a": [true, null, "é\\ud800"]}', ["b"], "x"),
        (1, 1, "b", "t", '{"a": 1, "a": 2}', ["c"], "x"),
        (1, 2, "c", "t", "[" * 5000 + "]" * 5000, None, "x"),
        (1, 3, "d", "t", "NaN", ["e", None], "x"),
        (1, 4, "e", "t", "{}", ["d"], "x"),
        (1, 4, "f", None, None, ["e", "zz"], "x"),
        (1, 4, "g", "t", "{}", ["g"], "x"),
        (1, None, "h", "t", "{}", [], "x"),
        (1, 9, "a", "t", "{}", [], "x"),
        (1, 9, "a", "t", "{}", [], "x"),
        (None, 1, "n", "t", "{}", [], "x"),
        (2, 1, None, "t", "{}", [], "x"),
    ]
    calls = spark.createDataFrame(rows + [(7, i, f"k{i}", "t", "{}", [f"k{i - 1}"], "x") for i in range(600)], kind)
    results = spark.createDataFrame([(1, 5, "a", "r1"), (1, 4, "a", "r0"), (1, 4, "a", "r0"), (1, 1, "zz", None), (None, 1, "a", "x"), (1, 1, None, "y"), (1, 1, "b", None)], "conv_id long, turn long, call_id string, content string")
    got = check_links(calls, results, {"t": {"type": "object"}})
    cycles = {r.call_id for r in got if "dependency cycle" in r.errors}
    assert cycles == {"d", "e", "f", "g"}
    a = next(r for r in got if r.call_id == "a" and r.status == "linked")
    assert '"arguments":{"a":[true,null,"é\\ud800"],"b":1}' in a.json and '"result":"r0"' in a.json
    assert tool_calls.link(calls.filter("false"), results.filter("false"), {}).isEmpty()


def test_long_chain_takes_few_jobs(spark):
    kind = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
    calls = spark.createDataFrame([(1, 5000 - i, f"k{i}", "t", "{}", [f"k{i - 1}"] if i else []) for i in range(5000)], kind)
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = tool_calls.link(calls, results, {"t": {}}).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {int(r.call_id[1:]): r.position for r in got} == {i: i for i in range(5000)}
    stages = {s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    assert len(jobs) < 60 and stages


def test_rounds_equal_the_local_order(spark, monkeypatch):
    r = random.Random(9)
    kind = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
    rows = [(c, r.choice([None, *range(12)]), f"k{i}", "t", "{}", [f"k{r.randint(0, 26)}" for _ in range(r.choice([0, 0, 1, 1, 2]))]) for c in range(12) for i in range(25)]
    calls, results = spark.createDataFrame(rows, kind), spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    local = check_links(calls, results, {"t": {}})
    monkeypatch.setattr(tool_calls, "LOCAL", 0)
    assert sorted(map(tuple, local), key=str) == sorted(map(tuple, check_links(calls, results, {"t": {}})), key=str)
    assert any("dependency cycle" in r.errors for r in local) and any("dependency cycle" not in r.errors and json.loads(r.json)["depends_on"] for r in local)


def test_arguments_that_break_parsers(spark):
    texts = ['{"b":1e400}', '{"b":-1e400}', '{"a":' + "9" * 400 + "}", '{"a":' + "9" * 5000 + "}", '{"\\ud800":1}', '{"c":"\\udc00"}', "[" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000, '{"b":1e-7}', "\x00", '"\\u0000"', "{" * 9, "", None, '{"a":1}x', '{"b":-0.0}', "1e999", "Infinity"]
    kind = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
    calls = spark.createDataFrame([(1, i, f"k{i}", "t", t, None) for i, t in enumerate(texts)], kind)
    tools = {"t": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "c": {"type": "string"}}, "additionalProperties": False}}
    got = {r.turn: r for r in tool_calls.link(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), tools).collect()}
    for i in (0, 1, 3, 6, 16, 17):
        assert any("not JSON" in e for e in got[i].errors) and '"arguments":null' in got[i].json
    assert not got[2].errors and got[4].errors == ["$.\\ud800: not allowed"] and '"b":1e-7' in got[8].json and '"b":0' in got[15].json


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(st.characters(), max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(), max_size=3), x, max_size=3), max_leaves=8), st.booleans())
@settings(max_examples=150, deadline=None)
def test_any_json_gives_a_row(value, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    tools = {"t": {"type": ["object", "array", "integer", "number", "string"], "minimum": 2, "maxLength": 3, "items": {"type": "integer"}, "properties": {"a": {"enum": [1]}}, "additionalProperties": False}}
    names = ["conv_id", "call_id", "turn", "position", "status", "name", "arguments", "depends_on", "has_result", "content", "found"]
    try:
        text.encode()
    except UnicodeEncodeError:  # no such text comes out of Spark
        text = json.dumps(value)
    row = pa.record_batch([pa.array([x]) for x in (1, "a", 1, 1, "linked", "t", text)] + [pa.array([None], pa.list_(pa.string())), pa.array([False]), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.string()))], names)
    (out,) = tool_calls._written(tools)(iter([row]))
    made = json.loads(out.column("json")[0].as_py())
    if not any("not JSON" in e for e in out.column("errors")[0].as_py()):
        asfloat = lambda t: json.loads(t, parse_int=float)
        assert asfloat(out.column("json")[0].as_py())["arguments"] == asfloat(text) and tool_calls.canonical(made) == out.column("json")[0].as_py()


def test_numbers_have_the_shortest_form():
    for x, text in ((1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-1.5e-9, "-1.5e-9"), (0.1, "0.1"), (1.5e300, "1.5e+300"), (-0.0, "0"), (100.0, "100"), (12.5, "12.5")):
        assert tool_calls.canonical(x) == text and float(text) == x


def test_schema_rules():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "maxLength": 2}, "c": {"items": {"enum": [1, "x"]}}}, "additionalProperties": False}
    assert tool_calls.violations({"a": 1.0, "b": None, "c": [1, "x"]}, schema) == []
    assert tool_calls.violations({"a": True}, schema) == ["$.a: not of type integer"]
    assert tool_calls.violations({"a": -1, "b": "abc", "c": [True], "d": 1}, schema) == ["$.a: below minimum", "$.b: too long", "$.c[0]: not in enum", "$.d: not allowed"]
    assert tool_calls.violations({}, schema) == ["$.a: missing"] and tool_calls.violations([], schema) == ["$: not of type object"]
    assert tool_calls.canonical({"דּ": 1, "\U0001f600": 2.5, "a": [1e3, -0.0]}) == '{"a":[1000,0],"\U0001f600":2.5,"דּ":1}'


def plain_texts(n, seed, odd=0):
    """Texts of 60 to 90 words; the last `odd` have many symbols."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    out = [[word() for _ in range(r.randint(60, 90))] for _ in range(n)]
    return [" ".join(w if i < n - odd else [x + "#$%&" for x in w]) for i, w in enumerate(out)]


def judged(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return {r.doc_id: r for r in apply_rules(df).collect()}


def test_rows_of_small_groups_are_judged_by_all_rows_of_the_next_level(spark):
    big = [(t, "en", "a") for t in plain_texts(150, 1)]
    rare = [(t, "en", f"s{i}") for i, t in enumerate(plain_texts(4, 2, odd=2))] + [(plain_texts(1, 3, odd=1)[0], "en", None)]
    foreign = [(t, lang, None) for t, lang in zip(plain_texts(4, 4, odd=2), [None, "de", "de", None])]
    got = judged(spark, big + rare + foreign)
    kept = [got[150 + i].kept for i in range(9)]
    assert kept == [True, True, False, False, False, True, True, False, False]
    assert all(got[i].distance is not None for i in got)


def test_only_rows_past_the_limits_make_a_group_large(spark):
    big = [(t, "en", "a") for t in plain_texts(150, 1)]
    short = [("too short", "en", "b")] * 120
    got = judged(spark, big + short + [(t, "en", "b") for t in plain_texts(2, 5, odd=1)])
    assert got[270].kept and not got[271].kept and not got[200].kept and got[200].distance is None


def plain_levels(rows):
    """plain_rules with every group fitted on all its rows past the limits: each level made the only one by blanking the columns below it."""
    levels = [rows, [(*r[:3], None) for r in rows], [(*r[:2], None, None) for r in rows]]
    ok = [not plain_counts(r[1])[5] for r in rows]
    sizes = [Counter(r[2:] for r, k in zip(level, ok) if k) for level in levels]
    judge = [next((k for k in (0, 1) if sizes[k][levels[k][i][2:]] >= quality_rules.MIN_ROWS), 2) for i in range(len(rows))]
    found = [plain_rules(level) for level in levels]
    return [found[k][i] for i, k in enumerate(judge)]


def test_rules_by_levels(spark, odd, monkeypatch):
    small = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    for df, least in ((small, 30), (odd, 10)):
        monkeypatch.setattr(quality_rules, "MIN_ROWS", least)
        key = lambda r: (r[0] is None, r[0] or 0, r[1:6])
        want = sorted(plain_levels([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]), key=key)
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.distance) for r in apply_rules(df).collect()), key=key)
        assert [g[:7] for g in got] == [w[:7] for w in want]
        assert [g[7] for g in got] == [w[7] if w[7] is None else pytest.approx(w[7], rel=1e-6, abs=1e-6) for w in want]


def test_arguments_hold_the_whole_text(spark):
    texts = [" ".join(f"{i}w{k}" for k in range(200)) for i in range(40)]
    rows = [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    calls, results = tool_messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    names = set()
    for r in calls.collect():
        made = json.loads(r.arguments if r.arguments.endswith("}") else r.arguments + "}")
        assert texts[r.conv_id] in (made.get("query"), made.get("of"), " ".join(made.get("words", [])))
        names.add(r.name)
    assert set(TOOLS) <= names
    parsed = [r for r in tool_calls.link(calls, results, TOOLS).collect() if not any("not JSON" in e for e in r.errors)]
    assert len(parsed) >= 30 and all(w in r.json for r in parsed for w in texts[r.conv_id].split())
