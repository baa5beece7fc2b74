"""Tool-call linking: join calls and results by identifier, order calls topologically, validate arguments, write canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). A call's order key is (turn, hops): the greatest of its own turn and the
keys of the calls that it depends on, one hop further. Conversations of at most `LOCAL` calls are ordered one after the other inside tasks, calls without open
dependencies first; what is left lies on a cycle or behind one, is marked and stays at its own turn. Larger conversations give the same by rounds of joins, in which every call
is raised behind its dependencies until nothing changes; after 4, 8, 16, ... rounds the calls that have changed are searched for cycles. Positions are counted per conversation in blocks of turns, so a
conversation with a third of all rows is spread like any other; no task gathers more than `LOCAL` calls.

Arguments are checked against the tool's schema (type, enum, minimum, maximum, minLength, maxLength, items, properties, required,
additionalProperties; other words of a schema are ignored) and each call is written as canonical JSON: keys sorted by UTF-16 code units, no spaces, numbers
with the shortest digits in the form of ECMAScript, integers in full. Text that is no JSON, numbers beyond the range of a double, integers of more than 4300 digits,
repeated keys and too deep nesting are errors of their row; its arguments are then written as null.

Every call gives one row, which also holds its result; every other result gives one. Statuses:
  linked, no result        calls
  duplicate call           a later call with a known identifier; it is not linked and has no position
  orphan result            a result whose identifier no call has
  further result           a result beyond the first of its call (by turn, then content)
Null identifiers never match: such a call has no result, such a result is an orphan. A null turn sorts first. Problems with
arguments, dependencies and order are listed in `errors`, never dropped.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigframe.llm.sharding import numbered
from sigframe.session import materialize

BLOCK = 256
LOCAL = 10_000  # calls of a conversation that one task may order
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _escaped(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, written as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _quoted(text: str) -> str:
    return _escaped(json.dumps(text, ensure_ascii=False))


def canonical(value: Any) -> str:
    """Canonical JSON text of a parsed value."""
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, dict):
        inside = (f"{_quoted(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")))
        return "{" + ",".join(inside) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _decimal(value)
    return json.dumps(value)


def _decimal(value: float) -> str:
    """The shortest digits that give the number, without an exponent from 1e-6 to below 1e21, else as in 1e-7 or 1.5e+21."""
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if not value:
        return "0"
    if 0 < point <= 21:
        text = text.ljust(point, "0")
        text = text[:point] + ("." + text[point:] if text[point:] else "")
    elif -6 < point <= 0:
        text = "0." + "0" * -point + text
    else:
        text = text[0] + ("." + text[1:] if text[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + text


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind])


def violations(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """What in `value` breaks `schema`."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def _strict(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _bad_number(text: str) -> None:
    raise ValueError(f"not a JSON number: {text}")


def _finite(text: str) -> float:
    if math.isinf(value := float(text)):
        raise ValueError("number out of range")
    return value


def _written(tools: dict[str, dict[str, Any]]):
    """Rows of a call and its result -> errors and canonical JSON."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts = [], []
            for call_id, name, arguments, depends_on, has_result, content, found in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "depends_on", "has_result", "content", "found"))):
                wrong, value = list(found or []), None
                try:
                    value = json.loads(arguments or "null", object_pairs_hook=_strict, parse_constant=_bad_number, parse_float=_finite)
                except (ValueError, RecursionError) as e:
                    wrong.append(f"$: not JSON ({str(e)[:60]})")
                else:
                    wrong += [_escaped(x) for x in violations(value, tools[name])] if name in tools else ["unknown tool"]
                record = {"arguments": value, "depends_on": sorted(set(filter(None, depends_on or []))), "id": call_id, "name": name}
                if has_result:
                    record["result"] = content
                try:
                    text = canonical(record)
                except RecursionError:
                    wrong.append("$: nested too deeply")
                    text = canonical(record | {"arguments": None})
                errors.append(wrong)
                texts.append(text)
            kept = [batch.column(c) for c in ("conv_id", "call_id", "turn", "position", "status")]
            yield pa.record_batch([*kept, pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], ["conv_id", "call_id", "turn", "position", "status", "errors", "json"])

    return write


def _topological(calls: dict[str, tuple[int, list[str]]]) -> dict[str, tuple[int, int, bool]]:
    """(at, hop, tied) of the calls of one conversation, from their turns and the known calls they depend on."""
    behind: dict[str, list[str]] = {c: [] for c in calls}
    for c, (_, needs) in calls.items():
        for d in needs:
            behind[d].append(c)
    open_needs = {c: len(needs) for c, (_, needs) in calls.items()}
    ready = [c for c, n in open_needs.items() if not n]
    key = {c: (turn, 0) for c, (turn, _) in calls.items()}
    for c in ready:  # grows while it is read
        at, hop = key[c]
        for b in behind[c]:
            key[b] = max(key[b], (at, hop + 1))
            open_needs[b] -= 1
            if not open_needs[b]:
                ready.append(b)
    done = set(ready)
    return {c: (*key[c], False) if c in done else (calls[c][0], 0, True) for c in calls}


def _ordered_locally(kind: pa.DataType):
    """Orders one conversation after another; its rows follow each other."""
    names = ["conv_id", "call_id", "at", "hop", "tied"]
    kinds = [kind, pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def out(conv: Any, calls: dict) -> pa.RecordBatch:
        rows = [(conv, c, *x) for c, x in _topological(calls).items()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, calls, ready = None, {}, []
        for batch in batches:
            for r in batch.to_pylist():
                if calls and r["conv_id"] != conv:
                    ready.append(out(conv, calls))
                    calls = {}
                conv = r["conv_id"]
                calls[r["call_id"]] = (r["turn"], r["needs"] or [])
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if calls:
            yield out(conv, calls)

    return run


def _knots(deps: DataFrame, calls: DataFrame) -> DataFrame:
    """Those of `calls` that lie on a cycle among them or behind one: what is left when calls that depend on none of the rest go,
    again and again."""
    keys = ["conv_id", "call_id"]
    left, n = materialize(calls, "knots"), -1
    while n:
        inner = deps.join(left.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]).select(*keys).distinct()
        rest = materialize(left.join(inner, keys, "left_semi"), "knots")
        n = left.join(rest, keys, "left_anti").count()
        left = rest
    return left


def _ordered_by_rounds(calls: DataFrame, deps: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, hop, tied) for conversations of any size."""
    keys = ["conv_id", "call_id"]
    order = materialize(calls.select(*keys, "turn", F.col("turn").alias("at"), F.lit(0).cast("long").alias("hop"), F.lit(False).alias("moved"), F.lit(False).alias("ever"), F.lit(False).alias("tied")), "order")
    rounds, look = 0, 4
    while True:
        ahead = order.select("conv_id", F.col("call_id").alias("dep"), F.struct("at", (F.col("hop") + 1).alias("hop")).alias("after"))
        most = deps.join(ahead, ["conv_id", "dep"]).groupBy(*keys).agg(F.max("after").alias("after"))
        now = F.struct("at", "hop")
        step = order.join(most, keys, "left").withColumn("moved", F.coalesce(~F.col("tied") & (F.col("after") > now), F.lit(False)))
        new = F.when(F.col("moved"), F.col("after")).otherwise(now)
        order = materialize(step.select(*keys, "turn", new["at"].alias("at"), new["hop"].alias("hop"), "moved", (F.col("ever") | F.col("moved")).alias("ever"), "tied"), "order")
        rounds += 1
        if order.filter("moved").isEmpty():
            break
        if rounds == look:
            look *= 2
            knot = _knots(deps, order.filter("ever and not tied").select(*keys)).withColumn("is_knot", F.lit(True))
            tied = F.col("tied") | F.coalesce("is_knot", F.lit(False))
            order = order.join(knot, keys, "left").withColumn("tied", tied).drop("is_knot")
            order = order.withColumns({"at": F.when(F.col("tied"), F.col("turn")).otherwise(F.col("at")), "hop": F.when(F.col("tied"), F.lit(0)).otherwise(F.col("hop"))})
            order = materialize(order, "order")
    front = order.filter("tied").select("conv_id", F.col("call_id").alias("dep"))
    while not front.isEmpty():  # what is behind a cycle but was never raised by it
        more = deps.join(front, ["conv_id", "dep"], "left_semi").select(*keys).distinct().withColumn("more", F.lit(True))
        order = materialize(order.join(more, keys, "left").withColumn("more", F.coalesce("more", F.lit(False)) & ~F.col("tied")), "order")
        front = order.filter("more").select("conv_id", F.col("call_id").alias("dep"))
        order = order.withColumn("tied", F.col("tied") | F.col("more")).drop("more")
    own = F.struct(F.col("turn").alias("at"), F.lit(0).cast("long").alias("hop"))
    place = F.when(F.col("tied"), own).otherwise(F.struct("at", "hop"))
    return order.select(*keys, place["at"].alias("at"), place["hop"].alias("hop"), "tied")


def _ordered(calls: DataFrame) -> DataFrame:
    """Adds `at` (turn), `hop` and `found` (errors of dependencies and order) to calls with distinct identifiers."""
    keys = ["conv_id", "call_id"]
    deps = calls.select(*keys, F.explode("depends_on").alias("dep")).filter("dep is not null").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("is_known"))
    deps = materialize(deps.join(known, ["conv_id", "dep"], "left"), "dependencies")
    none = F.array().cast("array<string>")
    said = F.concat(F.lit("unknown dependency "), "dep")
    needs = deps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("is_known").isNull(), said))).alias("lost"), F.collect_list(F.when(F.col("is_known"), F.col("dep"))).alias("needs"))
    slim = calls.select(*keys, F.coalesce("turn", F.lit(-1).cast("long")).alias("turn")).join(needs, keys, "left")
    slim = materialize(slim, "slim")
    large = materialize(slim.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LOCAL).select("conv_id"), "large")
    kind = slim.schema["conv_id"]
    small = slim.join(large, "conv_id", "left_anti").select(*keys, "turn", "needs").repartition("conv_id").sortWithinPartitions("conv_id")
    order = small.mapInArrow(_ordered_locally(to_arrow_type(kind.dataType)), f"conv_id {kind.dataType.simpleString()}, call_id string, at long, hop long, tied boolean")
    if not large.isEmpty():
        order = order.unionByName(_ordered_by_rounds(slim.join(large, "conv_id", "left_semi"), deps.filter("is_known").select(*keys, "dep").join(large, "conv_id", "left_semi")))
    tied = F.when(F.col("tied"), F.array(F.lit("dependency cycle"))).otherwise(none)
    out = calls.join(order, keys).join(needs.select(*keys, "lost"), keys, "left")
    return out.withColumn("found", F.concat(F.coalesce("lost", none), tied)).drop("lost", "tied")


def _split(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first row of each identifier (in the order of the other columns), the others, and the rows without an identifier.

    Copies are counted first and the first row is a combinable minimum, so an identifier with a third of all rows is no hot window."""
    rest = [c for c in rows.columns if c not in keys]
    whole = " and ".join(f"{k} is not null" for k in keys)
    named = materialize(rows.filter(whole).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "copies")
    least = named.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least"))
    marked = materialize(named.join(least, keys).withColumn("is_first", F.struct(*rest).eqNullSafe(F.col("least"))).drop("least"), "marked")
    first = marked.filter("is_first").select(*rows.columns)
    more = F.col("copies") - F.col("is_first").cast("long")
    others = marked.filter(more > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), more))).select(*rows.columns)
    return first, others, rows.filter(f"not ({whole})")


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, Any]]) -> DataFrame:
    """`calls`: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of identifiers); `results`: conv_id, turn,
    call_id, content; `tools`: schema of each tool's arguments. Returns conv_id, call_id, turn, position (of linked and waiting
    calls, gapless from 0 in a conversation), status, errors, json."""
    keys = ["conv_id", "call_id"]
    turn = F.col("turn").cast("long").alias("turn")
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), turn, "name", "arguments", "depends_on")
    results = results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), turn, F.col("content").cast("string").alias("content"))
    first, again, nameless = _split(calls, keys)
    answer, further, loose = _split(results, keys)
    linked = answer.withColumn("has_result", F.lit(True)).drop("turn")
    known = first.select(*keys, F.lit(True).alias("is_call"))
    answered = answer.join(known, keys, "left").filter("is_call is null").drop("is_call").withColumn("status", F.lit("orphan result"))
    beyond = further.join(known, keys, "left").withColumn("status", F.when(F.col("is_call"), "further result").otherwise("orphan result")).drop("is_call")
    rest = answered.unionByName(beyond).unionByName(loose.withColumn("status", F.lit("orphan result")))

    ordered = _ordered(first).join(linked, keys, "left")
    block = F.floor(F.col("at") / BLOCK)
    placed = numbered(ordered, ["conv_id"], block, ["at", "hop", "turn", "call_id"], "position")
    empty = F.array().cast("array<string>")
    columns = ["conv_id", "call_id", "turn", "name", "arguments", "depends_on", "position", "content", "has_result", "found", "status"]
    waiting = F.when(F.col("has_result"), "linked").otherwise("no result")
    parts = [placed.withColumn("status", waiting)]
    for more, status in ((again, F.lit("duplicate call")), (nameless, F.lit("no result"))):
        parts.append(more.withColumns({"position": F.lit(None).cast("long"), "content": F.lit(None).cast("string"), "has_result": F.lit(False), "found": empty, "status": status}))
    rows = parts[0].select(*columns)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*columns))
    kind = f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, turn long, position long, status string, errors array<string>, json string"
    written = rows.withColumn("has_result", F.coalesce("has_result", F.lit(False))).mapInArrow(_written(tools), kind)
    text = F.to_json(F.struct("content", F.col("call_id").alias("id")))
    left = rest.select("conv_id", "call_id", "turn", F.lit(None).cast("long").alias("position"), "status", empty.alias("errors"), text.alias("json"))
    return written.unionByName(left)
