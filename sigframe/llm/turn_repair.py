"""Repair of conversations by iterative-deepening A*, block by block.

A conversation's rows are taken by turn (nulls first), then by role and by the SHA-256 of the text. Equal rows (turn, role, text) are one row with a
number of copies. A row's first fault counts: `blank` (no character but white space), `duplicate` (its role and text came earlier), `truncated` (the last
character that is no white space is not one of `.!?`). Edits and costs: Delete 2 (the only edit of blank and duplicate rows), Insert 5 (a user or
assistant without text), Keep 0, Rerole 1 (to user or assistant); a truncated row that stays adds 5. The initials of the roles of the result must match
`(s?(ua)+)?`. Which role is inserted or given follows from the role before, so the letters D, I, K, R say everything. The answer is the
cheapest sequence, among equals the least in ASCII order.

Search. Depth first in the order D, I, K, R under a cost bound, which starts at a sum of unavoidable costs and grows to the least total beyond it. States
(row, role before) that failed are kept with the least budget that could still succeed, over all bounds, so that no state fails twice with the same budget. The first
accepting path is the answer.

Scale. Rows without texts are sorted over the cluster by range and searched in blocks of at most `BLOCK` rows, so no task needs a whole conversation. A block at
the edge of a partition, or one of several, is searched from each role before it to each role behind it; the blocks of a conversation are then chained by costs to go (16 small numbers per
block of 64 rows). Equal texts are counted before they are sorted. Texts are shuffled once, for the last pass: it streams a conversation's
rows in order and holds one record batch, the letters so far and a hash. One task sees all of a conversation there, because a SHA-256 over the whole has no parts.

Odd cases: a null role or text is one space (so such a role must change, and such a text is blank); a role without a character cannot be kept. Rows without a turn
take part, but not in `gaps`. A null conv_id is a conversation like any other. Rows with `copies` 0 only make their conversation appear in the result. A conversation without rows
has zeros, an empty audit and the hash of the empty string. Other columns are ignored. `gaps` is at most the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.session import materialize

BLOCK = 64
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # the role before
END = 4  # goal: the end of a conversation
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or changed role must be
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TO_END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
NEVER = 1 << 40
LEGAL = {"su", "ua", "au"}
LONGEST = 2**63 - 1


def least_cost(initial: str, fault: int) -> int:
    if fault != FINE:
        return DELETE
    return 0 if initial in ("s", "u", "a") else REROLE


def reachable(rows: list[tuple[str, int]], entry: int, goal: int) -> bool:
    if goal == START:
        return entry == START
    if goal == SYSTEM:
        return entry == SYSTEM or entry == START and any(i == "s" and f in (FINE, CUT) for i, f in rows)
    return True


def cheapest(rows: list[tuple[str, int]], entry: int, goal: int) -> tuple[int, str]:
    """Cost and letters of the answer for rows (initial, fault), from the role before them to the role `goal` right behind the last of
    them, or to a proper end (`END`), where more may be inserted behind the last."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + least_cost(*rows[i])
    need: dict[tuple[int, int], int] = {}  # least budget that a failed state may still succeed with
    path: list[str] = []

    def edits(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield "D", i + 1, q, DELETE
        if i < n or goal == END:
            yield "I", i, MADE[q], INSERT
        if i < n and rows[i][1] in (FINE, CUT):
            extra = TRUNCATED if rows[i][1] == CUT else 0
            if (q, rows[i][0]) in KEPT:
                yield "K", i + 1, KEPT[q, rows[i][0]], extra
            yield "R", i + 1, MADE[q], REROLE + extra

    def search(i: int, q: int, budget: int) -> int:
        """0 or more if a path within the budget was found; otherwise minus the least budget that may do."""
        if i == n and (TO_END[q] == 0 if goal == END else q == goal):
            return 0
        least = NEVER
        for letter, j, p, cost in edits(i, q):
            more = cost + need.get((j, p), rest[j])
            if more <= budget:
                path.append(letter)
                got = search(j, p, budget - cost)
                if got >= 0:
                    return got + cost
                path.pop()
                more = cost - got
            least = min(least, more)
        need[i, q] = least
        return -least

    bound = rest[0]
    while (got := search(0, entry, bound)) < 0:
        bound = -got
    return got, "".join(path)


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("fault", pa.int32()), ("copies", pa.int64())])
_BLOCKS = "part int, seq int, rows array<struct<turn: long, role: string, digest: binary, fault: int, copies: long>>, path string, costs array<long>, ranks array<int>, paths array<string>"


def _grid(rows: list[tuple[str, int]]) -> tuple[list[int], list[int], list[str]]:
    """Costs and letters from every role before a block to every role behind it; ranks order the letters from one role before."""
    costs, ranks, paths = [], [], []
    for entry in range(4):
        row = [cheapest(rows, entry, goal) if reachable(rows, entry, goal) else (NEVER, "~") for goal in range(4)]
        order = sorted(range(4), key=lambda g: row[g][1])
        costs += [c for c, _ in row]
        paths += [p for _, p in row]
        ranks += [order.index(g) for g in range(4)]
    return costs, ranks, paths


def _searched(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["conv_id", "part", "seq", "rows", "path", "costs", "ranks", "paths"]
    kinds = [id_type, pa.int32(), pa.int32(), pa.list_(_ROW), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, runs, conv, block, opened = TaskContext.get().partitionId(), 0, 0, None, [], False

        def closed(whole: bool) -> tuple:
            rows = [(r["role"][:1], r["fault"]) for r in block]
            if whole:
                return conv, part, seq, block, cheapest(rows, START, END)[1], None, None, None
            return conv, part, seq, block, None, *_grid(rows)

        for b in batches:
            for r in b.to_pylist():
                mine = r.pop("conv_id")
                if opened and (mine != conv or len(block) == BLOCK):
                    yield closed(mine != conv and runs > 1 and not inside)
                    seq, block, inside = seq + 1, [], mine == conv
                if not opened or mine != conv:
                    conv, runs, inside, opened = mine, runs + 1, False, True
                block.append(r)
        if block:
            yield closed(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for x in blocks(batches):
            held.append(x)
            if len(held) == 500:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    return run


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of its 16 paths each block of a conversation takes."""
    pdf = pdf.sort_values(["part", "seq"], ignore_index=True)
    ahead = [[TO_END[q] for q in range(4)]]
    for costs in reversed(pdf["costs"].tolist()):
        ahead.append([min(costs[4 * e + x] + ahead[-1][x] for x in range(4)) for e in range(4)])
    ahead.reverse()
    q, picks = START, []
    for k, (costs, ranks) in enumerate(zip(pdf["costs"], pdf["ranks"])):
        ways = [(costs[4 * q + x] + ahead[k + 1][x], ranks[4 * q + x], x) for x in range(4)]
        x = min(ways)[2]
        picks.append(4 * q + x)
        q = x
    return pdf[["part", "seq"]].assign(pick=picks)


def slim(messages: DataFrame) -> DataFrame:
    """Distinct rows without texts: conv_id, turn, role, digest, fault, copies (at least 1)."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    rows = messages.filter("copies > 0").select("conv_id", "turn", "role", "digest", last.alias("last"), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "last").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long")))
    rows = materialize(rows.withColumn("place", place), "turns")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("place").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "digest", fault.alias("fault"), "copies")


def _keyed(messages: DataFrame, copies: Column | None) -> DataFrame:
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


ORDER = ["conv_id", "turn", "role", "digest"]


def edits(keyed: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, fault, copies and `letters` (inserts before the row, then its own) of every distinct row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = keyed.schema["conv_id"].dataType
    rows = materialize(slim(keyed), "faults").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = materialize(rows.mapInArrow(_searched(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {_BLOCKS}"), "blocks")
    picks = blocks.filter("path is null").select("conv_id", "part", "seq", "costs", "ranks").groupBy("conv_id").applyInPandas(_chained, "part int, seq int, pick int")
    chosen = blocks.join(picks, ["part", "seq"], "left").withColumn("path", F.coalesce("path", F.get("paths", F.col("pick"))))
    each = F.arrays_zip("rows", F.regexp_extract_all("path", F.lit("I*[DKR]"), F.lit(0)).alias("letters"))
    return chosen.select("conv_id", F.explode(each).alias("x")).select("conv_id", "x.rows.*", "x.letters")


class Walk:
    """The rows of one conversation in order: faults, edits, and the repaired rows as they come."""

    def __init__(self) -> None:
        self.q, self.before, self.cost, self.illegal, self.faults = START, None, 0, 0, [0, 0, 0, 0]
        self.least = self.most = self.turn = None
        self.turns, self.audit = 0, []

    def insert(self) -> tuple[str, str]:
        self.q = MADE[self.q]
        self.cost += INSERT
        self.audit.append("I")
        return NAMES[self.q], ""

    def row(self, turn: int | None, role: str, fault: int, copies: int, letters: str) -> tuple[list[tuple[str, str]], str | None]:
        """Rows inserted before, and the role under which the row stays."""
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.most, self.turn, self.turns = turn, turn, self.turns + 1
        initial = role[:1]
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + copies - 1
        self.before = initial
        if fault in (BLANK, DUPLICATE):
            self.faults[fault] += copies
        else:
            self.faults[fault] += 1
            self.faults[DUPLICATE] += copies - 1
        new = [self.insert() for _ in letters[:-1]]
        own, stays = letters[-1], None
        if own == "D":
            self.cost += DELETE
        else:
            self.q, stays = (KEPT[self.q, initial], role) if own == "K" else (MADE[self.q], NAMES[MADE[self.q]])
            self.cost += (own == "R") * REROLE + (fault == CUT) * TRUNCATED
        self.cost += DELETE * (copies - 1)
        self.audit.append(own + "D" * (copies - 1))
        return new, stays

    def end(self) -> list[tuple[str, str]]:
        new = []
        while TO_END[self.q]:
            new.append(self.insert())
        return new

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, LONGEST)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, walk, role, text) for every repaired row, and (conv_id, walk, None, None) at the end of every conversation."""
    walk, conv, waiting = None, None, None
    for b in batches:
        for r in b.to_pylist():
            if walk is None or r["conv_id"] != conv:
                if walk is not None:
                    yield from ((conv, walk, *x) for x in walk.end())
                    yield conv, walk, None, None
                walk, conv, waiting = Walk(), r["conv_id"], None
            key = (r["turn"], r["role"], r["digest"])
            if r["letters"] is not None:
                new, stays = walk.row(r["turn"], r["role"], r["fault"], r["copies"], r["letters"])
                yield from ((conv, walk, *x) for x in new)
                waiting = (key, stays) if stays is not None else None
            elif waiting is not None and waiting[0] == key:
                yield conv, walk, waiting[1], r["text"]
                waiting = None
    if walk is not None:
        yield from ((conv, walk, *x) for x in walk.end())
        yield conv, walk, None, None


def _in_order(messages: DataFrame, copies: Column | None) -> DataFrame:
    """Edits and texts of each conversation in one partition, each row's edit before its texts."""
    keyed = _keyed(messages, copies)
    made = edits(keyed).select(*ORDER, "fault", "copies", "letters", F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("fault", "int"), ("copies", "long"), ("letters", "string"))]
    both = made.unionByName(keyed.select(*ORDER, *none, "text"))
    return both.repartition("conv_id").sortWithinPartitions(*ORDER, F.col("letters").isNull())


def repaired(messages: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired rows: conv_id, at (from 0), role, text. `messages`: conv_id, turn, role, text; `copies` says how often each row counts."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = _in_order(messages, copies)
    kind = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0
        for conv, _, role, text in _walked(batches):
            if role is None:
                at = 0
                continue
            held.append((conv, at, role, text))
            at, size = at + 1, size + len(text) + 50
            if size > 4_000_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["conv_id", "at", "role", "text"])
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["conv_id", "at", "role", "text"])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, at long, role string, text string")


_REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(messages: DataFrame, copies: Column | None = None) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and the SHA-256 of the repaired `role:text` rows joined by newlines."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = _in_order(messages, copies)
    kind = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sha, first = [], 0, hashlib.sha256(), True
        for conv, walk, role, text in _walked(batches):
            if role is not None:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
                continue
            f = walk.faults
            held.append((conv, walk.gaps(), f[BLANK], f[DUPLICATE], f[CUT], walk.illegal, walk.cost, "".join(walk.audit), sha.hexdigest()))
            size, sha, first = size + sum(map(len, walk.audit)) + 200, hashlib.sha256(), True
            if size > 4_000_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], _REPORT)
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], _REPORT)

    longs = ", ".join(f"{c} long" for c in _REPORT[1:7])
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, {longs}, audit string, repaired_sha256 string")


def damage(messages: DataFrame) -> tuple[DataFrame, Column]:
    """`messages` with damage chosen by the checksum of `conv_id:turn` modulo 20 (0: dropped, 1: text emptied, 2: without `.!?`, 3: twice, 4: role user; nulls are
    one space), and how often each row counts."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("h") == 4, "user").otherwise(F.col("role"))})
    return rows, F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
