"""Variable-length cell records: packing a grid into bytes, and a table function that reads them back.

A record is a byte with the channel + 1 and, if its top bit is set, a mask byte of the columns that follow, one byte
each; columns without a bit repeat the channel's last value. A zero byte ends a row. Chunks hold at most `ROWS` rows
and start with a clean memory.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udtf

from sigframe.functions.cells import FIELDS
from sigframe.plans.blocked import block_of

ROWS = 1024


def _byte(c: Column) -> Column:
    return F.lpad(F.hex(c), 2, "0")


def encode_layout(cells: DataFrame) -> DataFrame:
    """`pattern, first_row, content`: the grid in chunks of rows; columns must be 0..255 and channels 0..126."""
    chunk = cells.withColumn("_block", block_of("row", ROWS))
    mine = W.partitionBy("pattern", "_block", "channel").orderBy("row")
    order = W.partitionBy("pattern", "_block").orderBy("row", "channel")
    mask, body = F.lit(0), F.lit("")
    for i, f in enumerate(FIELDS):
        differs = F.col(f) != F.coalesce(F.lag(f).over(mine), F.lit(0))
        mask = mask + F.when(differs, 1 << i).otherwise(0)
        body = F.concat(body, F.when(differs, _byte(F.col(f))).otherwise(""))
    skip = F.col("row") - F.coalesce(F.lag("row").over(order), F.col("_block") * ROWS)
    record = F.concat(F.repeat(F.lit("00"), skip.cast("int")), _byte(F.col("channel") + 129), _byte(mask), body)
    parts = F.array_sort(F.collect_list(F.struct("row", "channel", "_hex")))
    return (
        chunk.withColumn("_hex", record)
        .groupBy("pattern", "_block")
        .agg(F.unhex(F.concat(F.array_join(F.transform(parts, lambda p: p["_hex"]), ""), F.lit("00"))).alias("content"))
        .select("pattern", (F.col("_block") * ROWS).alias("first_row"), "content")
    )


_COLUMNS = ["pattern", "row", "channel", *FIELDS]


@arrow_udtf(returnType=", ".join(f"{c} long" for c in _COLUMNS))
class DecodeLayout:
    """Rows of all chunks of a batch (`pattern, first_row, content`), gathered column by column."""

    def eval(self, chunks: pa.RecordBatch) -> Iterator[pa.Table]:
        out = array("q")
        for pattern, row, content in zip(*(chunks.column(c).to_pylist() for c in ("pattern", "first_row", "content"))):
            self._chunk(out, pattern, row, content or b"")
        cells = np.frombuffer(out, np.int64).reshape(-1, len(_COLUMNS)) if out else np.zeros((0, len(_COLUMNS)), np.int64)
        yield pa.table({c: pa.array(np.ascontiguousarray(cells[:, i])) for i, c in enumerate(_COLUMNS)})

    @staticmethod
    def _chunk(out: array, pattern: int, row: int, content: bytes) -> None:
        last: dict[int, list[int]] = {}
        at, size = 0, len(content)
        while at < size:
            head = content[at]
            at += 1
            if not head:
                row += 1
                continue
            cell = last.setdefault(head & 0x7F, [0] * len(FIELDS))
            if head & 0x80 and at < size:
                changed = _SET[content[at]]
                at += 1
                for i, value in zip(changed, content[at : at + len(changed)]):
                    cell[i] = value
                at = min(at + len(changed), size)
            out.extend((pattern, row, (head & 0x7F) - 1, *cell))


_SET = [[i for i in range(len(FIELDS)) if mask >> i & 1] for mask in range(256)]  # columns of a mask byte


def decode_layout(chunks: DataFrame) -> DataFrame:
    """Cells of chunks made by `encode_layout`: a table function over whole Arrow batches."""
    return DecodeLayout(chunks.select("pattern", "first_row", "content").asTable()).select(*_COLUMNS)
