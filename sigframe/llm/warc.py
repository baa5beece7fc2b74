"""WARC archives of pages, written by Spark's text writer and read back by boundary-chain verification.

Writing. A record is a header, an empty line, the payload (the html in UTF-8) and two line ends; the two line ends are the writer's line
separator, so files come from Spark's own committed writer on any file system. Of records with equal payloads of at least `LEAST` bytes the one with the
smallest page_id is a `response`; the others are `revisit` records without a payload, whose header names the response, the digest and
the length. Smaller payloads are always written out. A file has at most `PER_FILE` records.

Reading. Files are split at every occurrence of a line end and `WARC/1.`, wherever Spark cuts them, also in the middle of payloads. Tasks parse what follows an
occurrence as a header; if it has a version and a length, it is a candidate, and (own offset, offset of its successor) is emitted.
Offsets are running sums of lengths by block of a file, plus the blocks before. Within a block, pointers are doubled until they leave
it; between blocks, only the offsets at which some pointer enters a block remain, and they are doubled by joins from the file's start, in as many
rounds as the logarithm of the blocks in a file. Only candidates on the chain from offset 0 are records; magic inside payloads is never reached, unless a
length on the chain is wrong. Payloads that hold magic lie in several pieces and are put together from the texts of their own pieces.

Bounds: a task holds the offsets of one block (`spark.sql.files.maxPartitionBytes` of a file), never payloads of several records.
Payloads that occur twice or more are a table of digests; pages meet it in a join that broadcasts by
measured size or else can be split, so a third of all pages may share a payload.

Odd cases: a null html is an empty payload, a null url gives no target line, control characters in an url are percent-encoded. Rows with equal id and payload
are each a response where that id is the smallest. A null page_id is written as an empty number and read back as null; it counts as larger than
all numbers. A file that ends inside a record gives `whole` false and the digest of what is there. Empty tables and files give no rows. Columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigframe.session import materialize

LEAST = 100
PER_FILE = 50_000
END = "\r\n\r\n"
MAGIC = "WARC/1."
MARK = "\n" + MAGIC
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    first = rows.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = materialize(first.filter("copies > 1").drop("copies"), "copied")  # so that its size is known: Spark then sends it to the pages if it is small
    rows = rows.join(first, "payload_digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _line(name: str, value: Column) -> Column:
    """A header line, nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of `pages` (page_id, url, html) to files below `path`."""
    rows = payloads(pages)
    again = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", "%(?![0-9A-Fa-f]{2})", "%25")
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    size = F.col("payload_bytes").cast("string")
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\n"), _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), _line("WARC-Refers-To", F.when(again, _urn(F.col("refers_to")))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))), _line("X-Payload-Length", F.when(again, size)), F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(again, "0").otherwise(size), F.lit(END),
    )
    record = F.concat(head, F.when(again, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(path)


def _field(name: str, pattern: str) -> Column:
    """The value of a header line, null if there is none of that form."""
    got = F.regexp_extract("head", f"(?i)\\r\\n{name}:[ \\t]*({pattern})[ \\t]*(?=\\r\\n|$)", 1)
    return F.when(got != "", got)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two marks: file, block (offset at which Spark cut the file), ord (in order within a block), piece."""
    return spark.read.option("lineSep", MARK).option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("piece")
    )


def _parsed(pieces: DataFrame) -> DataFrame:
    """Length and header fields of each piece, and the digest of its payload if that lies in the piece."""
    starts = F.startswith("piece", F.lit(MAGIC))  # so does the first piece of a file
    rows = pieces.withColumns({"size": F.octet_length("piece").cast("long"), "body": F.when(starts, F.substring("piece", len(MAGIC) + 1, 2**31 - 1)).otherwise(F.col("piece"))})
    rows = rows.withColumn("head", F.substring_index(F.concat("body", F.lit("\n")), END, 1))  # a payload may start with the mark's line end
    rows = rows.withColumn("skip", F.octet_length("head").cast("long") + len(END))
    good = F.contains(F.concat("body", F.lit("\n")), F.lit(END)) & F.rlike("head", F.lit("^[0-9]\\r\\n"))
    rows = rows.withColumn("length", F.when(good, _field("content-length", "[0-9]{1,18}").cast("long")))
    there = F.octet_length("body") - F.col("skip")
    inside = F.substring(F.col("body").cast("binary"), (F.col("skip") + 1).cast("int"), F.col("length").cast("int"))
    fields = {
        "inside": there >= F.col("length"),
        "digest": F.when(there >= F.col("length"), F.sha2(inside, 256)),
        "id": _field("warc-record-id", "<urn:page:-?[0-9]*>"),
        "url": _field("warc-target-uri", "[^\\r]*"),
        "kind": _field("warc-type", "[a-z]+"),
        "refers": _field("warc-refers-to", "<urn:page:-?[0-9]*>"),
        "named": _field("warc-payload-digest", "sha256:[0-9a-f]{64}"),
        "full": _field("x-payload-length", "[0-9]{1,18}").cast("long"),
    }
    return rows.withColumns(fields).select("file", "block", "ord", "size", "skip", "length", *fields)


def _placed(parsed: DataFrame) -> DataFrame:
    """Adds `at`, the offset of the piece's magic in its file, and `next`, that of its successor (null if it is no candidate)."""
    sep = len(MARK)
    block = Window.partitionBy("file", "block").orderBy("ord")
    before = parsed.groupBy("file", "block").agg(F.sum(F.col("size") + sep).alias("total"))
    before = before.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inner = F.sum(F.col("size") + sep).over(block) - F.col("size") - sep
    rows = parsed.withColumn("inner", inner).join(before, ["file", "block"])
    at = F.greatest(F.col("before") + F.col("inner") - len(MAGIC), F.lit(0)).cast("long")
    rows = rows.withColumn("at", at).drop("inner", "before")
    return rows.withColumn("next", F.col("at") + len(MAGIC) + F.col("skip") + F.col("length") + len(END))


def _inner_links(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """For offsets in order: the position of the successor within the block, or the own position."""
    to = np.searchsorted(at, nxt)
    here = np.minimum(to, len(at) - 1)
    return np.where((to < len(at)) & (at[here] == nxt), here, np.arange(len(at)))


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves the block."""
    pdf = pdf.sort_values("at", ignore_index=True)
    nxt = pdf["next"].to_numpy()
    jump = _inner_links(pdf["at"].to_numpy(), nxt)
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return pdf[["file", "block", "at"]].assign(exit=nxt[jump])


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates on the chain from the block's entry."""
    pdf = pdf.sort_values("at", ignore_index=True)
    jump = _inner_links(pdf["at"].to_numpy(), pdf["next"].to_numpy())
    on = pdf["entry"].to_numpy().copy()
    while True:
        more = on.copy()
        more[jump[on]] = True
        if (more == on).all() and (jump[jump] == jump).all():
            return pdf.loc[on, ["file", "block", "at"]]
        on, jump = more, jump[jump]


def _entries(exits: DataFrame) -> DataFrame:
    """(file, at) of the candidates at which the chain from the start of a file enters its blocks."""
    start = exits.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    doors = exits.select("file", F.col("exit").alias("at")).unionByName(start).distinct()
    jump = materialize(exits.join(doors, ["file", "at"], "left_semi").select("file", "at", "exit"), "doors")
    doors = jump.select("file", "at")
    reach = start.join(doors, ["file", "at"], "left_semi")
    while not jump.isEmpty():  # 2^round steps are covered; pointers that leave the file go
        ahead = reach.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at")).join(doors, ["file", "at"], "left_semi")
        reach = materialize(reach.unionByName(ahead).distinct(), "reached")
        then = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jump = materialize(jump.join(then, ["file", "exit"]).select("file", "at", F.col("far").alias("exit")), "jumps")
    return reach


def _assembled(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, at, digest, inside, payload) of records whose payload lies in several pieces."""
    last = rows.filter("record").groupBy("file", "block").agg(F.max("at").alias("last"))
    known = rows.select("file", "block").distinct().join(last, ["file", "block"], "left")
    known = known.withColumn("carried", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    here = F.last(F.when(F.col("record"), F.col("at")), True).over(Window.partitionBy("file", "block").orderBy("at"))
    owned = rows.withColumn("here", here).join(known, ["file", "block"]).withColumn("start", F.coalesce("here", "carried"))
    split = rows.filter("record and not inside").select("file", F.col("at").alias("start"), "skip", "length")
    owned = owned.select("file", "block", "ord", "at", "start").join(split, ["file", "start"])
    texts = pieces.join(owned, ["file", "block", "ord"])
    whole = texts.groupBy("file", F.col("start").alias("at"), "skip", "length").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), MARK)
    skip = F.col("skip") + F.when(F.col("at") == 0, F.lit(len(MAGIC))).otherwise(F.lit(0))
    whole = whole.withColumn("payload", F.substring(text.cast("binary"), (skip + 1).cast("int"), F.col("length").cast("int")))
    return whole.select("file", "at", F.sha2("payload", 256).alias("digest"), (F.octet_length("payload") == F.col("length")).alias("inside"), F.octet_length("payload").cast("long").alias("got"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below `path`: page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, offset, whole.

    Digest and size of responses come from the bytes read, those of revisits from their headers. `whole` is false where a payload is cut off
    or differs from the digest in its header."""
    pieces = _pieces(spark, path)
    rows = materialize(_placed(_parsed(pieces)), "pieces")
    candidates = rows.filter("next is not null").select("file", "block", "at", "next")
    exits = materialize(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block long, at long, exit long"), "exits")
    entries = _entries(exits).withColumn("entry", F.lit(True))
    marked = candidates.join(entries, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    chain = marked.groupBy("file", "block").applyInPandas(_reached, "file string, block long, at long").withColumn("record", F.lit(True))
    rows = materialize(rows.join(chain, ["file", "block", "at"], "left").withColumn("record", F.coalesce("record", F.lit(False))), "records")
    records = rows.filter("record").withColumn("got", F.when(F.col("inside"), F.col("length")))
    if not records.filter("not inside").isEmpty():
        mended = _assembled(pieces, rows).select("file", "at", F.col("digest").alias("digest2"), F.col("inside").alias("inside2"), F.col("got").alias("got2"))
        records = records.join(mended, ["file", "at"], "left")
        records = records.withColumns({"digest": F.coalesce("digest", "digest2"), "inside": F.coalesce("inside2", "inside"), "got": F.coalesce("got", "got2")})
    number = lambda c: F.regexp_extract(c, "-?[0-9]+", 0).try_cast("long")
    again = F.col("kind") == "revisit"
    named = F.substring("named", 8, 64)
    return records.select(
        number("id").alias("page_id"), F.when(again, F.col("full")).otherwise(F.col("got")).alias("payload_bytes"), F.when(again, named).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), number("refers").alias("refers_to"), "url", "file", F.col("at").alias("offset"),
        (F.col("inside") & (again | named.isNull() | (F.col("digest") == named))).alias("whole"),
    )
