"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of letters and digits, lower-cased; shingles are five of them (an item of fewer words is one shingle of its length).
An item is contained in a text if at least 4/5 of its distinct shingles occur there.

Items are partitioned by size in powers of two. An item's sketch is its bottom-k MinHash: the k shingles of smallest hash, k
being one more than a fifth of the largest size in the partition. A text that contains the item lacks at most a fifth of its shingles, so
it holds one of the sketch, whatever the text's length: the search looks every shingle of every text up in the sketches and
misses nothing. Candidates are then verified on the shingles themselves, in a second pass over the texts: reading them again costs
less than shuffling them to their candidates.

The sketch table goes to every task only while its measured size is at most `SMALL` rows; beyond that the same join shuffles. All of it
is DataFrame and SQL functions.

Nulls: rows or items without id are not compared, a null text has no words, an item without words is contained nowhere. Every text and every item
stands for itself, also where several share an id: items are kept apart by the SHA-256 of their shingles, texts by theirs. Equal texts under one id are one
text; each pair of a text and an item found is one row, so a pair of ids comes once per pair of different texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigframe.session import materialize

WIDTH, SMALL = 5, 200_000
_LARGEST = "shiftleft(1, length(bin(n_shingles))) - 1"  # the largest size in an item's partition


def _words(text: str) -> Column:
    return F.expr(rf"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+', 0)")


def _shingles(width: str) -> Column:
    """All distinct shingles of `words`, as strings; `width` is an expression."""
    return F.expr(f"array_distinct(transform(if(size(words) < {width}, array(), sequence(1, size(words) - {width} + 1)), i -> array_join(slice(words, i, {width}), ' ')))")


def _send(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SMALL else small


def benchmark_items(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, shingles, n_shingles, item) of all items that have words; `item` is the key."""
    items = bench.select(F.col(id_col).alias("item_id"), _words(text_col).alias("words")).filter("item_id is not null and size(words) > 0")
    items = items.withColumn("width", F.least(F.lit(WIDTH), F.size("words")))
    items = items.select("item_id", "width", _shingles("width").alias("shingles")).distinct()
    return items.withColumns({"n_shingles": F.size("shingles"), "item": F.struct("item_id", F.sha2(F.array_join("shingles", "\n"), 256).alias("mark"))})


def sketches(items: DataFrame) -> DataFrame:
    """(item, width, hash): the bottom-k MinHash of every item, k by size partition."""
    rows = items.withColumn("k", F.expr(f"cast(({_LARGEST}) div 5 as int) + 1"))
    rows = rows.select("item", "width", "k", F.explode("shingles").alias("shingle")).withColumn("hash", F.xxhash64("shingle"))
    order = F.row_number().over(W.partitionBy("item", "width").orderBy("hash", "shingle"))
    return rows.withColumn("rank", order).filter("rank <= k").select("item", "width", "hash")


def contained(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contained pair: doc_id, item_id, n_shingles, n_shared, containment."""
    items = materialize(benchmark_items(bench), "items")
    sketch = materialize(sketches(items), "sketches")
    count = items.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most five numbers
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    texts = texts.select(F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("mark")).alias("doc"), "text")
    whole = materialize(items.select("item", "width", F.posexplode("shingles").alias("k", "shingle")).withColumn("hash", F.xxhash64("shingle")), "shingles")

    def grams(width: int) -> DataFrame:
        """Every shingle of every text."""
        words = texts.select("doc", _words("text").alias("words"))
        at = words.select("doc", "words", F.expr(f"explode(if(size(words) < {width}, null, sequence(0, size(words) - {width})))").alias("i"))
        shingle = F.concat_ws(" ", *[F.col("words")[F.col("i") + k] for k in range(width)]).alias("shingle")
        return at.select("doc", shingle).withColumn("hash", F.xxhash64("shingle"))

    def found(width: int) -> DataFrame:
        """Candidates: texts with a shingle of an item's sketch."""
        looked_up = _send(sketch.filter(F.col("width") == width).select("item", "hash"), count)
        return grams(width).select("doc", "hash").join(looked_up, "hash").select("doc", "item").distinct()

    def held(width: int) -> DataFrame:
        """Which shingles of the items the texts hold, compared as strings."""
        looked_up = _send(whole.filter(F.col("width") == width).select("item", "k", "hash", "shingle"), count)
        return grams(width).join(looked_up, ["hash", "shingle"]).select("doc", "item", "k").distinct()

    none = texts.limit(0).select("doc", F.lit(None).cast(items.schema["item"].dataType).alias("item"))
    pairs = reduce(DataFrame.unionByName, map(found, widths), none)
    parts = reduce(DataFrame.unionByName, map(held, widths), none.select("doc", "item", F.lit(0).alias("k")))
    pairs = materialize(pairs, "pairs")
    shared = parts.join(pairs, ["doc", "item"], "left_semi").groupBy("doc", "item").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
    sized = shared.join(items.select("item", "n_shingles"), "item").filter("5 * n_shared >= 4 * n_shingles")
    return sized.select("doc.doc_id", "item.item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
