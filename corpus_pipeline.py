"""A corpus pipeline out of the operators in `sigframe.llm`.

Each stage's table is written as Parquet and reread as the next one's documents. All but the last return the columns of documents.
Exactly the rows that an operator found go, whatever ids they share or lack: rows are named by their contents, not by their id alone. Of a group of copies the row with
the smallest doc_id stays (nulls last; ties: the smallest SHA-256 of the text, then of the row; of rows that are equal in every column one stays). Every row with a contaminated
text goes. In substring dedup a document without an id neither loses words nor makes others lose any, since only documents with a smaller id count as earlier.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import decontaminate, piece_tokenizer, quality_classifier
from sigframe.llm.language_id import held_out
from sigframe.llm.repeated_phrases import remove_repeats
from sigframe.llm.simhash import near_duplicates
from sigframe.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go. It learns from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model, keep=True)
    return scored.filter(F.col("score") >= quality_classifier.THRESHOLD).select("row.*")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    row = F.struct(*docs.columns)
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", sha256(F.coalesce("text", F.lit(""))).alias("mark"), sha256(F.to_json(row)).alias("whole"))
    rows = docs.select(name.alias("name"), row.alias("row"))
    found = materialize(near_duplicates(rows, "name", "row.text").select(F.col("doc_id").alias("name"), "component_id"), "copies")
    first = F.col("component_id") == F.col("name")
    gone = found.filter(~first).select("name").distinct()
    equal = materialize(found.filter(first).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "equal")
    alone = rows.join(gone.unionByName(equal), "name", "left_anti").select("row")
    one = rows.join(equal, "name", "left_semi").groupBy("name").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(one).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a document of which no word is left goes."""
    out = remove_repeats(docs, keep=True).filter("n_removed = 0 or n_removed < n_words")
    text = F.coalesce("kept_text", "row.text")
    chars = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))
    new = {"text": text.alias("text"), "n_chars": chars.alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"row.{c}")) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows = docs.select(sha256(F.col("text")).alias("mark"), F.struct(*docs.columns).alias("row"))
    found = decontaminate.contained(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "mark", "row.text").select(F.col("doc_id").alias("mark")).distinct()
    return rows.join(found, "mark", "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, ids, n_ids, exact."""
    import public_tokenizers

    return piece_tokenizer.encode(docs, Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("tokens", tokens)]
ORACLE_SQL = None  # SQL expresses neither the fit nor the automata; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
