"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_ppm_language")
def _op1(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm import language_id

    docs = table(spark, d, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out()))
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "code_bits")


@query("op2_elias_fano_tokens")
def _op2(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from sigframe.llm import token_store

    path = shared_path(spark, "tokens")
    spec = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    token_store.write_store(table(spark, d, "documents"), path, spec, by_word=True)
    return token_store.read_store(spark, path)


@query("op3_mcd_quality_rules")
def _op3(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.quality_rules import apply_rules

    return apply_rules(table(spark, d, "documents"))


@query("op4_fourier_quality")
def _op4(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm import quality_classifier
    from sigframe.llm.language_id import held_out

    docs = table(spark, d, "documents")
    model = quality_classifier.fit(docs, table(spark, d, "labels").filter(~held_out()))
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return quality_classifier.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query("op5_substring_dedup")
def _op5(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.repeated_phrases import remove_repeats

    return remove_repeats(table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6 = """
WITH docs AS (SELECT doc_id, d, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM (SELECT row_number() OVER () AS d, * FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
items AS (SELECT item_id, w, least(5, len(w)) AS width FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
keyed AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT item_id, width, [array_to_string(w[i : i + width - 1], ' ') FOR i IN range(1, len(w) - width + 2)] AS g FROM items)),
item_shingles AS (SELECT DISTINCT k, item_id, width, unnest(g) AS s FROM keyed),
sizes AS (SELECT k, count(*) AS n FROM item_shingles GROUP BY ALL),
doc_shingles AS (SELECT DISTINCT d, doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS s FROM (SELECT d, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM items))),
shared AS (SELECT d, doc_id, k, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(n_shared AS INTEGER) AS n_shared, n_shared / n AS containment
FROM shared JOIN sizes USING (k) WHERE 5 * n_shared >= 4 * n"""


@query("op6_benchmark_containment", OP6)
def _op6(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.decontaminate import contained

    return contained(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op7_simhash_dedup")
def _op7(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.simhash import near_duplicates

    return near_duplicates(table(spark, d, "documents"))


def _crc32_steps() -> str:
    """The 256 steps of CRC-32 as an SQL list, made from its polynomial."""
    steps = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(str(c))
    return "[" + ", ".join(steps) + "]"


OP8 = f"""
WITH raw AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, source, length(h) // 2 AS n, [16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 for i in range(length(h) // 2)] AS b FROM raw),
base AS (SELECT doc_id, source, n + 8 AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
  xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, {_crc32_steps()}[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM bytes),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY ord, doc_id NULLS FIRST, size, crc) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS part FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY part, source NULLS FIRST, ord, doc_id NULLS FIRST, size, crc) - 1 AS place, count(*) OVER () AS total FROM ranked),
sharded AS (SELECT *, CAST(place * 24 // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, shard, CAST(place - (shard::BIGINT * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded"""


@query("op8_stratified_shards", OP8)
def _op8(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.sharding import interleave

    out = interleave(table(spark, d, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_piece_viterbi")
def _op9(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from sigframe.llm import piece_tokenizer

    return piece_tokenizer.encode(table(spark, d, "documents"), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())


TOOLS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "properties": {"query": {"type": "string", "minLength": 3}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}},
        "additionalProperties": False,
    },
    "quote": {"type": "object", "required": ["words"], "properties": {"words": {"type": "array", "items": {"type": "string", "maxLength": 12}}}},
    "count": {"type": "object", "required": ["of", "unit"], "properties": {"of": {"type": "string"}, "unit": {"enum": ["word", "line"]}}},
}


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations seen as tool traffic: an assistant's turn calls a tool (by checksum of its text, with its whole text as arguments) under an
    identifier made of its turn, and any other turn is the result of the turn before it. Some calls depend on the call before, some
    on the next one, and some arguments lack their last brace or name no known tool."""
    m = messages.withColumns({"text": F.coalesce("text", F.lit("")), "turn": F.col("turn").cast("long")})
    m = m.withColumns({"h": F.crc32(F.encode("text", "UTF-8")), "w": F.split("text", " ")})
    tool = F.element_at(F.array(*[F.lit(t) for t in (*TOOLS, "forget")]), (F.col("h") % 4 + 1).cast("int"))
    made = (
        F.when(tool == "search", F.to_json(F.struct(F.col("text").alias("query"), (F.size("w") % 50).alias("limit"))))
        .when(tool == "quote", F.to_json(F.struct(F.col("w").alias("words"))))
        .otherwise(F.to_json(F.struct(F.when(F.size("w") % 5 == 0, "page").otherwise("word").alias("unit"), F.col("text").alias("of"))))
    )
    made = F.when(F.col("h") % 11 == 0, F.left(made, F.length(made) - 1)).otherwise(made)
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    before, after = F.array(name(F.col("turn") - 2)), F.array(name(F.col("turn") + 2))
    depends = F.when((F.col("h") % 3 == 0) & (F.col("turn") >= 3), before).when(F.col("h") % 13 == 0, after).otherwise(F.array().cast("array<string>"))
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = m.filter(is_call).select("conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), made.alias("arguments"), depends.alias("depends_on"))
    results = m.filter(~is_call).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query("op10_tool_calls")
def _op10(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.tool_calls import link

    return link(*tool_messages(table(spark, d, "conversations")), TOOLS)


def _op13_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Ten plain rounds, one step of the WITH list each."""
    gap = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)])".replace("65", str(size + 1))
    near = lambda c: f"(SELECT vec_id, v, arg_min({{'k': k, 'd': d}}, (d, k)) AS best FROM (SELECT rid, vec_id, v, k, {gap} AS d FROM vecs CROSS JOIN {c}) GROUP BY rid, vec_id, v)"
    steps = [f"""vecs AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})"""]
    steps.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c FROM vecs QUALIFY k < {k})")
    for r in range(rounds):
        steps.append(f"p{r} AS MATERIALIZED (SELECT best.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM {near(f'c{r}')}, range(1, {size + 1}) AS pos(i) GROUP BY ALL)")
        steps.append(f"m{r} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS c FROM p{r} GROUP BY k)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    steps.append(f"done AS (SELECT vec_id, best.k AS k, best.d AS d FROM {near(f'c{rounds}')})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM done JOIN c{rounds} USING (k)"""


@query("op13_walsh_centroids", _op13_sql())
def _op13(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm.centroids import cluster

    return cluster(table(spark, d, "embeddings"))


OP12 = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS f FROM sized)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN f <> page_id OR (f IS NOT NULL AND page_id IS NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id OR page_id IS NULL THEN f END AS refers_to
FROM firsts"""


@query("op12_warc_chain", OP12)
def _op12(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm import warc

    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, d, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11 = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(s[i])::BIGINT FOR i IN range(1, length(s) + 1)]), lambda c, x: xor(c >> 8, {_crc32_steps()}[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS h FROM keyed),
damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) AS copy(n) WHERE h <> 0 AND (n = 0 OR h = 3)),
seen AS (SELECT *, left(role, 1) AS i, right(rtrim(text, e' \\t\\n\\x0b\\x0c\\r'), 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
turns AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN again THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, row_number() OVER w AS k, lag(i) OVER w AS before
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again)),
counts AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
moves(q, p, c, l, o) AS (VALUES ('', '', 0, '', ''), ('', 'u', 5, 'I', e'user:\\n'), ('', 'a', 10, 'II', e'user:\\nassistant:\\n'), ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', e'user:\\n'), ('s', 'a', 10, 'II', e'user:\\nassistant:\\n'),
  ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', e'assistant:\\n'), ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', e'user:\\n')),
paths AS (SELECT conv_id, 0::BIGINT AS k, '' AS q, {{'c': 0, 'l': '', 'o': ''}} AS w FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, k, q, arg_min({{'c': c, 'l': l, 'o': o}}, (c, l)) FROM (
    SELECT t.conv_id, t.k, CASE e WHEN 'D' THEN m.p WHEN 'K' THEN t.i WHEN 'R' THEN CASE m.p WHEN 'u' THEN 'a' ELSE 'u' END END AS q, w.c + m.c + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND t.f = 't' THEN 5 ELSE 0 END AS c,
      w.l || m.l || e AS l, w.o || m.o || CASE e WHEN 'D' THEN '' WHEN 'K' THEN t.role || ':' || t.text || chr(10) ELSE CASE m.p WHEN 'u' THEN 'assistant:' ELSE 'user:' END || t.text || chr(10) END AS o
    FROM paths JOIN moves AS m ON paths.q = m.q JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM paths.conv_id AND t.k = paths.k + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS edit(e)
    WHERE e = 'D' OR t.f IN ('', 't') AND (e = 'R' OR t.i = CASE m.p WHEN 'u' THEN 'a' ELSE 'u' END OR m.p = '' AND t.i = 's')) GROUP BY conv_id, k, q),
best AS (SELECT paths.conv_id, arg_min({{'c': w.c + m.c, 'l': w.l || m.l, 'o': w.o || m.o}}, (w.c + m.c, w.l || m.l)) AS w, any_value(gaps) AS gaps, any_value(blank) AS blank, any_value(duplicate) AS duplicate, any_value(truncated) AS truncated, any_value(illegal) AS illegal
  FROM paths LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM paths.conv_id JOIN moves AS m ON paths.q = m.q AND m.p IN ('', 'a') WHERE k = coalesce(n, 0) GROUP BY paths.conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(w.c AS BIGINT) AS cost, w.l AS audit, sha256(left(w.o, greatest(length(w.o) - 1, 0))) AS repaired_sha256 FROM best"""


@query("op11_repair_astar", OP11)
def _op11(spark: SparkSession, d: str) -> DataFrame:
    from sigframe.llm import turn_repair

    return turn_repair.report(*turn_repair.damage(table(spark, d, "conversations")))
