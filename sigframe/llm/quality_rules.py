"""Quality rules: plain limits first, then robust multivariate outliers.

Rows that pass the plain limits give a vector of five transformed statistics. A row is judged by the first group that has `MIN_ROWS` rows
past the limits: its language and source, its language, all rows. Every such group is fitted on all its rows past the limits, also on those
that are judged by a smaller group. Its minimum-covariance-determinant estimate is found by concentration steps: distances
under the current mean and covariance, then mean and covariance of the `SHARE` of rows nearest. Two fixed starts are taken
(all rows; medians and median deviations) and the smaller determinant wins. After one reweighting step with the usual consistency factors,
rows with a squared Mahalanobis distance above `CUTOFF` are rejected.

Statistics are whole multiples of 1/1024, so sums of values and products are exact whole numbers, and the nearest share is cut at
a bin of the log distance (all ties stay in). Nothing depends on the order of rows. A step aggregates (group, start, bin)
before it shuffles, and group values meet rows by (group, salt), so a source with a third of all rows is no hot key. Most texts have no
symbols or repeats at all, so the square of each statistic's `FLOOR`, the size of a difference that means nothing, is added to its variance.

The cut-off is far above the 97.5 % limit of 12.83. With these floors a squared distance from repeated lines alone is at most
1 / 0.15^2 / 1.0554 = 42.1, from repeated words alone at most 0.5 / 0.12^2 / 1.0554 = 32.9 (beyond a share of 0.5 the plain limit acts), so neither
rejects a row by itself; they count only together with others.

All of it is DataFrame and SQL functions. Three-word windows of one text are compared by 64-bit hash.

Nulls: a null text has no words, so it fails the limits and is not kept; a null language or source is a value like any other. With
fewer than `MIN_ROWS` rows past the limits there is no verdict and those rows are kept. Each input row gives one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigframe.session import materialize

MIN_ROWS, SHARE, STEPS, SALTS = 100, 0.75, 3, 32
UNIT, CUTOFF = 1024, 60.0
FLOOR = [0.05, 0.02, 0.05, 0.12, 0.15]  # per statistic, see _vectors
DIMS = len(FLOOR)
# Fixed values of the chi-squared distribution with 5 degrees of freedom: consistency factors for the nearest 3/4 and for the
# 97.5 % quantile, and that quantile.
NEAR_FACTOR, FAR_FACTOR, FAR_LIMIT = 1.4113, 1.0554, 12.8325
_SPACE = " \t\n\x0b\f\r"
_WORD = r"[^\\x20\\x09-\\x0D]+"
_X = [f"x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every row; one pass, no shuffle, each text on its own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    without = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    rows = rows.withColumn("words", F.expr(f"regexp_extract_all(text, '{_WORD}', 0)"))
    rows = rows.withColumn("lines", F.expr(f"filter(split(text, '\\\\n', -1), l -> l rlike '{_WORD}')"))
    gram = "transform(if(size(words) < 3, array(), sequence(0, size(words) - 3)), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text").cast("long") - without(_SPACE)).alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.expr(gram).alias("g"),
    )
    order = "sort_array(transform(g, (x, i) -> named_struct('g', x, 'i', i)))"
    rows = rows.withColumn("s", F.expr(f"if(size(array_distinct(g)) = size(g), array(), {order})")).drop("g")
    twice = "coalesce(get(s, k - 1).g = x.g, false) or coalesce(get(s, k + 1).g = x.g, false)"
    rows = rows.withColumn("p", F.expr(f"sort_array(filter(transform(s, (x, k) -> if({twice}, x.i, -1)), i -> i >= 0))")).drop("s")
    covered = F.expr("aggregate(transform(p, (i, k) -> least(3, coalesce(get(p, k + 1) - i, 3))), 0, (a, b) -> a + b)")
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("p")


def _by_salt(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join of one small row per key, copied to every salt, so that the rows of a hot key spread."""
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, [key, "salt"], "left")


def _key(level: str, *cols: str) -> Column:
    """Name of a group: its level and its values, with nulls written out."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *cols), {"ignoreNullFields": "false"})


def _groups(rows: DataFrame) -> DataFrame:
    """Adds `grp`, the group that judges the row, and `fits`, the groups in use that it belongs to; sizes count rows past the limits."""
    per = rows.filter("not base_failed").groupBy("pair", "lang_key").agg(F.count(F.lit(1)).alias("n"))
    langs = per.groupBy(F.col("lang_key").alias("l")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("least_pair"))
    whole = langs.agg(F.sum("n_lang").alias("n"), F.min("n_lang").alias("least"))
    named = per.join(langs, per["lang_key"] == langs["l"])
    pair, lang, every = F.col("n") >= MIN_ROWS, F.col("n_lang") >= MIN_ROWS, whole.select("n").scalar() >= MIN_ROWS
    levels = [(pair, F.lit(True), F.col("pair")), (lang, F.col("least_pair") < MIN_ROWS, F.col("lang_key")), (every, whole.select("least").scalar() < MIN_ROWS, _key("all"))]
    grp = F.coalesce(*[F.when(large, key) for large, _, key in levels])
    fits = F.array_compact(F.array(*[F.when(large & used, key) for large, used, key in levels]))
    return _by_salt(rows, named.select("pair", grp.alias("grp"), fits.alias("fits")), "pair")


def _vectors(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.col(b))
    x = [
        F.ln(F.col("word_chars") / F.col("n_words")),
        share("n_symbols", "word_chars"),
        share("n_upper", "word_chars"),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "n_lines"),
    ]
    ok = ~F.col("base_failed")
    return rows.withColumns({k: F.when(ok, F.round(v * UNIT).cast("long")) for k, v in zip(_X, x)})


def _root(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l<i><j> of the covariance v<i><j>, and the log determinant."""
    for i, j in sorted(_PAIRS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"v{i}{j}"))
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return params.withColumn("logdet", reduce(lambda a, b: a + b, [F.ln(F.col(f"l{i}{i}")) for i in range(DIMS)]))


def _solved(params: DataFrame) -> DataFrame:
    """The factor of every estimate, stored: a few rows, and no plan or generated method holds more than one step."""
    return materialize(_root(materialize(params, "moments")), "factors")


def _distance(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds `d2`, the squared distance of x under the joined m and l."""
    for i in range(DIMS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)])
    return rows.withColumn("d2", total / F.lit(scale)).drop(*[f"y{i}" for i in range(DIMS)])


def _sums() -> list[Column]:
    one = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)]]
    return one + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]


def _again() -> list[Column]:
    return [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in _PAIRS]]]


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean m<i> and covariance v<i><j> out of exact sums."""
    m = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)]
    v = []
    for i, j in _PAIRS:
        c = F.col(f"q{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))
        v.append((c + F.lit((FLOOR[i] * UNIT) ** 2) if i == j else c).alias(f"v{i}{j}"))
    return sums.select(*keys, *m, *v)


def _starts(rows: DataFrame) -> DataFrame:
    """Parameters of both starts, per group."""
    all_rows = _estimate(rows.groupBy("grp").agg(*_sums()), ["grp"]).withColumn("start", F.lit(0))
    middle = materialize(rows.groupBy("grp").agg(*[F.median(x).alias(f"m{i}") for i, x in enumerate(_X)]), "medians")
    off = _by_salt(rows, middle, "grp").groupBy("grp").agg(*[F.median(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"d{i}") for i, x in enumerate(_X)])
    wide = [(F.pow(F.col(f"d{i}") * 1.4826, 2) + F.lit((FLOOR[i] * UNIT) ** 2) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS]
    robust = middle.join(off, "grp").select("grp", *[f"m{i}" for i in range(DIMS)], *wide, F.lit(1).alias("start"))
    return all_rows.unionByName(robust)


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Mean and covariance of the rows nearest to each (group, start)."""
    near = _distance(_by_salt(rows, params, "grp"))
    binned = near.groupBy("grp", "start", F.floor(F.ln(F.col("d2") + F.lit(1e-9)) * 64).alias("bin")).agg(*_sums())
    whole = W.partitionBy("grp", "start")
    before = F.sum("n").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    inside = binned.withColumns({"before": F.coalesce(before, F.lit(0)), "all": F.sum("n").over(whole)}).filter(F.col("before") < F.col("all") * SHARE)
    return _solved(_estimate(inside.groupBy("grp", "start").agg(*_again()), ["grp", "start"]))


def outliers(rows: DataFrame) -> DataFrame:
    """Adds `distance` (squared Mahalanobis; null where there is no verdict) to rows of `counts` with x, grp, fits and salt."""
    good = rows.filter("not base_failed").select(F.explode("fits").alias("grp"), "salt", *_X)
    params = _solved(_starts(good))
    for _ in range(STEPS):
        params = _concentrate(good, params)
    best = params.groupBy("grp").agg(F.min_by(F.struct(*[c for c in params.columns if c not in ("grp", "start")]), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    near = _distance(_by_salt(good, materialize(best, "best"), "grp"), NEAR_FACTOR).filter(F.col("d2") <= FAR_LIMIT)
    final = _solved(_estimate(near.groupBy("grp").agg(*_sums()), ["grp"]))
    return _distance(_by_salt(rows, final, "grp"), FAR_FACTOR).withColumnRenamed("d2", "distance")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, distance, kept."""
    rows = counts(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = _vectors(rows.withColumn("base_failed", failed)).drop("n_lines")
    rows = rows.withColumns({
        "pair": _key("pair", "lang", "source"),
        "lang_key": _key("lang", "lang"),
        "salt": F.pmod(F.xxhash64("doc_id", *_X), F.lit(SALTS)).cast("int"),
    })
    rows = materialize(rows.drop("lang", "source"), "counts")
    good = materialize(_groups(rows), "grouped")
    out = outliers(good)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), kept.alias("kept"))
