"""Quality rules: fixed limits on repetition and length, then robust multivariate outliers.

Per language and source a minimum-covariance-determinant estimate (location and scatter of
the three quarters of the rows whose scatter has the least determinant) is found by
concentration steps from three starts; rows beyond a chi-squared quantile of the Mahalanobis
distance are rejected. DataFrame functions only: words stay arrays within their row, and the
estimates are grouped sums and percentiles of values rounded to 1/64 (so that no group's rows
are gathered): rows whose logarithm of the distance rounds to that of the last one in the
subset belong to it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, let, materialize

WINDOW = 5
#: Scatter added to each transformed statistic's variance (squared): below it a difference counts for little.
FLOORS = {"x_words": 0.2, "x_length": 0.12, "x_symbols": 0.5, "x_lines": 0.35, "x_repeat": 0.1}
#: Share of rows in the concentrated subset, and its consistency factor for five normal dimensions: share / P(chi2(7) <= q), q the chi2(5) quantile of share.
SHARE, CONSISTENCY = 0.75, 1.4538
#: Chi-squared quantile, 5 degrees of freedom, at 1 - 1e-6.
CUTOFF = 35.888
#: Groups with fewer rows are judged with their language's other small groups, and if those are fewer with all rows.
LEAST_ROWS = 100
ALL = "*"
#: Most concentration steps, and the fall of a determinant's logarithm below which it counts as settled.
STEPS, SETTLED = 12, 1e-3
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
BIN = 64


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many of an array's words lie in an ``n``-word window that occurs twice or more in it."""
    none = F.array().cast("array<bigint>")

    def windows(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, every).otherwise(none)

    def covered(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["g"] == e["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == e["g"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(n), F.get(p, i + 1) - x), F.lit(n))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (columns of these names are replaced).

    A null text counts as one without words: zeros, and base_failed.
    """
    w, s = fresh(docs, "_w", "_s")
    t = F.coalesce(F.col(text), F.lit(""))
    in_words = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = F.struct(
        F.size(F.col(w)).cast("long").alias("n_words"),
        in_words.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(w)).cast("long").alias("n_repeat_words"),
    )
    out = docs.withColumn(w, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    out = out.withColumn(s, found).drop(w, *STATISTICS).select("*", f"{s}.*").drop(s)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features(rows: DataFrame) -> DataFrame:
    """The transformed statistics as columns of the names in ``FLOORS``; rows need a word each."""
    return rows.withColumns(
        {
            "x_words": F.log1p("n_words"),
            "x_length": F.log(F.col("word_chars") / F.col("n_words")),
            "x_symbols": F.log1p(1000 * F.col("n_symbols") / F.col("word_chars")),
            "x_lines": F.log1p("n_dup_lines"),
            "x_repeat": F.sqrt(F.col("n_repeat_words") / F.col("n_words")),
        }
    )


def _binned(x: Column) -> Column:
    """Rounded, so that a percentile's state is a bounded number of counts for any number of rows."""
    return F.round(x * BIN) / BIN


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor ``l_i_j``."""
    z: list[Column] = []
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * z[j]
        z.append(rest / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _log_det(n: int) -> Column:
    """Logarithm of a scatter's determinant, from its Cholesky factor."""
    parts = [2 * F.log(f"l_{i}_{i}") for i in range(n)]
    return sum(parts[1:], parts[0])


def _sums(names: list[str]) -> list[Column]:
    n = len(names)
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i in range(n) for j in range(i + 1)]]


def _factor(moments: DataFrame, names: list[str], floors: list[float], consistency: float = CONSISTENCY) -> DataFrame:
    """From the sums over the subset, by _g and _k: means ``m_i``, the Cholesky factor of the corrected covariance and its ``log_det``."""
    n = len(names)
    out = moments.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(n)})
    cov = {f"c_{i}_{j}": consistency * (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) + (floors[i] ** 2 if i == j else 0) for i in range(n) for j in range(i + 1)}
    out = out.withColumns(cov)
    for j in range(n):
        for i in range(j, n):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.select("_g", "_k", *_parameters(n), _log_det(n).alias("log_det"))


def _parameters(n: int) -> list[str]:
    return [f"m_{i}" for i in range(n)] + [f"l_{i}_{j}" for i in range(n) for j in range(i + 1)]


def scatter_groups(rows: DataFrame, lang: str = "_lang", source: str = "_source", least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` with ``_g``: language and source, or a pool of small groups (see ``LEAST_ROWS``)."""
    own = F.to_json(F.struct(F.coalesce(F.col(lang), F.lit("")).alias("l"), F.coalesce(F.col(source), F.lit("")).alias("s")))
    rows_with = rows.withColumns({"_own": own, "_pool": F.to_json(F.struct(F.coalesce(F.col(lang), F.lit("")).alias("l")))})
    kinds = rows_with.groupBy("_own", "_pool").agg(F.count("*").alias("_n"))
    small = kinds.where(F.col("_n") < least).groupBy("_pool").agg(F.sum("_n").alias("_m"))
    keys = kinds.join(small, "_pool", "left").select("_own", F.when(F.col("_n") >= least, F.col("_own")).when(F.col("_m") >= least, F.col("_pool")).otherwise(F.lit(ALL)).alias("_g"))
    return rows_with.join(materialize(keys), "_own").drop("_own", "_pool")


def _starts(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """The estimates that concentration starts from, three a group (``_k``): medians with MADs, medians with the floors, means with covariances."""
    n = len(names)
    middle = materialize(rows.groupBy("_g").agg(*[F.percentile(_binned(F.col(x)), F.lit(0.5)).alias(f"m_{i}") for i, x in enumerate(names)]))
    spread = rows.join(middle, "_g").groupBy("_g").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(n)], *[F.percentile(_binned(F.abs(F.col(x) - F.col(f"m_{i}"))), F.lit(0.5)).alias(f"d_{i}") for i, x in enumerate(names)])
    diagonal = lambda k, of: spread.select("_g", F.lit(k).alias("_k"), *[f"m_{i}" for i in range(n)], *[(of(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(n) for j in range(i + 1)]).withColumn("log_det", _log_det(n))
    mad = diagonal(0, lambda i: F.sqrt((1.4826 * F.col(f"d_{i}")) ** 2 + floors[i] ** 2))
    plain = _factor(rows.groupBy("_g").agg(*_sums(names)).withColumn("_k", F.lit(2)), names, floors, 1.0)
    return mad.union(diagonal(1, lambda i: F.lit(float(floors[i])))).union(plain)


def robust_estimates(rows: DataFrame, names: list[str], floors: list[float], steps: int = STEPS) -> DataFrame:
    """For each ``_g`` of ``rows`` (materialised): ``m_i``, ``l_i_j`` and ``log_det`` of the MCD estimate.

    From each start the ``SHARE`` of rows nearest to the estimate give the next one, until
    no determinant falls by ``SETTLED`` any more (``steps`` times at most); the start that ends with
    the least determinant wins. What a step finds is written, a few rows a group.
    """
    depth = _binned(F.log(_distance(names) + 1e-6))
    params = materialize(_starts(rows, names, floors))
    for step in range(steps):
        limit = rows.join(params, "_g").groupBy("_g", "_k").agg(F.percentile(depth, F.lit(SHARE)).alias("_t"))
        limited = materialize(params.join(limit, ["_g", "_k"]))
        after = materialize(_factor(rows.join(limited, "_g").where(depth <= F.col("_t")).groupBy("_g", "_k").agg(*_sums(names)), names, floors))
        falls = after.select("_g", "_k", F.col("log_det").alias("now")).join(params, ["_g", "_k"]).where(F.col("now") < F.col("log_det") - SETTLED)
        params = after
        if step and falls.isEmpty():
            break
    best = Window.partitionBy("_g").orderBy("log_det", "_k")
    return materialize(params.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_k"))


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without its text: the statistics, ``distance`` and ``kept`` (columns of these names are replaced).

    Rows that fail the fixed limits are not kept, have no distance and do not count in the
    estimates. The others are kept up to a squared distance of ``CUTOFF``. Null languages and
    sources are groups of their own. Rows of groups and languages with fewer than
    ``LEAST_ROWS`` are judged by the estimate of all rows, however many those are.
    """
    names, floors = list(FLOORS), list(FLOORS.values())
    own = [c for c in docs.columns if c not in (*STATISTICS, "distance", "kept", text)]
    # the row's own columns are carried as one, so none can clash with those made here
    carried = docs.select(F.struct(*own).alias("_row") if own else F.struct(F.lit(0).alias("_")).alias("_row"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"))
    stats = materialize(statistics(carried, "_text").drop("_text"))
    rows = materialize(scatter_groups(features(stats.where(~F.col("base_failed")))))
    slim = rows.select("_g", *names)
    rest = slim.where(F.col("_g") == ALL)
    if not rest.isEmpty():
        slim = slim.where(F.col("_g") != ALL).union(slim.withColumn("_g", F.lit(ALL)))
    found = robust_estimates(materialize(slim), names, floors)
    judged = rows.join(found, "_g").withColumn("distance", _distance(names)).withColumn("kept", F.col("distance") <= CUTOFF)
    failed = stats.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    out = ["_row", *STATISTICS, "distance", "kept"]
    return judged.select(out).union(failed.select(out)).select(*[F.col("_row")[c].alias(c) for c in own], *out[1:])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
