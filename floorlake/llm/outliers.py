"""Quality rules: base rules, and robust multivariate outliers per language and source.

DataFrame functions only. Each document gives a vector of transformed statistics. For every group
of language and source a minimum-covariance-determinant estimate is made: from the rows nearest to
the medians on, the mean and covariance of the nearest ``SHARE`` of rows are taken again and again, which
never raises the determinant. A document is rejected if its squared Mahalanobis distance is beyond
``CUT``. The steps read only the narrow table of statistics; a group of any size is a few sums, combined before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WIDTH = 5
#: Share of a group's rows that the estimate rests on, and the number of concentration steps.
SHARE, STEPS = 0.75, 4
#: Squared distance beyond which a document is rejected: the chi-square quantile of 1 - 1e-8 for five statistics.
CUT = 45.0
_MEDIAN = 4.3515  # the median of that chi-square distribution
#: Groups of fewer rows are measured against all rows of their language, or against all rows where those are few too.
LEAST = 60
_ALL = "{}"  # the pool of all rows
#: Names of the statistics, and the least standard deviation that each is given.
STATISTICS = {"x1": 0.25, "x2": 0.25, "x3": 0.06, "x4": 0.3, "x5": 0.1}


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` -> the other columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    rows = docs.select(*rest, F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("_words"), lines.alias("_lines"),
                       F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counts = ["word_chars", "n_symbols", "n_words", "n_dup_lines"]
    windows = F.when(F.size("_words") >= WIDTH, F.transform(F.sequence(F.lit(1), F.size("_words") - (WIDTH - 1)), lambda i: F.xxhash64(F.slice("_words", i, WIDTH))))
    rows = rows.select(*rest, "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.coalesce(windows, F.array().cast("array<bigint>")).alias("_windows"))
    # Only texts with a repeated window have their windows sorted.
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*rest, *counts, F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).alias("_placed"))
    again = F.filter("_placed", lambda x, i: F.coalesce(x["h"] == F.get("_placed", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_placed", i + 1)["h"], F.lit(False)))
    rows = rows.select(*rest, *counts, F.when(F.col("_placed").isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))).alias("_spots"))
    covered = F.aggregate(F.transform("_spots", lambda p, i: F.least(F.lit(WIDTH), F.coalesce(F.get("_spots", i + 1) - p, F.lit(WIDTH)))), F.lit(0), lambda s, x: s + x)
    return rows.select(*rest, *counts, F.when(F.col("_spots").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _with_groups(rows: DataFrame) -> DataFrame:
    """``grp``: the smallest of source, language and all rows that is large enough; ``judged``: whether the row is measured against it.

    A row that passes the base rules is there once more, not ``judged``, for every other pool that a small group needs,
    so that a pool rests on all rows of its language, or on all rows.
    """
    keep = {"ignoreNullFields": "false"}  # else a null source would share its text with the language
    rows = rows.withColumns({"_fine": F.to_json(F.struct("lang", "source"), keep), "_coarse": F.to_json(F.struct("lang"), keep)})
    sizes = written(rows.groupBy("_coarse", "_fine").agg(F.count_if(~F.col("base_failed")).alias("_n")), "sizes")
    few = F.col("_n").between(1, LEAST - 1)
    langs = written(sizes.groupBy("_coarse").agg(F.sum("_n").alias("_all"), F.coalesce(F.bool_or(few), F.lit(False)).alias("_few")), "sizes")
    # A language of few rows has small groups only, so they need the last pool, whatever its size.
    last = not langs.where(F.col("_all").between(1, LEAST - 1)).isEmpty()
    many, pooled = F.col("_n") >= LEAST, F.col("_all") >= LEAST
    groups = sizes.join(langs, "_coarse").select(
        "_fine",
        F.when(many, F.col("_fine")).when(pooled, F.col("_coarse")).otherwise(F.lit(_ALL)).alias("_own"),
        F.array_compact(F.array(F.when(pooled & F.col("_few"), F.col("_coarse")), F.lit(_ALL if last else None).cast("string"))).alias("_pools"),
    )
    rows = rows.join(groups, "_fine")
    pools = F.when(F.col("base_failed"), F.array("_own")).otherwise(F.array_union(F.array("_own"), F.col("_pools")))
    rows = rows.withColumn("grp", F.explode(pools)).withColumn("judged", F.col("grp") == F.col("_own"))
    return rows.drop("_fine", "_coarse", "_own", "_pools")


def _statistics(rows: DataFrame) -> DataFrame:
    """Transformed statistics: length, word length against the group's, and the shares of symbols, repeated lines and repeated words."""
    means = rows.where("not base_failed").groupBy("grp").agg((F.sum("word_chars") / F.sum("n_words")).alias("_mean"))
    rows = rows.join(means, "grp", "left")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    # Few words say little about their mean length, so it is drawn towards the group's.
    return rows.withColumns({
        "x1": F.log1p("n_words"),
        "x2": (F.col("word_chars") / n - F.coalesce("_mean", F.lit(0.0))) * F.sqrt(n / (n + 200)),
        "x3": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x4": F.log1p("n_dup_lines"),
        "x5": F.sqrt(F.col("n_repeat_words") / n),
    }).drop("_mean")


def _factor(estimates: DataFrame) -> DataFrame:
    """Lower triangular factor of every group's covariance, as columns l11, l21, ..."""
    names = list(STATISTICS)
    for i, a in enumerate(names, 1):
        for j, b in enumerate(names[:i], 1):
            value = F.col(f"c{i}{j}")
            for k in range(1, j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value + STATISTICS[a] ** 2, F.lit(STATISTICS[a] ** 2))) if a == b else value / F.col(f"l{j}{j}"))
    return estimates.drop(*[f"c{i}{j}" for i in range(1, len(names) + 1) for j in range(1, i + 1)])


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``d``, the squared distance from their group's centre (null without a group)."""
    names, used = list(STATISTICS), [c for c in estimates.columns if c != "grp"]
    rows = rows.join(estimates, "grp", "left")
    for i, a in enumerate(names, 1):
        value = F.col(a) - F.col(f"m{i}")
        for k in range(1, i):
            value = value - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(2, len(names) + 1)), F.col("y1") * F.col("y1"))
    return rows.withColumn("d", total).drop(*[f"y{i}" for i in range(1, len(names) + 1)], *[c for c in used if c != "scale"])


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and covariance of every group's rows."""
    names = list(STATISTICS)
    means = [F.avg(a).alias(f"m{i}") for i, a in enumerate(names, 1)]
    shared = [F.covar_pop(a, b).alias(f"c{i}{j}") for i, a in enumerate(names, 1) for j, b in enumerate(names[:i], 1)]
    return _factor(rows.groupBy("grp").agg(*means, *shared))


def minimum_covariance(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``rows``: grp, x1 to x5 -> per group the centre, the factor of the covariance, and ``scale`` of its distances."""
    names = list(STATISTICS)
    centres = rows.groupBy("grp").agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"m{i}") for i, a in enumerate(names, 1)])
    away = rows.join(centres, "grp").groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(a) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, a in enumerate(names, 1)])
    start = centres.join(away, "grp")
    for i, a in enumerate(names, 1):
        for j in range(1, i + 1):
            start = start.withColumn(f"c{i}{j}", F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0))
    estimates = written(_factor(start.drop(*[f"s{i}" for i in range(1, len(names) + 1)])), "estimates")
    for _ in range(steps):
        measured = _distance(rows, estimates)
        cuts = measured.groupBy("grp").agg(F.percentile_approx("d", SHARE, 1000).alias("_cut"))
        estimates = written(_estimate(measured.join(cuts, "grp").where("d <= _cut")), "estimates")
    spread = _distance(rows, estimates).groupBy("grp").agg(F.greatest(F.percentile_approx("d", 0.5, 1000) / _MEDIAN, F.lit(1.0)).alias("scale"))
    return written(estimates.join(spread, "grp"), "estimates")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """-> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance; one row per row of ``docs``.

    Estimates are made of the rows that pass the base rules. A null text has no words, so it fails them. Null languages and
    sources are groups of their own. Ids may be null or repeat. Every row that passes the base rules has a
    ``distance``; it is null only for rejected rows of a group without an estimate. ``keys`` names further columns to carry; no other is read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), *[F.col(k) for k in keys], F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = written(text_statistics(narrow).withColumn("base_failed", base_failed()), "statistics")
    rows = written(_statistics(_with_groups(rows)), "statistics")
    estimates = minimum_covariance(rows.where("not base_failed").select("grp", *STATISTICS))
    judged = _distance(rows.where("judged"), estimates).withColumn("distance", F.col("d") / F.col("scale"))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUT)
    return judged.select("doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
