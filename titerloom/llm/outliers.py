"""Op 4: quality rules by robust multivariate outliers, built-in functions only.

Counts per text become a vector of four transformed statistics (FEATURES). Rows
are grouped by language and source; groups under MIN_GROUP rows pool by
language. In each group a deterministic minimum-covariance-determinant estimate
is run: start from medians and median absolute deviations, then concentration
steps that keep the SHARE of rows nearest by Mahalanobis distance and re-estimate
mean and covariance. The covariance is regularised towards a diagonal of FLOOR
squares (many groups have no symbol or repetition at all, an exact fit). A row
is rejected if its squared distance exceeds CUTOFF, or a base rule fails.

Each step is one partial aggregation to a row per group and one join back; group
quantiles come from mergeable sketches, so a group with a third of the rows never
meets in one task. Iterations read the narrow statistics table only.

Defined cases: null text has no words and fails the base rule; null language or
source is a group of its own; a pool of under MIN_GROUP rows rejects nobody; ties
at a quantile are all kept in the subset; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import bounded_broadcast, materialize, space_words

FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each feature, in its transformed unit.
FLOOR = (0.08, 0.35, 0.35, 0.9)
MIN_GROUP = 50
#: Groups, of some 600 bytes each, whose tables are broadcast, so that no group's rows meet in one task.
BROADCAST_GROUPS = 20_000
SHARE = 0.75
STEPS = 4
#: A covariance of the nearest 75 % is too small; the factor for four normal variables.
CONSISTENCY = 1.6
#: Squared distance: about the 1 - 1e-8 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 43.0
SYMBOLS = "#*$%&|<>"
RUN = 8


def count_statistics(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words beside doc_id, lang, source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = docs.select(
        "doc_id",
        "lang",
        "source",
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        space_words(text).alias("words"),
    )
    one = split.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    two = one.select(
        "doc_id",
        "lang",
        "source",
        F.size("h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") > RUN, F.col("h")).alias("win"),
    )
    # Hashes of runs of 2, then 4, then 8 words; a run that starts nearer to the end is cut off.
    for half in (1, 2, 4):
        joined = F.zip_with("win", F.slice("win", F.lit(1 + half), F.size("win") - half), lambda a, b: F.xxhash64(a, b))
        two = two.withColumn("win", F.slice(joined, F.lit(1), F.size("win") - half))
    repeated = F.size(F.array_distinct("win")) < F.size("win")
    three = two.withColumn("sorted", F.when(repeated, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("win")
    last = F.size("sorted") - 1
    pairs = F.zip_with(F.slice("sorted", F.lit(1), last), F.slice("sorted", F.lit(2), last), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    four = three.withColumn("at", F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))).drop("sorted")
    gaps = F.zip_with(F.slice("at", F.lit(1), F.size("at") - 1), F.slice("at", F.lit(2), F.size("at") - 1), lambda a, b: F.least(b - a, F.lit(RUN)))
    covered = F.aggregate(gaps, F.lit(RUN), lambda s, g: s + g)
    return four.withColumn("n_repeat_words", F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).cast("long")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def feature_vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.log(chars / words), F.log1p(F.col("n_symbols") * 100 / chars), F.log1p(F.col("n_dup_lines").cast("double")), F.log1p(F.col("n_repeat_words") * 100 / words)]


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance through the Cholesky factor l_i_j of the group."""
    z: list[Column] = []
    for i in range(p):
        r = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l_{i}_{j}") * z[j]
        z.append(r / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factored(groups: DataFrame, p: int) -> DataFrame:
    """Adds the Cholesky factor of c_i_j, one column per projection, so no expression repeats."""
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l_{j}_{j}"))
    return groups


def robust_distances(rows: DataFrame, floor: tuple[float, ...] = FLOOR, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """rows: g (group), x0.. (features), any others. Adds d2, the squared robust distance."""
    p, keep = len(floor), rows.columns
    start = rows.groupBy("g").agg(*[F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"m{i}") for i in range(p)])
    start = bounded_broadcast(materialize(start, "medians"), BROADCAST_GROUPS)
    spread = rows.join(start, "g").groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 2000).alias(f"mad{i}") for i in range(p)],
    )
    groups = spread
    for i in range(p):
        for j in range(i + 1):
            groups = groups.withColumn(f"c_{i}_{j}", F.pow(F.col(f"mad{i}") * 1.4826, 2) + floor[i] ** 2 if i == j else F.lit(0.0))
    for step in range(steps):
        factor = materialize(_factored(groups, p).drop(*[f"c_{i}_{j}" for i in range(p) for j in range(i + 1)]), f"mcd-factor-{step}")
        near = rows.select("g", *[f"x{i}" for i in range(p)]).join(bounded_broadcast(factor, BROADCAST_GROUPS), "g").select("g", *[f"x{i}" for i in range(p)], _distance(p).alias("d2"))
        cut = near.groupBy("g").agg(F.percentile_approx("d2", share, 2000).alias("cut"))
        inner = near.join(bounded_broadcast(materialize(cut, f"mcd-cut-{step}"), BROADCAST_GROUPS), "g").where("d2 <= cut")
        moments = inner.groupBy("g").agg(
            *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)],
            *[F.covar_pop(f"x{i}", f"x{j}").alias(f"v_{i}_{j}") for i in range(p) for j in range(i + 1)],
        )
        groups = moments.select(
            "g",
            *[f"m{i}" for i in range(p)],
            *[(F.col(f"v_{i}_{j}") * CONSISTENCY + (floor[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)],
        )
    final = materialize(_factored(groups, p), "mcd-final")
    return rows.join(bounded_broadcast(final, BROADCAST_GROUPS), "g").select(*keep, _distance(p).alias("d2"))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The statistics of every document with base_failed, distance (null if the base
    fails or the pool is small) and kept."""
    stats = materialize(count_statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    fit = stats.where("not base_failed")
    sizes = fit.groupBy("lang", "source").count()
    absent = F.lit("\u0000")
    lang, source = F.coalesce("lang", absent), F.coalesce("source", absent)
    sized = sizes.select(F.col("lang").alias("sl"), F.col("source").alias("ss"), (F.col("count") >= MIN_GROUP).alias("large"))
    grouped = fit.join(sized, fit["lang"].eqNullSafe(sized["sl"]) & fit["source"].eqNullSafe(sized["ss"])).select(
        *stats.columns, F.when(F.col("large"), F.concat_ws("\u0001", lang, source)).otherwise(F.concat(lang, F.lit("\u0001\u0001"))).alias("g")
    )
    pools = grouped.groupBy("g").count().where(F.col("count") >= MIN_GROUP).select("g")
    vectors = materialize(grouped.join(pools, "g").select("g", *stats.columns, *[x.alias(f"x{i}") for i, x in enumerate(feature_vector())]), "vectors")
    judged = robust_distances(vectors).select(*stats.columns, F.sqrt("d2").alias("distance"), (F.col("d2") <= cutoff).alias("kept"))
    none = F.lit(None).cast("double").alias("distance")
    small = grouped.join(pools, "g", "left_anti").select(*stats.columns, none, F.lit(True).alias("kept"))
    failed = stats.where("base_failed").select(*stats.columns, none, F.lit(False).alias("kept"))
    return judged.unionByName(small).unionByName(failed)
