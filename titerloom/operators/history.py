"""Per-marker histories: latest and previous row, reusable range, status, tags, envelopes.

Rows: marker, group_name, file_id, id, ts, value, text, flag, missing, low, high; a history
is ordered by (ts, id). A marker may hold a large share of all rows, so per-marker results are
partial aggregates (max_by and the like) joined back, not windows, wherever a few rows of a
history are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import numbers as N
from titerloom.functions import status as S

POINT = ("id", "ts", "file_id", "value", "text", "flag", "missing", "low", "high")


def order_key() -> Column:
    return F.struct("ts", "id")


def reusable_range(latest: Column, newest: Column) -> Column:
    """struct(low, high) to judge a history by: the latest row's own pair if it has one; the
    newest pair of a convertible row if the latest has a number but no pair; else nulls."""
    none = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    own = latest["low"].isNotNull() | latest["high"].isNotNull()
    pair = F.struct(latest["low"].alias("low"), latest["high"].alias("high"))
    return F.when(latest["missing"], none).when(own, pair).when(latest["value"].isNull(), none).otherwise(F.coalesce(newest, none))


def overview(rows: DataFrame, required_tags: DataFrame | None = None) -> DataFrame:
    """One row per marker: counts, latest, previous, range, status, position, derived tags.
    required_tags: marker, tags; with it stored tags join the derived ones."""
    key = order_key()
    usable = ~F.col("missing") & (F.col("low").isNotNull() | F.col("high").isNotNull())
    shown = F.when(~F.col("missing"), F.col("value"))
    heads = rows.groupBy("marker").agg(
        F.max("group_name").alias("group_name"),
        F.count(F.lit(1)).alias("total_count"),
        F.coalesce(F.max(shown.isNotNull()), F.lit(False)).alias("has_numeric_history"),
        (F.count("flag") > 1).alias("has_qualitative_trend"),
        F.min(shown).alias("value_min"),
        F.max(shown).alias("value_max"),
        F.max_by(F.struct(*POINT), key).alias("latest"),
        F.max_by(F.struct("low", "high"), F.when(usable, key)).alias("newest"),
    )
    heads = heads.withColumn("range", reusable_range(F.col("latest"), F.col("newest"))).drop("newest")
    # Second pass: the row before the latest, and each row's bucket by its own bounds or the range's.
    small = heads.select("marker", F.col("latest.ts").alias("lts"), F.col("latest.id").alias("lid"), "range")
    joined = rows.join(small, "marker")
    bucket = S.range_bucket(S.status(F.col("value"), F.col("text"), F.col("flag"), F.col("missing"), F.coalesce("low", "range.low"), F.coalesce("high", "range.high")))
    rest = joined.withColumn("bucket", bucket).groupBy("marker").agg(
        F.max_by(F.struct(*POINT), F.when(key < F.struct(F.col("lts").alias("ts"), F.col("lid").alias("id")), key)).alias("previous"),
        *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("in", "out", "none")],
    )
    out = heads.join(rest, "marker")
    at = lambda c: F.col(f"latest.{c}")
    status = S.status(at("value"), at("text"), at("flag"), at("missing"), F.col("range.low"), F.col("range.high"))
    tags = S.marker_tags(F.col("group_name"), F.col("total_count"), S.range_tags(F.col("n_in"), F.col("n_out"), F.col("n_none")))
    out = out.withColumns({"status": status, "position": S.range_position(at("value"), at("missing"), F.col("range.low"), F.col("range.high")), "tags": tags})
    if required_tags is not None:
        stored = required_tags.select("marker", F.col("tags").alias("stored"))
        out = out.join(stored, "marker", "left").withColumn("tags", F.array_distinct(F.concat(F.coalesce("stored", F.array().cast("array<string>")), "tags"))).drop("stored")
    return out


def delta(latest: Column, previous: Column) -> Column:
    """struct(direction, size) of the change, if both are numbers."""
    d = latest - previous
    return F.when(d.isNotNull(), F.struct(F.when(d > 0, F.lit("up")).when(d < 0, F.lit("down")).otherwise(F.lit("unchanged")).alias("direction"), F.abs(d).alias("size")))


def last_rows(rows: DataFrame, n: int = 8) -> DataFrame:
    """The last n rows of each history with rn, 1 the latest. The window limit is pushed
    below the shuffle, so each task sends n rows of a marker at most."""
    w = Window.partitionBy("marker").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def signature(overview_rows: DataFrame) -> DataFrame:
    """A digest that changes when anything shown of a marker does."""
    body = F.to_json(F.struct("total_count", "latest", "previous", "range"), {"ignoreNullFields": "false"})
    return overview_rows.withColumn("signature", F.sha2(body, 256))


def envelopes(rows: DataFrame) -> DataFrame:
    """Per marker: spread of finite values and bounds, and the files behind them."""
    used = rows.where(F.col("value").isNotNull())
    v, lo, hi = N.finite(F.col("value")), N.finite(F.col("low")), N.finite(F.col("high"))
    out = used.groupBy("marker").agg(
        F.count(v).alias("value_count"),
        F.min(v).alias("value_min"),
        F.max(v).alias("value_max"),
        F.count_distinct("file_id").alias("file_count"),
        F.count(lo).alias("low_count"),
        F.min(lo).alias("low_min"),
        F.max(lo).alias("low_max"),
        F.count(hi).alias("high_count"),
        F.min(hi).alias("high_min"),
        F.max(hi).alias("high_max"),
    )
    return out.where("value_count > 0")


_SIDES = (("value", "value"), ("low", "low"), ("high", "high"))


def envelopes_without_own_file(rows: DataFrame) -> DataFrame:
    """(marker, file_id) with the envelope of all the marker's other files.

    Without a self-join: per file a partial, per marker the totals and, for each extreme, the best
    file and the runner-up file's value. Counts are total less own; an extreme is the best unless
    that is one's own, then the runner-up's.
    """
    used = rows.where(F.col("value").isNotNull())
    fin = {side: N.finite(F.col(c)) for side, c in _SIDES}
    per_file = used.groupBy("marker", "file_id").agg(
        *[f(fin[s]).alias(f"{s}_{n}") for s in fin for n, f in (("count", F.count), ("min", F.min), ("max", F.max))]
    )
    total = per_file.groupBy("marker").agg(
        F.count(F.lit(1)).alias("files"),
        *[F.sum(f"{s}_count").alias(f"t_{s}_count") for s in fin],
        *[F.min(F.when(F.col(f"{s}_min").isNotNull(), F.struct(f"{s}_min", "file_id"))).alias(f"t_{s}_min") for s in fin],
        *[F.max(F.when(F.col(f"{s}_max").isNotNull(), F.struct(f"{s}_max", "file_id"))).alias(f"t_{s}_max") for s in fin],
    )
    joined = per_file.join(total, "marker")
    second = joined.groupBy("marker").agg(
        *[F.min(F.when(F.col("file_id") != F.col(f"t_{s}_min.file_id"), F.col(f"{s}_min"))).alias(f"r_{s}_min") for s in fin],
        *[F.max(F.when(F.col("file_id") != F.col(f"t_{s}_max.file_id"), F.col(f"{s}_max"))).alias(f"r_{s}_max") for s in fin],
    )
    out = joined.join(second, "marker")
    cols = [(F.col("files") - 1).alias("file_count")]
    for s in fin:
        cols.append((F.col(f"t_{s}_count") - F.col(f"{s}_count")).alias(f"{s}_count"))
        for side in ("min", "max"):
            best = F.col(f"t_{s}_{side}")
            cols.append(F.when(best["file_id"] == F.col("file_id"), F.col(f"r_{s}_{side}")).otherwise(best[f"{s}_{side}"]).alias(f"{s}_{side}"))
    return out.select("marker", "file_id", *cols).where("value_count > 0")


def sparkline_rows(rows: DataFrame) -> DataFrame:
    """Rows to draw: convertible numbers; where a marker has none, any numbers; else flags as 1
    and 0, if there are two."""
    tiers = rows.groupBy("marker").agg(F.count_if(F.col("value").isNotNull() & ~F.col("missing")).alias("n1"), F.count("value").alias("n2"), F.count("flag").alias("n3"))
    joined = rows.join(tiers, "marker")
    numeric = F.when(F.col("n1") > 0, F.col("value").isNotNull() & ~F.col("missing")).otherwise(F.col("value").isNotNull())
    use = F.when((F.col("n1") > 0) | (F.col("n2") > 0), numeric).otherwise(F.col("flag").isNotNull() & (F.col("n3") >= 2))
    y = F.when(F.col("n2") > 0, F.col("value")).otherwise(F.col("flag").cast("double"))
    high = F.when(F.col("n2") > 0, F.col("high")).otherwise(F.lit(0.5))
    return joined.where(use).select("marker", "id", "ts", y.alias("y"), F.when(F.col("n2") > 0, F.col("low")).alias("low"), high.alias("high"))


def trend_glyphs(rows: DataFrame, glyphs: str = "▁▂▃▄▅▆▇█") -> DataFrame:
    """All of a marker's numbers in order, each as one of eight heights over a span of 1 at least."""
    spread = rows.where(F.col("value").isNotNull()).groupBy("marker").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    points = rows.where(F.col("value").isNotNull()).join(spread, "marker")
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    level = F.greatest(F.lit(0), F.least(F.lit(len(glyphs) - 1), F.floor((F.col("value") - F.col("lo")) / span * (len(glyphs) - 1) + 0.5))).cast("int")
    shown = points.withColumn("glyph", F.substring(F.lit(glyphs), level + 1, F.lit(1)))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "glyph"))), lambda s: s["glyph"]), "")
    return shown.groupBy("marker").agg(F.max("n").alias("n"), line.alias("line")).select("marker", F.when(F.col("n") == 1, F.lit("1 result")).otherwise(F.col("line")).alias("trend"))


def qualitative_trend(rows: DataFrame) -> DataFrame:
    """How a marker's words went: one label, one for all with their number, or first -> last."""
    word = F.coalesce(F.when(F.col("flag"), F.lit("Positive")).when(~F.col("flag"), F.lit("Negative")), F.col("text"))
    key = order_key()
    labelled = rows.withColumn("word", word).where(F.col("word").isNotNull())
    g = labelled.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("a"), F.max("word").alias("b"), F.min_by("word", key).alias("first"), F.max_by("word", key).alias("last"))
    same = F.when(F.col("n") == 1, F.col("a")).otherwise(F.concat("a", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    return g.select("marker", F.when(F.col("a") == F.col("b"), same).otherwise(F.concat_ws(" -> ", "first", "last")).alias("trend"))
