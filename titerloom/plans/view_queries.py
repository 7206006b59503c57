"""Derived views: filters, labels, segments, cached insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions import numbers as N
from titerloom.functions import status as S
from titerloom.operators import coverage, display, history, reports
from titerloom.plans.marker_queries import OVERVIEW, R, results
from titerloom.plans.registry import query


@query("""SELECT p_partkey AS id FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')""")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return display.text_filter(parts, " Brand#1 ", "p_name", "p_brand", "p_type").select(F.col("p_partkey").alias("id"))


@query(f"""WITH {R}, p AS (SELECT concat(marker, ':', file_id) AS series, id, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS x, value AS y, coalesce(value < low OR value > high, false) AS o FROM r WHERE value IS NOT NULL),
n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(o) OVER w AS o2 FROM p WINDOW w AS (PARTITION BY series ORDER BY x, id)),
a AS (SELECT series, id, 0 AS part, round(CASE WHEN o = o2 THEN y2 ELSE (y + y2) / 2 END, 6) AS y_end, o AS out FROM n WHERE x2 IS NOT NULL UNION ALL SELECT series, id, 1, y2, o2 FROM n WHERE x2 IS NOT NULL AND o <> o2)
SELECT * FROM a""")
def trend_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).where("value is not null")
    out = F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False))
    points = rows.select(F.concat_ws(":", "marker", F.col("file_id").cast("string")).alias("series"), "id", F.unix_millis("ts").cast("double").alias("x"), F.col("value").alias("y"), out.alias("out"))
    return display.segments(points).select("series", "id", "part", F.round("y2", 6).alias("y_end"), "out")


@query(f"""WITH {OVERVIEW} SELECT marker, marker < 'm' AS fresh FROM o""")
def cached_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached texts for markers before the letter m; the others' cache is out of date."""
    current = history.signature(reports.insight_line(history.overview(results(spark, sf_dir))))
    cache = current.select("marker", F.when(F.col("marker") < "m", F.col("signature")).otherwise(F.lit("old")).alias("signature"), F.lit("cached").alias("text"))
    return display.cached_insights(current.select("marker", "signature", "insight"), cache).select("marker", "fresh")


@query(f"""WITH {OVERVIEW} SELECT marker, row_number() OVER (ORDER BY CASE group_name WHEN 'group 0' THEN 20 WHEN 'group 2' THEN 10 END NULLS LAST, group_name, marker) - 1 AS place FROM o""")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.range(2).select(F.when(F.col("id") == 0, F.lit("group 0")).otherwise(F.lit("group 2")).alias("name"), F.when(F.col("id") == 0, 20).otherwise(10).alias("display_order"))
    from pyspark.sql import Window

    markers = results(spark, sf_dir).groupBy("marker").agg(F.max("group_name").alias("group_name"))
    ordered = display.group_order(markers, groups)
    # A handful of groups and markers: the one place where a global order is wanted.
    w = Window.orderBy(F.asc_nulls_last("display_order"), "group_name", "marker")
    return ordered.select("marker", (F.row_number().over(w).cast("long") - 1).alias("place"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 11 AS s FROM orders)
SELECT k AS id, CASE WHEN s = 0 AND c % 2 = 0 THEN concat('no page ', c) WHEN s = 0 THEN 'Processing failed' WHEN s = 1 THEN 'Not processed' WHEN s = 2 THEN 'Queued' WHEN s = 3 AND c % 3 = 0 THEN 'Refreshing search' WHEN s = 3 THEN 'Complete'
WHEN k % 8 < 4 THEN 'Extracting measurements' WHEN c % 5 < 2 THEN 'Normalizing measurements' WHEN k % 7 < 3 THEN 'Extracting text' WHEN c % 7 < 2 THEN 'Assembling text' WHEN c % 13 < 3 THEN 'Generating summary' WHEN c % 17 < 5 THEN 'Resolving source' ELSE 'Processing' END AS label FROM o""")
def processing_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    files = o.select(
        k.alias("id"), F.coalesce(F.try_element_at(F.array(*map(F.lit, ("error", "uploaded", "queued", "complete"))), (k % 11 + 1).cast("int")), F.lit("processing")).alias("status"),
        F.when(c % 2 == 0, F.concat(F.lit("no page "), c.cast("string"))).alias("processing_error"), (c % 3 != 0).alias("search_ready"), (k % 8).alias("measurement_pages_done"), F.lit(4).alias("measurement_pages_total"),
        (c % 5).alias("ready_measurements"), F.lit(2).alias("total_measurements"), (k % 7).alias("text_pages_done"), F.lit(3).alias("text_pages_total"),
        F.when(c % 7 >= 2, F.current_timestamp()).alias("text_assembled_at"), (c % 13 >= 3).alias("summary_ready"), (c % 17 >= 5).alias("source_ready"),
    )
    return files.select("id", display.processing_label().alias("label"))


@query("""SELECT file_id, lab_date, source, n FROM (SELECT l_orderkey AS file_id, min(CASE WHEN l_linenumber > 2 THEN concat('d', l_linenumber) END) AS lab_date, min(CASE WHEN l_linenumber > 1 THEN concat('s', l_linenumber) END) AS source, count(*) AS n FROM lineitem GROUP BY 1)""")
def merged_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    parts = li.select(
        F.col("l_orderkey").alias("file_id"), n.alias("start_page"), (n + 1).alias("stop_page"), F.col("l_partkey").alias("id"), F.when(n > 2, F.concat(F.lit("d"), n.cast("string"))).otherwise(F.lit(" ")).alias("lab_date"),
        F.when(n > 1, F.concat(F.lit("s"), n.cast("string"))).alias("source"), F.array(F.struct(F.col("l_quantity").alias("value"))).alias("measurements"),
    )
    return coverage.merged_extraction(parts).select("file_id", "lab_date", "source", F.size("measurements").cast("long").alias("n"))


@query("""WITH v AS (SELECT l_partkey AS id, l_orderkey AS k, l_suppkey AS s, l_linenumber AS n, l_quantity AS v, CASE WHEN l_linenumber % 2 = 0 THEN CAST(10 AS DOUBLE) END AS lo, CAST(40 AS DOUBLE) AS hi FROM lineitem),
b AS (SELECT *, CASE WHEN lo IS NOT NULL THEN greatest((hi - lo) * 0.4, 0.5) ELSE greatest(abs(v) * 0.2, 1) END AS m FROM v)
SELECT id, k, s, n, round(least(coalesce(lo, v) - m, v - 0.5), 6) AS first, round(greatest(CASE WHEN lo IS NOT NULL THEN hi ELSE v END + m, v + 0.5), 6) AS last, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) END, 6) AS position FROM b""")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    v, lo, hi = F.col("l_quantity"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(10.0)), F.lit(40.0)
    g = reports.gauge_bounds(v, lo, hi)
    return li.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.round(g["a"], 6).alias("first"), F.round(g["b"], 6).alias("last"), F.round(S.range_position(v, F.lit(False), lo, hi), 6).alias("position"))


@query("""SELECT l_partkey AS id, l_orderkey AS k, l_suppkey AS s, l_linenumber AS n, CASE WHEN l_returnflag = 'R' AND l_linenumber <> 3 THEN l_quantity ELSE l_extendedprice END AS shown, abs(l_quantity - l_extendedprice) > 1e-9 * greatest(l_quantity, l_extendedprice, 1) AS rescaled FROM lineitem""")
def display_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shown = display.shown_original(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag") == "R", F.col("l_linenumber") == 3)
    return li.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), shown.alias("shown"), N.was_rescaled(F.col("l_quantity"), F.col("l_extendedprice")).alias("rescaled"))


@query()
def insight_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight rows of each marker as lines of text."""
    return display.history_lines(history.last_rows(results(spark, sf_dir), 8))
