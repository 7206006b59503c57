"""Histories, overviews, tags and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titerloom.functions import dates as D
from titerloom.functions import keys as K
from titerloom.functions import numbers as N
from titerloom.functions import status as S
from titerloom.operators import effective, history, reports, sets, timeline
from titerloom.plans import adapters as A
from titerloom.plans.registry import query

R = f"r AS ({A.plain(A.RESULTS)})"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.view(spark, sf_dir, A.RESULTS)


def limit_sql(text: str) -> str:
    return f"CASE WHEN {text} LIKE '<%' THEN CAST(substr({text}, 2) AS DOUBLE) END"


def status_sql(v: str, text: str, flag: str, missing: str, lo: str, hi: str) -> str:
    """Only `<` thresholds occur in the view."""
    t = limit_sql(text)
    return f"""CASE WHEN {t} IS NOT NULL AND {t} <= {lo} THEN 'low' WHEN {t} IS NOT NULL AND {t} <= {hi} AND ({lo} IS NULL OR {lo} <= 0) THEN 'in_range'
      WHEN {t} IS NOT NULL AND {lo} IS NULL AND {hi} IS NULL THEN 'in_range' WHEN {flag} THEN 'positive' WHEN NOT {flag} THEN 'negative'
      WHEN {missing} OR {v} IS NULL THEN 'no_range' WHEN {v} < {lo} THEN 'low' WHEN {v} > {hi} THEN 'high' WHEN {lo} IS NOT NULL OR {hi} IS NOT NULL THEN 'in_range' ELSE 'no_range' END"""


OVERVIEW = f"""
{R},
w AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY ts DESC, id DESC) AS rn FROM r),
latest AS (SELECT * FROM w WHERE rn = 1),
prev AS (SELECT * FROM w WHERE rn = 2),
usable AS (SELECT marker, low, high FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY ts DESC, id DESC) AS k FROM r WHERE NOT missing AND (low IS NOT NULL OR high IS NOT NULL)) WHERE k = 1),
rng AS (SELECT l.marker, CASE WHEN l.missing THEN NULL WHEN l.low IS NOT NULL OR l.high IS NOT NULL THEN l.low WHEN l.value IS NULL THEN NULL ELSE u.low END AS lo,
  CASE WHEN l.missing THEN NULL WHEN l.low IS NOT NULL OR l.high IS NOT NULL THEN l.high WHEN l.value IS NULL THEN NULL ELSE u.high END AS hi
  FROM latest l LEFT JOIN usable u USING (marker)),
b AS (SELECT r.marker, {status_sql('r.value', 'r.text', 'r.flag', 'r.missing', 'coalesce(r.low, lo)', 'coalesce(r.high, hi)')} AS s FROM r JOIN rng USING (marker)),
bc AS (SELECT marker, count(*) FILTER (s IN ('negative', 'in_range')) AS n_in, count(*) FILTER (s IN ('positive', 'low', 'high')) AS n_out, count(*) FILTER (s = 'no_range') AS n_none FROM b GROUP BY marker),
agg AS (SELECT marker, max(group_name) AS group_name, count(*) AS total_count, bool_or(value IS NOT NULL AND NOT missing) AS has_numeric_history, count(flag) > 1 AS has_qualitative_trend,
  min(value) FILTER (NOT missing) AS value_min, max(value) FILTER (NOT missing) AS value_max FROM r GROUP BY marker),
o AS (SELECT agg.*, l.id AS latest_id, l.value AS latest_value, p.id AS previous_id, p.value AS previous_value, lo AS range_low, hi AS range_high,
  {status_sql('l.value', 'l.text', 'l.flag', 'l.missing', 'lo', 'hi')} AS status, CASE WHEN NOT l.missing AND hi > lo THEN (l.value - lo) / (hi - lo) END AS pos, n_in, n_out, n_none
  FROM agg JOIN latest l USING (marker) LEFT JOIN prev p USING (marker) JOIN rng USING (marker) JOIN bc USING (marker))
"""
TAGS_SQL = """array_to_string(list_filter([CASE WHEN group_name <> '' THEN concat('group:', group_name) END,
  CASE WHEN total_count = 1 THEN 'singleMeasurement' WHEN total_count > 1 THEN 'multipleMeasurements' END,
  CASE WHEN n_in > 0 AND n_out = 0 THEN 'onlyInRange' END, CASE WHEN n_out > 0 AND n_in = 0 THEN 'onlyOutOfRange' END,
  CASE WHEN n_out > 0 AND (n_in = 0 OR n_out > n_in) THEN 'mostlyOutOfRange' END, CASE WHEN n_out > 0 THEN 'someOutOfRange' END, CASE WHEN n_none > 0 THEN 'noRange' END], lambda x: x IS NOT NULL), ',')"""


@query(f"WITH {OVERVIEW} SELECT marker, group_name, total_count, has_numeric_history, has_qualitative_trend, value_min, value_max, latest_id, latest_value, previous_id, previous_value, range_low, range_high, status, round(pos, 6) AS position, {TAGS_SQL} AS tags FROM o")
def overview_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = history.overview(results(spark, sf_dir))
    return o.select(
        "marker", "group_name", "total_count", "has_numeric_history", "has_qualitative_trend", "value_min", "value_max",
        F.col("latest.id").alias("latest_id"), F.col("latest.value").alias("latest_value"), F.col("previous.id").alias("previous_id"), F.col("previous.value").alias("previous_value"),
        F.col("range.low").alias("range_low"), F.col("range.high").alias("range_high"), "status", F.round("position", 6).alias("position"), F.array_join("tags", ",").alias("tags"),
    )


@query(f"WITH {OVERVIEW} SELECT marker, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' WHEN d = 0 THEN 'unchanged' END AS direction, round(abs(d), 6) AS size FROM (SELECT marker, latest_value - previous_value AS d FROM o)")
def delta_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = history.delta(F.col("latest.value"), F.col("previous.value"))
    return history.overview(results(spark, sf_dir)).withColumn("d", d).select("marker", F.col("d.direction").alias("direction"), F.round("d.size", 6).alias("size"))


@query(f"WITH {OVERVIEW} SELECT marker, n_in, n_out, n_none, {TAGS_SQL} AS tags FROM o WHERE {TAGS_SQL} LIKE '%someOutOfRange%'")
def overview_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that bear every requested tag, derived ones included."""
    o = history.overview(results(spark, sf_dir))
    asked = F.array(F.lit("someOutOfRange"))
    return o.where(F.size(F.array_except(asked, "tags")) == 0).select("marker", "n_in", "n_out", "n_none", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {R}, w AS (SELECT *, row_number() OVER (PARTITION BY marker, file_id ORDER BY ts DESC, id DESC) AS rn FROM r) SELECT marker, file_id, id, rn FROM w WHERE rn <= 8")
def last8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("m", F.col("marker")).withColumn("marker", F.struct("m", "file_id"))
    return history.last_rows(rows, 8).select(F.col("m").alias("marker"), "file_id", "id", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH {R} SELECT marker, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max, count(DISTINCT file_id) AS file_count,
count(low) AS low_count, min(low) AS low_min, max(low) AS low_max, count(high) AS high_count, min(high) AS high_min, max(high) AS high_max FROM r WHERE value IS NOT NULL GROUP BY marker""")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.envelopes(results(spark, sf_dir))


ENVELOPE_OTHERS = f"""{R}, u AS (SELECT * FROM r WHERE value IS NOT NULL), f AS (SELECT DISTINCT marker, file_id FROM u),
p AS (SELECT marker, file_id, count(value) AS vc, min(value) AS vn, max(value) AS vx, count(low) AS lc, min(low) AS ln, max(low) AS lx, count(high) AS hc, min(high) AS hn, max(high) AS hx FROM u GROUP BY 1, 2),
e AS (SELECT f.marker, f.file_id, count(*) AS file_count, sum(vc) AS value_count, min(vn) AS value_min, max(vx) AS value_max, sum(lc) AS low_count, min(ln) AS low_min, max(lx) AS low_max,
  sum(hc) AS high_count, min(hn) AS high_min, max(hx) AS high_max FROM f JOIN p ON p.marker = f.marker AND p.file_id <> f.file_id GROUP BY 1, 2)"""


@query(f"WITH {ENVELOPE_OTHERS} SELECT marker, file_id, file_count, CAST(value_count AS BIGINT) AS value_count, value_min, value_max, CAST(low_count AS BIGINT) AS low_count, low_min, low_max, CAST(high_count AS BIGINT) AS high_count, high_min, high_max FROM e")
def envelope_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.envelopes_without_own_file(results(spark, sf_dir))


@query(f"""WITH {R}, t AS (SELECT marker, file_id, count(*) FILTER (value IS NOT NULL AND NOT missing) AS n1, count(value) AS n2, count(flag) AS n3 FROM r GROUP BY 1, 2)
SELECT marker, file_id, id, CASE WHEN n2 > 0 THEN value ELSE CASE WHEN flag THEN 1.0 ELSE 0.0 END END AS y FROM r JOIN t USING (marker, file_id)
WHERE CASE WHEN n1 > 0 THEN value IS NOT NULL AND NOT missing WHEN n2 > 0 THEN value IS NOT NULL ELSE flag IS NOT NULL AND n3 >= 2 END""")
def sparkline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("m", F.col("marker")).withColumn("marker", F.struct("m", "file_id"))
    return history.sparkline_rows(rows).select(F.col("marker.m").alias("marker"), F.col("marker.file_id").alias("file_id"), "id", "y")


@query(f"""WITH {R}, v AS (SELECT *, concat(marker, ':', file_id) AS k FROM r WHERE value IS NOT NULL), s AS (SELECT k, min(value) AS lo, max(value) AS hi, count(*) AS n FROM v GROUP BY k)
SELECT k AS marker, CASE WHEN max(n) = 1 THEN '1 result' ELSE string_agg(substr('▁▂▃▄▅▆▇█', 1 + CAST(greatest(0, least(7, floor((value - lo) / greatest(hi - lo, 1) * 7 + 0.5))) AS INT), 1), '' ORDER BY ts, id) END AS trend
FROM v JOIN s USING (k) GROUP BY k""")
def trend_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trend_glyphs(results(spark, sf_dir).withColumn("marker", F.concat_ws(":", "marker", F.col("file_id").cast("string"))))


@query(f"""WITH {R}, q AS (SELECT concat(marker, ':', file_id) AS k, ts, id, CASE WHEN flag THEN 'Positive' WHEN NOT flag THEN 'Negative' ELSE text END AS word FROM r),
g AS (SELECT k, count(*) AS n, min(word) AS a, max(word) AS b, arg_min(word, (ts, id)) AS f, arg_max(word, (ts, id)) AS l FROM q WHERE word IS NOT NULL GROUP BY k)
SELECT k AS marker, CASE WHEN a = b AND n = 1 THEN a WHEN a = b THEN concat(a, ' (', n, ')') ELSE concat(f, ' -> ', l) END AS trend FROM g""")
def qualitative_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.qualitative_trend(results(spark, sf_dir).withColumn("marker", F.concat_ws(":", "marker", F.col("file_id").cast("string"))))


REPORT_SQL = f"""WITH {R} SELECT id, group_name AS group_label, CASE WHEN text IS NOT NULL THEN text WHEN value IS NULL THEN '—' ELSE regexp_replace(format('{{:.2f}}', value), '\\.00$', '') END AS value_label,
CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN '5–100' WHEN low IS NOT NULL THEN 'Low 5' WHEN high IS NOT NULL THEN 'High 100' ELSE '—' END AS range_label,
CASE WHEN flag THEN 'positive' WHEN NOT flag THEN 'normal' WHEN value IS NULL THEN 'neutral' WHEN value < low THEN 'low' WHEN value > high THEN 'high' WHEN low IS NULL AND high IS NULL THEN 'neutral' ELSE 'normal' END AS class FROM r"""


@query(REPORT_SQL)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display columns of all results."""
    return reports.report_rows(results(spark, sf_dir)).select("id", "group_label", "value_label", "range_label", "class")


@query(REPORT_SQL)
def report_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of report_rows."""
    return report_rows(spark, sf_dir)


@query("""SELECT l_orderkey AS k, l_linenumber AS line, l_extendedprice AS price, regexp_replace(format('{:.2f}', l_extendedprice), '\\.00$', '') AS shown FROM lineitem""")
def value_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), N.client_number(F.col("l_extendedprice"), F.lit(None).cast("string")).alias("shown"))


@query("""SELECT l_quantity AS q, l_discount AS d, format('{:g}', l_quantity) AS quantity, format('{:g}', l_discount) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
def general_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("q", "d", N.general_number(F.col("q")).alias("quantity"), N.general_number(F.col("d")).alias("discount"), "n")


@query(f"""WITH {R} SELECT id, file_id, marker, group_name AS group_label, coalesce(lag(group_name) OVER (PARTITION BY file_id ORDER BY group_name, ts DESC, marker, id DESC) <> group_name, true) AS head FROM r""")
def group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.report_rows(results(spark, sf_dir))
    return reports.with_group_heads(rows, ["file_id"], [F.col("group_label"), F.desc("ts"), F.col("marker"), F.desc("id")]).select("id", "file_id", "marker", "group_label", "head")


@query(f"""WITH {R}, f AS (SELECT marker, file_id, min(ts) AS t0 FROM r GROUP BY 1, 2) SELECT id, CASE WHEN value IS NOT NULL THEN 'number' ELSE 'flag' END AS kind, epoch_us(ts) // 1000 AS x,
coalesce(value, CASE WHEN flag THEN 1.0 ELSE 0.0 END) AS y FROM r WHERE value IS NOT NULL OR flag IS NOT NULL""")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("m", F.col("marker")).withColumn("marker", F.struct("m", "file_id"))
    return reports.chart_points(rows).select("id", "kind", "x", "y")


_DIGITS = "CASE WHEN {x} = floor({x}) THEN 0 ELSE greatest(0, length(regexp_extract(CAST({x} AS VARCHAR), '\\.(\\d+)', 1)) - coalesce(TRY_CAST(regexp_extract(CAST({x} AS VARCHAR), 'e(-?\\d+)$', 1) AS INT), 0)) END"


@query(f"""WITH {R}, g AS (SELECT concat(marker, ':', file_id) AS marker, min(value) AS a, max(value) AS b, max(low) AS m1, max(high) AS m2 FROM r WHERE value IS NOT NULL GROUP BY 1),
e AS (SELECT marker, m1, m2, CASE WHEN a = b THEN a - CASE WHEN a = 0 THEN 1 ELSE abs(a) * 0.2::DOUBLE END ELSE a END AS lo, CASE WHEN a = b THEN b + CASE WHEN a = 0 THEN 1 ELSE abs(a) * 0.2::DOUBLE END ELSE b END AS hi FROM g),
c AS (SELECT DISTINCT marker, m1, m2, lo, hi, p * CASE WHEN raw / p <= 1 THEN 1 WHEN raw / p <= 2 THEN 2 WHEN raw / p <= 2.5 THEN 2.5::DOUBLE WHEN raw / p <= 5 THEN 5 ELSE 10 END AS step
  FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(raw))) AS p FROM (SELECT *, (hi - lo) / (unnest([4, 5, 6, 7, 8]) - 1) AS raw FROM e))),
d AS (SELECT *, pow(10.0::DOUBLE, {_DIGITS.format(x="step")} + 6) AS f FROM c),
s AS (SELECT *, floor(floor(lo / step) * step * f + 0.5) / f AS first_tick, floor(ceil(hi / step) * step * f + 0.5) / f AS last_tick FROM d),
t AS (SELECT *, list_transform(generate_series(0, greatest(2, CAST(floor((last_tick - first_tick) / step + 0.5) AS BIGINT) + 1) - 1), lambda k: floor((first_tick + step * k) * f + 0.5) / f) AS ticks FROM s),
u AS (SELECT *, ticks[2] - ticks[1] AS gap, len(ticks) AS n FROM t),
w AS (SELECT *, {_DIGITS.format(x="gap")} AS digits FROM u),
x AS (SELECT *, greatest(gap * 0.05::DOUBLE, pow(10.0::DOUBLE, -(digits + 2))) AS near FROM w),
y AS (SELECT *, 3 * len(list_filter([m1, m2], lambda m: m IS NOT NULL AND len(list_filter(ticks, lambda k: abs(k - m) <= near)) = 0)) + greatest(n - 8, 0) * 4 + greatest(4 - n, 0) * 4 + abs(n - 6) + greatest(0, ticks[-1] - ticks[1] - (hi - lo)) / (hi - lo) + digits * 0.25::DOUBLE AS score FROM x)
SELECT marker, ticks[1] AS first, ticks[-1] AS last, gap AS step, CAST(n AS BIGINT) AS n FROM y QUALIFY row_number() OVER (PARTITION BY marker ORDER BY score, step) = 1""")
def nice_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of each marker of each file, that should show its bounds."""
    rows = results(spark, sf_dir).where("value is not null")
    spread = rows.groupBy(F.concat_ws(":", "marker", F.col("file_id").cast("string")).alias("marker")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.array(F.max("low"), F.max("high")).alias("marked"))
    return reports.axes(spread)


@query()
def marker_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.signature(history.overview(results(spark, sf_dir))).select("marker", "signature")


_SAID = {k: "'" + v.replace("'", "''") + "'" for k, v in reports.EXPLAINED.items()}
#: Results with one marker for each type and file, so that there are many histories.
BY_FILE = A.plain(A.RESULTS).replace("event_type AS marker", "concat(event_type, ' ', user_id) AS marker")
OF_FILES = OVERVIEW.replace(R, f"r AS ({BY_FILE})")


@query(f"""WITH {OF_FILES}, x AS (SELECT l.marker, CASE WHEN NOT l.missing THEN l.value END AS v, l.text AS t, l.flag, CASE WHEN NOT p.missing THEN p.value END AS pv, p.text AS pt, lo, hi, o.status FROM o JOIN latest l USING (marker) LEFT JOIN prev p USING (marker) JOIN rng USING (marker))
SELECT marker, array_to_string(list_filter(CASE WHEN v IS NULL AND t IS NOT NULL THEN ['## ' || marker, 'Latest result: **' || t || '**.', CASE WHEN flag THEN {_SAID['positive']} WHEN NOT flag THEN {_SAID['negative']} ELSE {_SAID['qualitative']} END,
  CASE WHEN pt = t THEN 'Compared with the previous result, it is **unchanged** at **' || t || '**.' WHEN pt IS NOT NULL THEN 'Compared with the previous result, it changed from **' || pt || '** to **' || t || '**.' END]
ELSE ['## ' || marker, 'Latest value: **' || coalesce(t, format('{{:g}}', v), 'unavailable') || '**. Status: **' || replace(status, '_', ' ') || '**.', CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'Reference range from the report: **' || format('{{:g}}', lo) || ' to ' || format('{{:g}}', hi) || '**.' END,
  CASE status WHEN 'low' THEN {_SAID['low']} WHEN 'high' THEN {_SAID['high']} WHEN 'in_range' THEN {_SAID['in_range']} END,
  CASE WHEN v IS NOT NULL AND pv IS NOT NULL THEN 'Compared with the previous result, the marker is **' || CASE WHEN v - pv > 0 THEN 'up' WHEN v - pv < 0 THEN 'down' ELSE 'unchanged' END || '** by **' || format('{{:g}}', abs(v - pv)) || '**.' END] END, lambda y: y IS NOT NULL), chr(10) || chr(10)) AS insight FROM x""")
def insight_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation of every marker of every file."""
    rows = spark.sql(A.RESULTS.replace("event_type AS marker", "concat(event_type, ' ', user_id) AS marker"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return reports.insight_line(history.overview(rows)).select("marker", "insight")


@query("""SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 END ELSE l_quantity END AS effective_value,
l_returnflag = 'R' AS has_user_edits, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END, o_orderdate) AS at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def effective_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by flag, null ones included, and the timestamp histories are ordered by."""
    lines, files = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), A.view(spark, sf_dir, A.FILES)
    rows = lines.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("user_value_override"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 2).alias("user_value"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("measured_at"),
    )
    j = effective.with_effective(rows, ("value",)).join(files.select(F.col("file_id").alias("k"), "lab_date", "uploaded_at"), "k")
    return j.select("k", "line", "effective_value", "has_user_edits", effective.effective_timestamp(F.col("measured_at"), F.col("lab_date"), F.col("uploaded_at")).alias("at"))


@query(f"""WITH e AS (SELECT event_id AS id, value, event_id % 3 = 0 AS o, CASE WHEN event_id % 3 = 0 THEN value * 10 END AS u FROM events),
p AS (SELECT event_id AS id, event_id % 4 AS c FROM events WHERE event_id % 2 = 0)
SELECT id, CASE WHEN c = 0 THEN NULL WHEN c = 2 THEN NULL ELSE u END AS user_value, CASE WHEN c = 0 THEN false WHEN c = 2 THEN true ELSE o END AS user_value_override FROM e LEFT JOIN p USING (id)""")
def patch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that reset a field, or set it to null."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    third = F.col("event_id") % 3 == 0
    rows = ev.select(F.col("event_id").alias("id"), "value", third.alias("user_value_override"), F.when(third, F.col("value") * 10).alias("user_value"))
    none = F.create_map(F.lit("value"), F.lit(None).cast("string"))
    edits = ev.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), none.alias("set"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")).alias("reset"))
    return effective.apply_edits(rows, edits, "id", ("value",)).select("id", "user_value", "user_value_override")


TAG_ROWS = f"t AS ({A.plain(A.TAGS)}), n AS (SELECT file_id, CASE WHEN tag LIKE ' source%' THEN concat('source:s-', regexp_extract(tag, '[0-9]+$')) ELSE trim(tag) END AS tag FROM t)"


@query(f"WITH {TAG_ROWS} SELECT file_id FROM n WHERE tag IN ('status:F', '1-URGENT') GROUP BY file_id HAVING count(DISTINCT tag) = 2")
def tags_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.has_all_tags(A.view(spark, sf_dir, A.TAGS).withColumn("tag", K.normal_tag(F.col("tag"))), "file_id", ["status:F", "1-URGENT", "status:F"])


@query(f"WITH {TAG_ROWS} SELECT DISTINCT tag FROM n")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.view(spark, sf_dir, A.TAGS).select(K.normal_tag(F.col("tag")).alias("tag")).distinct()


@query(f"WITH {TAG_ROWS} SELECT file_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, min(CASE WHEN tag LIKE 'source:%' THEN substr(tag, 8) END) AS source FROM n GROUP BY file_id")
def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.view(spark, sf_dir, A.TAGS).groupBy("file_id").agg(F.collect_list("tag").alias("t")).withColumn("t", F.sort_array(K.union_tags(F.col("t"))))
    source = F.element_at(F.filter("t", K.is_source_tag), 1)
    return g.select("file_id", F.array_join("t", ",").alias("tags"), K.source_tag_value(F.when(F.exists("t", K.is_source_tag), source)).alias("source"))


@query("""SELECT o_orderkey AS id, s AS start_on, CAST(CASE WHEN length(s) = 7 THEN CAST(s || '-01' AS DATE) ELSE CAST(s AS DATE) END AS DATE) AS first_day,
CAST(CASE WHEN length(s) = 7 THEN last_day(CAST(s || '-01' AS DATE)) ELSE CAST(s AS DATE) END AS DATE) AS last_day
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("id"), s.alias("start_on")).select("id", "start_on", D.period_start(F.col("start_on")).alias("first_day"), D.period_end(F.col("start_on")).alias("last_day"))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = (F.col("o_orderkey") % 120).cast("int")
    return o.select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("bar"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), days).alias("end"),
        F.date_format("o_orderdate", "yyyy-MM").alias("start_month"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), days), "yyyy-MM")).alias("end_month"),
    )


@query()
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lanes(_episodes(spark, sf_dir))


@query("""SELECT CAST(a - p AS DATE) AS first, CAST(b + p AS DATE) AS last FROM (SELECT a, b, CAST(greatest(ceil((b - a) * 0.03), 14) AS INT) AS p FROM
(SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT)) AS b FROM orders))""")
def timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.time_range(_episodes(spark, sf_dir))


@query("""SELECT o_orderkey AS id, CASE WHEN d < 1 THEN '<1 day' WHEN d < 14 THEN concat(d, ' day', CASE WHEN d = 1 THEN '' ELSE 's' END) WHEN d < 60 THEN concat(CAST(floor(d / 7.0 + 0.5) AS INT), ' week', CASE WHEN floor(d / 7.0 + 0.5) = 1 THEN '' ELSE 's' END)
ELSE concat(CAST(floor(d / 30.44 + 0.5) AS INT), ' month', CASE WHEN floor(d / 30.44 + 0.5) = 1 THEN '' ELSE 's' END) END AS label FROM (SELECT o_orderkey, o_orderkey % 400 AS d FROM orders)""")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), D.duration_label(F.col("o_orderkey") % 400).alias("label"))


@query(f"""WITH {R}, k AS (SELECT file_id, marker, min((ts, id)) AS seen_at FROM r WHERE value IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seen_at) AS rn FROM k)
SELECT file_id, string_agg(marker, ',' ORDER BY rn) AS seen FROM n WHERE rn <= 3 GROUP BY file_id""")
def distinct_with_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three markers of each file, in order of appearance."""
    rows = results(spark, sf_dir).where("value is not null")
    return sets.first_seen(rows, ["file_id"], F.col("marker"), [F.col("ts"), F.col("id")], 3).select("file_id", F.array_join("values", ",").alias("seen"))


@query(f"""WITH {R} SELECT marker, file_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY marker, file_id ORDER BY id) AS rn FROM r WHERE value IS NOT NULL) WHERE rn <= 24""")
def observations_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).where("value is not null")
    return sets.first_rows(rows, ["marker", "file_id"], [F.col("id")], 24).select("marker", "file_id", "id", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH {R} SELECT text, arg_min(id, id) AS id, arg_min(marker, id) AS marker FROM r WHERE text IS NOT NULL GROUP BY text""")
def first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = results(spark, sf_dir).where("text is not null").groupBy("text").agg(F.min_by(F.struct("id", "marker"), "id").alias("s"))
    return g.select("text", "s.id", "s.marker")


STATUS_SQL = f"""WITH {R} SELECT id, {status_sql('value', 'text', 'flag', 'missing', 'low', 'high')} AS status FROM r"""


@query(STATUS_SQL)
def threshold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of all results."""
    return results(spark, sf_dir).select("id", S.status(F.col("value"), F.col("text"), F.col("flag"), F.col("missing"), F.col("low"), F.col("high")).alias("status"))


@query(STATUS_SQL)
def threshold_status_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of threshold_status."""
    return threshold_status(spark, sf_dir)


@query(f"""WITH {R} SELECT file_id, id, rn FROM (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, id DESC) AS rn FROM r) WHERE rn <= 10""")
def recent_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy(F.desc("ts"), F.desc("id"))
    return results(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("file_id", "id", F.col("rn").cast("long").alias("rn"))
