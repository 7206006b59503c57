"""Keys, number parsing, and learned rules over line items seen as raw results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.functions import numbers as N
from titerloom.operators import history, rules, sets
from titerloom.plans import adapters as A
from titerloom.plans.marker_queries import ENVELOPE_OTHERS, results
from titerloom.plans.registry import query

UNIT_KEY_SQL = "nullif(replace(replace(lower(regexp_replace(regexp_replace(trim({u}), '([0-9]),([0-9])', '\\1.\\2', 'g'), '\\s+', '', 'g')), 'μ', 'u'), 'µ', 'u'), '')"
L = f"l AS ({A.plain(A.LINES)}), ty AS ({A.plain(A.TYPES)}), ur AS ({A.plain(A.UNIT_RULES)})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.view(spark, sf_dir, A.LINES)


@query(f"WITH u AS (SELECT o_orderkey AS id, concat(' ', o_orderkey % 100, ',', o_orderkey % 10, ' µ', CASE WHEN o_orderkey % 2 = 0 THEN 'Mol / L ' ELSE 'g/DL' END) AS unit FROM orders) SELECT id, {UNIT_KEY_SQL.format(u='unit')} AS key FROM u")
def unit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    unit = F.concat(F.lit(" "), (F.col("o_orderkey") % 100).cast("string"), F.lit(","), (F.col("o_orderkey") % 10).cast("string"), F.lit(" µ"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("Mol / L ")).otherwise(F.lit("g/DL")))
    return o.select(F.col("o_orderkey").alias("id"), K.unit_key(unit).alias("key"))


_FOLD = "lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"


ALIAS_SQL = f"WITH w AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT doc_id, line, trim(regexp_replace(replace(regexp_replace({_FOLD.format(x='line')}, '\\s+-\\s*|\\s*-\\s+', ' ', 'g'), '+', ''), '[^a-z0-9]+', ' ', 'g')) AS key FROM w"


@query(ALIAS_SQL)
def alias_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every line of text seen as a name."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("doc_id", "line", K.alias_key(F.col("line")).alias("key"))


@query(ALIAS_SQL)
def alias_key_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of alias_key."""
    return alias_key(spark, sf_dir)


@query(f"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
k AS (SELECT page_id, host, trim(regexp_replace(regexp_replace(regexp_replace({_FOLD.format(x='host')}, '[\\s_./]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS v FROM h)
SELECT page_id, host, CASE WHEN v <> '' THEN concat('source:', v) END AS tag FROM k""")
def source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return pages.select("page_id", "host", K.source_tag(F.col("host")).alias("tag"))


@query("""SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE round(v, 6) END AS number, CASE WHEN id % 4 = 3 THEN concat('about ', id) END AS text FROM
(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 1000 + (o_orderkey % 10) / 10.0 WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 9 + 1) * 1000 + 100 + o_orderkey % 800 ELSE o_totalprice END AS v FROM orders)""")
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal commas, blanks between thousands, plain numbers, and words."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.concat((k % 1000).cast("string"), F.lit(","), (k % 10).cast("string")))
        .when(k % 4 == 1, F.concat((k % 9 + 1).cast("string"), F.lit(" "), (k % 800 + 100).cast("string")))
        .when(k % 4 == 2, F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
        .otherwise(F.concat(F.lit("About "), k.cast("string"), F.lit(".")))
    )
    v = N.parse_value(text)
    return o.select(k.alias("id"), F.round(v["number"], 6).alias("number"), v["text"].alias("text"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '+' WHEN o_orderkey % 3 = 1 THEN 'not detected' ELSE 'reaktiv' END AS key FROM orders""")
def qual_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit(" (+). ")).when(k % 3 == 1, F.lit("Not-  Detected;")).otherwise(F.lit("[RÉAKTIV]"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), K.qualitative_key(text).alias("key"))


@query(f"""WITH {L}, j AS (SELECT l.*, canonical_unit, {UNIT_KEY_SQL.format(u='original_unit')} AS k, CASE WHEN canonical_unit IS NOT NULL THEN 'mmol/l' END AS ck FROM l JOIN ty USING (type_id))
SELECT j.id, j.type_id, k IS NOT NULL AND ck IS NOT NULL AND k <> ck AND ur.factor IS NULL AS conversion_missing, round(CASE WHEN ur.factor IS NOT NULL THEN original_value * ur.factor ELSE original_value END, 6) AS scaled
FROM j LEFT JOIN ur ON ur.type_id = j.type_id AND ur.original_key = k AND ur.canonical_key = ck""")
def missing_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose unit differs from the marker's without a usable rule, and values by rule."""
    types, ur = A.view(spark, sf_dir, A.TYPES), A.view(spark, sf_dir, A.UNIT_RULES)
    rows = _lines(spark, sf_dir).join(types.select("type_id", "canonical_unit"), "type_id").withColumns({"effective_original_unit": F.col("original_unit"), "effective_canonical_unit": F.col("canonical_unit"), "overridden": F.lit(False)})
    m = rules.missing_conversion(rows, ur)
    known = ur.select("type_id", F.col("original_key").alias("k"), F.col("canonical_key").alias("ck"), "factor")
    j = m.withColumns({"k": K.unit_key(F.col("original_unit")), "ck": K.unit_key(F.col("canonical_unit"))}).join(known, ["type_id", "k", "ck"], "left")
    return j.select("id", "type_id", "conversion_missing", F.round(N.scaled(F.col("original_value"), F.col("factor")), 6).alias("scaled"))


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw results: every tenth a word, every fourteenth a threshold, some unnamed."""
    number = ~((F.col("line") == 3) | (F.col("line") == 5))
    text = F.when(F.col("line") == 3, F.when(F.col("type_id") % 2 == 0, F.lit("Negative.")).otherwise(F.lit("odd"))).when(F.col("line") == 5, F.lit("< 5"))
    rows = _lines(spark, sf_dir).select(
        "id", F.when(F.col("type_id") % 13 != 0, F.concat(F.lit("m-"), F.col("type_id").cast("string"))).otherwise(F.lit("unknown name")).alias("raw_name"), F.when(number, F.col("original_value")).alias("original_value"),
        text.alias("original_text"), "original_unit", F.when(F.col("type_id") % 2 == 0, F.lit(5.0)).alias("original_low"), F.lit(50.0).alias("original_high"),
    )
    types = A.view(spark, sf_dir, A.TYPES).withColumn("group_name", F.when(F.col("type_id") % 11 != 0, F.col("group_name")))
    aliases = types.where("type_id % 13 != 0").select(K.alias_key(F.concat(F.lit("m-"), F.col("type_id").cast("string"))).alias("alias_key"), "type_id")
    words = spark.range(1).select(F.lit("negative").alias("word_key"), F.lit("Negative").alias("word"), F.lit(False).alias("flag"))
    return rules.apply_rules(rows, types, aliases, A.view(spark, sf_dir, A.UNIT_RULES), words)


C1_SQL = f"""WITH {L}, a AS (SELECT l.id, l.type_id AS t, line, original_unit, CASE WHEN line NOT IN (3, 5) THEN original_value END AS v, CASE WHEN line = 3 THEN CASE WHEN l.type_id % 2 = 0 THEN 'Negative.' ELSE 'odd' END WHEN line = 5 THEN '< 5' END AS x,
  CASE WHEN l.type_id % 2 = 0 THEN 5.0 END AS lo, 50.0 AS hi, CASE WHEN l.type_id % 13 <> 0 THEN l.type_id END AS type_id, ty.canonical_unit AS cu, l.type_id % 11 = 0 AS no_group FROM l LEFT JOIN ty USING (type_id)),
b AS (SELECT a.*, {UNIT_KEY_SQL.format(u='original_unit')} AS k, ur.type_id IS NOT NULL AS ruled, ur.factor FROM a LEFT JOIN ur ON ur.type_id = a.type_id AND ur.original_key = {UNIT_KEY_SQL.format(u='original_unit')} AND ur.canonical_key = CASE WHEN cu IS NOT NULL THEN 'mmol/l' END),
c AS (SELECT *, k IS NOT NULL AND cu IS NULL AS no_target, k IS NULL OR cu IS NULL OR k = 'mmol/l' AS same FROM b),
d AS (SELECT *, CASE WHEN type_id IS NULL THEN 'marker' WHEN v IS NOT NULL AND NOT no_target AND NOT same AND ruled AND factor IS NULL THEN 'dead'
  WHEN v IS NOT NULL AND no_target THEN 'unit' WHEN v IS NOT NULL AND NOT same AND NOT ruled THEN 'conversion' WHEN line = 3 AND t % 2 = 1 THEN 'word' ELSE 'ok' END AS st FROM c)
SELECT id, type_id, CASE WHEN st = 'dead' THEN 'resolved' WHEN st = 'ok' AND NOT no_group THEN 'resolved' ELSE 'pending' END AS status,
  round(CASE WHEN st = 'ok' AND v IS NOT NULL THEN v * CASE WHEN same THEN 1 ELSE factor END END, 6) AS canonical_value,
  CASE WHEN st <> 'marker' AND line = 3 AND t % 2 = 0 THEN 'Negative' WHEN st <> 'marker' AND line = 5 THEN CASE WHEN lo IS NOT NULL THEN 'low' ELSE 'in_range' END END AS word,
  CASE WHEN st <> 'marker' AND line = 3 AND t % 2 = 0 THEN false WHEN st <> 'marker' AND line = 5 THEN lo IS NOT NULL END AS flag
FROM d"""


@query(C1_SQL)
def c1_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ladder; below 5 against an upper bound of 50 alone is in range."""
    return _ladder(spark, sf_dir).select("id", "type_id", "status", F.round("canonical_value", 6).alias("canonical_value"), F.col("qualitative_value").alias("word"), F.col("qualitative_flag").alias("flag"))


@query(C1_SQL)
def c1_ladder_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of c1_ladder."""
    return c1_ladder(spark, sf_dir)


@query()
def needed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks the ladder asks for, with the number of results that wait for each."""
    return _ladder(spark, sf_dir).select(F.explode("needs").alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("results"))


@query(f"""WITH {L}, j AS (SELECT l.*, {UNIT_KEY_SQL.format(u='original_unit')} AS k FROM l WHERE type_id % 3 <> 1)
SELECT j.id, j.type_id, round(CASE WHEN k IS NULL OR k = 'mmol/l' THEN original_value ELSE original_value * factor END, 6) AS canonical_value, 'mmol/L' AS canonical_unit
FROM j LEFT JOIN ur ON ur.type_id = j.type_id AND ur.original_key = k AND ur.canonical_key = 'mmol/l'""")
def recanonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    rows = _lines(spark, sf_dir).withColumns({"original_low": none, "original_high": none, "canonical_unit": F.lit("mg/dL")})
    units = A.view(spark, sf_dir, A.TYPES).where("type_id % 3 != 1").select("type_id", F.lit("mmol/L").alias("new_unit"))
    out = rules.recanonicalise(rows.select("id", "type_id", "original_value", "original_unit", "original_low", "original_high", "canonical_unit"), units, A.view(spark, sf_dir, A.UNIT_RULES))
    return out.select("id", "type_id", F.round("canonical_value", 6).alias("canonical_value"), "canonical_unit")


@query(f"""WITH {ENVELOPE_OTHERS}, x AS (SELECT r.marker, r.file_id, r.id, CASE WHEN r.id % 50 = 0 THEN r.value * 1000 ELSE r.value END AS v, e.* EXCLUDE (marker, file_id) FROM r LEFT JOIN e USING (marker, file_id) WHERE value IS NOT NULL),
o AS (SELECT *, coalesce(value_count >= 2 AND file_count >= 2 AND value_min > 0 AND value_max / value_min < 10 AND (v < value_min / 10 OR v > value_max * 10), false) AS outlier FROM x)
SELECT id, outlier, CASE WHEN outlier THEN len(list_filter([0.001, 0.01, 0.1, 10, 100, 1000], lambda f: v * f >= value_min - greatest(value_min * 0.1, 1e-9) AND v * f <= value_max + greatest(value_max * 0.1, 1e-9))) ELSE 0 END AS n_candidates FROM o""")
def anomaly_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    off = rows.where("value is not null").select("id", "marker", "file_id", F.when(F.col("id") % 50 == 0, F.col("value") * 1000).otherwise(F.col("value")).alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    out = rules.anomaly_candidates(off, history.envelopes_without_own_file(rows))
    return out.select("id", "outlier", F.size("candidates").cast("long").alias("n_candidates"))


GUIDE_SQL = """WITH q AS (SELECT DISTINCT p_partkey AS type_id, p_brand, p_size FROM part), g AS (SELECT p_partkey AS rule_id, p_partkey AS guide_type, p_brand, p_size FROM part WHERE p_retailprice IS NOT NULL)
SELECT type_id, p_brand AS original_key, concat('s', p_size) AS canonical_key, guide_type, rn FROM (SELECT q.*, guide_type, rule_id, row_number() OVER (PARTITION BY type_id, p_brand, p_size ORDER BY rule_id) AS rn FROM q JOIN g USING (p_brand, p_size) WHERE type_id <> guide_type) WHERE rn <= 3"""


@query(GUIDE_SQL)
def guide_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides for every part among every rule; the first three are the feature."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("type_id"), F.col("p_brand").alias("original_key"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("canonical_key"), F.col("p_retailprice").alias("factor"))
    return rules.guide_rules(part, part).select("type_id", "original_key", "canonical_key", "guide_type", F.col("rn").cast("long").alias("rn"))


@query(GUIDE_SQL)
def guide_top3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another name of guide_top3."""
    return guide_top3(spark, sf_dir)


@query("""WITH n AS (SELECT l_partkey % 3000 AS k, arg_max(l_orderkey, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 8 + l_linenumber) AS v FROM lineitem GROUP BY 1), o AS (SELECT p_partkey AS k, -1 AS v FROM part)
SELECT k, CAST(v AS BIGINT) AS v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    new = _lines(spark, sf_dir).select((F.col("type_id") % 3000).alias("k"), F.col("file_id").alias("v"), "id")
    return sets.upsert(old, new, ["k"], "id")


@query("""WITH n AS (SELECT l_partkey % 3000 AS k, arg_min(l_orderkey, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 8 + l_linenumber) AS v FROM lineitem GROUP BY 1), o AS (SELECT p_partkey AS k, -1 AS v FROM part WHERE p_partkey % 2 = 0)
SELECT k, CAST(v AS BIGINT) AS v FROM o UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM o)""")
def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    new = _lines(spark, sf_dir).select((F.col("type_id") % 3000).alias("k"), F.col("file_id").alias("v"), "id")
    return sets.insert_missing(old, new, ["k"], "id")


@query("""SELECT p_partkey AS id, CAST(CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 WHEN 3 THEN 1000.0 END AS DOUBLE) AS factor, CAST(CASE p_size % 5 WHEN 4 THEN NULL WHEN 0 THEN 100.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.1 WHEN 3 THEN 100000.0 END AS DOUBLE) AS to_percent FROM part""")
def dimensionless_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 5
    unit = F.when(s == 0, F.lit("1")).when(s == 1, F.lit(" %")).when(s == 2, F.lit("‰")).when(s == 3, F.lit("L / mL")).otherwise(F.lit("mg/dL"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.round(N.dimensionless_factor(unit), 9).alias("factor"), F.round(N.deterministic_factor(unit, F.lit("%")), 6).alias("to_percent"))


@query("""WITH p AS (SELECT p_brand AS b, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'mg / dL' WHEN p_size % 3 = 1 THEN 'MG/dl' ELSE NULL END AS unit FROM part)
SELECT b AS type_id, arg_min(unit, id) FILTER (unit IS NOT NULL) AS unit, true AS settled FROM p GROUP BY b""")
def canonical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 3
    unit = F.when(s == 0, F.lit("mg / dL")).when(s == 1, F.lit("MG/dl"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("type_id"), F.col("p_partkey").alias("id"), unit.alias("unit"), F.lit(None).cast("string").alias("existing_unit"))
    return rules.canonical_units(rows)
