"""Merges and renames of markers, on parts and line items seen as markers and their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.operators import registry as R
from titerloom.plans.registry import query

MARKERS = """types AS (SELECT p_partkey AS type_id, concat('Marker ', p_partkey) AS name FROM part),
aliases AS (SELECT lower(name) AS alias_key, name AS alias_name, type_id FROM types UNION ALL SELECT concat('code ', type_id), concat('Code ', type_id), type_id FROM types WHERE type_id % 3 = 0),
rows_of AS (SELECT l_partkey AS type_id, l_orderkey AS file_id, count(*) AS n FROM lineitem GROUP BY 1, 2),
tags AS (SELECT p_partkey AS type_id, p_brand AS tag FROM part UNION ALL SELECT p_partkey, concat('size ', p_size % 5) FROM part),
insights AS (SELECT type_id, concat('about ', type_id) AS text FROM types WHERE type_id % 2 = 0)"""
#: Requests, some of which contradict one another.
MERGES = "merges AS (SELECT p_partkey AS n, p_partkey AS source, CASE WHEN p_partkey % 28 = 0 THEN p_partkey - 7 WHEN p_partkey % 35 = 0 THEN -1 ELSE p_partkey - p_partkey % 7 + 1 - 7 END AS target FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 14 = 3)"
RENAMES = """renames AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 9 = 0 THEN concat('Code ', p_partkey) WHEN p_partkey % 25 = 0 THEN 'nobody' ELSE concat('Marker ', p_partkey) END AS name,
  CASE WHEN p_partkey % 30 = 0 THEN NULL WHEN p_partkey % 12 = 0 THEN concat('MARKER ', p_partkey + 1) WHEN p_partkey % 18 = 0 THEN 'Same' ELSE concat('New ', p_partkey % 40) END AS new_name FROM part WHERE p_partkey % 3 = 0)"""


def _views(spark: SparkSession, sf_dir: str, asked: str, name: str) -> tuple[R.Tables, DataFrame]:
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")}
    text = f"WITH {MARKERS}, {asked} SELECT * FROM ".replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}")
    view = lambda v: spark.sql(text + v, **given)
    types = view("types").withColumns({"key": K.alias_key(F.col("name")), "unit": F.lit(None).cast("string")})
    rows = view("rows_of").withColumn("id", F.lit(None).cast("long"))
    return R.Tables(types, view("aliases"), rows, view("tags"), view("insights")), view(name)


MOVES = f"""WITH {MARKERS}, {MERGES},
f AS (SELECT source AS gone, min(n) AS first FROM merges WHERE source <> target GROUP BY source),
res AS (SELECT m.n, m.source, m.target, CASE WHEN s.type_id IS NULL OR t.type_id IS NULL THEN 'marker not found' WHEN m.source = m.target THEN 'nothing to do' WHEN m.n <> a.first THEN 'source is merged twice' WHEN b.gone IS NOT NULL THEN 'target is merged itself' ELSE 'merged' END AS reason
  FROM merges m LEFT JOIN types s ON s.type_id = m.source LEFT JOIN types t ON t.type_id = m.target LEFT JOIN f a ON a.gone = m.source LEFT JOIN f b ON b.gone = m.target),
moves AS (SELECT source, target, n FROM res WHERE reason = 'merged')"""


@query(f"{MOVES} SELECT n, source, target, CASE reason WHEN 'marker not found' THEN 404 WHEN 'merged' THEN 200 WHEN 'nothing to do' THEN 200 ELSE 409 END AS code, reason FROM res")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, asked = _views(spark, sf_dir, MERGES, "merges")
    return R.merge_results(tables.types, asked)


def _moved(table: str, columns: str, keys: str) -> str:
    return f"{table}2 AS (SELECT {columns} FROM (SELECT coalesce(m.target, x.type_id) AS type_id, x.* EXCLUDE (type_id), m.n AS moved FROM {table} x LEFT JOIN moves m ON m.source = x.type_id) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY moved NULLS FIRST) = 1)"


@query(f"""{MOVES}, {_moved('tags', 'type_id, tag', 'type_id, tag')}, {_moved('aliases', 'type_id, alias_key', 'type_id, alias_key')}, {_moved('insights', 'type_id, text', 'type_id')},
r2 AS (SELECT coalesce(m.target, x.type_id) AS type_id, CAST(sum(x.n) AS BIGINT) AS n_rows FROM rows_of x LEFT JOIN moves m ON m.source = x.type_id GROUP BY 1)
SELECT type_id, name, coalesce(n_rows, 0) AS n_rows, (SELECT string_agg(tag, ',' ORDER BY tag) FROM tags2 WHERE tags2.type_id = t.type_id) AS tags, (SELECT string_agg(alias_key, ',' ORDER BY alias_key) FROM aliases2 WHERE aliases2.type_id = t.type_id) AS aliases, text AS insight
FROM types t LEFT JOIN r2 USING (type_id) LEFT JOIN insights2 USING (type_id) WHERE type_id NOT IN (SELECT source FROM moves)""")
def merged_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker that is left, with what it then has."""
    tables, asked = _views(spark, sf_dir, MERGES, "merges")
    out, _ = R.merge(tables, asked)
    joined = lambda df, c, name: df.groupBy("type_id").agg(F.array_join(F.sort_array(F.collect_list(c)), ",").alias(name))
    rows = out.rows.groupBy("type_id").agg(F.sum("n").alias("n_rows"))
    every = out.types.join(rows, "type_id", "left").join(joined(out.tags, "tag", "tags"), "type_id", "left").join(joined(out.aliases, "alias_key", "aliases"), "type_id", "left").join(out.insights, "type_id", "left")
    return every.select("type_id", "name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "tags", "aliases", F.col("text").alias("insight"))


@query(f"""WITH {MARKERS}, {RENAMES},
o AS (SELECT r.*, coalesce(t.type_id, a.type_id) AS type_id, coalesce(u.type_id, b.type_id) AS other FROM renames r LEFT JOIN types t USING (name) LEFT JOIN aliases a ON a.alias_key = lower(r.name) LEFT JOIN types u ON u.name = r.new_name LEFT JOIN aliases b ON b.alias_key = lower(r.new_name)),
p AS (SELECT o.*, t.name AS old_name, CASE WHEN o.type_id IS NULL THEN 'marker not found' WHEN new_name IS NULL THEN 'name is required' WHEN new_name = t.name THEN 'nothing to do' WHEN other <> o.type_id THEN 'name exists' END AS why FROM o LEFT JOIN types t ON t.type_id = o.type_id),
q AS (SELECT *, min(CASE WHEN why IS NULL THEN n END) OVER (PARTITION BY new_name) AS by_name, min(CASE WHEN why IS NULL THEN n END) OVER (PARTITION BY type_id) AS mine FROM p),
z AS (SELECT *, coalesce(why, CASE WHEN n <> by_name THEN 'name exists' WHEN n <> mine THEN 'marker is renamed already' ELSE 'renamed' END) AS reason FROM q)
SELECT n, type_id, old_name, new_name, CASE reason WHEN 'marker not found' THEN 404 WHEN 'name is required' THEN 400 WHEN 'renamed' THEN 200 WHEN 'nothing to do' THEN 200 ELSE 409 END AS code, reason FROM z""")
def rename_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, asked = _views(spark, sf_dir, RENAMES, "renames")
    return R.rename_results(tables, asked)
