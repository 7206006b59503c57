"""Spans rebuilt from log messages, which are made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.operators import logspans
from titerloom.plans import adapters as A
from titerloom.plans.registry import query

EV = f"""l AS ({A.plain(A.LOG_EVENTS)}), ev AS (SELECT entry, ts, kind, CASE WHEN message LIKE '% start %' THEN 'start' ELSE 'finish' END AS what,
  regexp_extract(message, ' id=(\\S+)', 1) AS id, nullif(regexp_extract(message, ' file=(\\S+)', 1), '') AS file, nullif(regexp_extract(message, ' lane=(\\S+)', 1), '') AS lane,
  CAST(regexp_extract(message, ' pages=(\\S+)', 1) AS BIGINT) AS pages, CAST(regexp_extract(message, ' duration_ms=(\\S+)', 1) AS BIGINT) AS duration_ms,
  CAST(regexp_extract(message, ' input_tokens=(\\S+)', 1) AS BIGINT) AS input_tokens, CAST(regexp_extract(message, ' output_tokens=(\\S+)', 1) AS BIGINT) AS output_tokens FROM l)"""
SPANS = f"""{EV}, g AS (SELECT kind, id, min(ts) FILTER (what = 'start') AS b, max(ts) FILTER (what = 'finish') AS e, max(duration_ms) AS d, max(file) AS file, max(lane) AS lane, max(pages) AS pages, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens FROM ev GROUP BY 1, 2),
s0 AS (SELECT *, coalesce(b, e - to_milliseconds(coalesce(d, 0))) AS s, CASE WHEN e IS NULL THEN 'open' ELSE 'done' END AS status FROM g),
sp AS (SELECT *, greatest(coalesce(e, (SELECT max(ts) FROM ev)), s) AS z FROM s0), spans AS (SELECT *, epoch_us(z) // 1000 - epoch_us(s) // 1000 AS ms FROM sp)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.events(A.view(spark, sf_dir, A.LOG_EVENTS).drop("kind"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.pair_by_key(events(spark, sf_dir), ["kind", "id"])


@query(f"WITH {EV} SELECT entry, kind, what, id, file, lane, pages, duration_ms, input_tokens FROM ev")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("entry", "kind", "what", "id", "file", "lane", "pages", "duration_ms", "input_tokens")


@query(f"WITH {SPANS} SELECT kind, id, s AS start, z AS end_at, status, ms FROM spans")
def log_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("kind", "id", "start", F.col("end").alias("end_at"), "status", "ms")


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY kind, file, what ORDER BY ts, entry) AS nth FROM ev WHERE file IS NOT NULL)
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.file, b.file) AS file, coalesce(a.nth, b.nth) AS nth, a.ts AS start, b.ts AS end_at FROM (SELECT * FROM n WHERE what = 'start') a FULL JOIN (SELECT * FROM n WHERE what = 'finish') b ON a.kind = b.kind AND a.file = b.file AND a.nth = b.nth""")
def log_pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = logspans.pair_in_order(events(spark, sf_dir).where("file is not null"), ["kind", "file"])
    return p.select("kind", "file", F.col("nth").cast("long").alias("nth"), "start", F.col("end").alias("end_at"))


@query(f"""WITH {EV}, o AS (SELECT *, concat_ws(':', kind, file) AS signature FROM ev),
b AS (SELECT *, sum(CASE WHEN what = 'start' THEN 1 ELSE -1 END) OVER (PARTITION BY signature ORDER BY ts, entry ROWS UNBOUNDED PRECEDING) AS balance FROM o),
m AS (SELECT *, what = 'finish' AND balance < least(0, min(balance) OVER (PARTITION BY signature ORDER BY ts, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS lone FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY signature, what, lone ORDER BY ts, entry) AS nth FROM m)
SELECT s.signature, s.ts AS start, f.ts AS end_at, CASE WHEN f.ts IS NULL THEN 'open' ELSE 'done' END AS status FROM (SELECT * FROM k WHERE what = 'start') s LEFT JOIN (SELECT * FROM k WHERE what = 'finish' AND NOT lone) f ON s.signature = f.signature AND s.nth = f.nth
UNION ALL SELECT signature, ts - to_milliseconds(coalesce(duration_ms, 0)), ts, 'done' FROM k WHERE lone""")
def log_pair_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event; those without a file share their kind's signature."""
    ev = events(spark, sf_dir).withColumn("sig", F.concat_ws(":", "kind", "file"))
    return logspans.pair_fifo(ev, "sig").withColumnRenamed("end", "end_at")


@query(f"""WITH {SPANS} SELECT coalesce(lane, 'unknown') AS lane, count(*) AS n, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS avg_ms, max(ms) AS max_ms, count(DISTINCT file) AS files,
CAST(floor(coalesce(sum(input_tokens), 0) / count(*) + 0.5) AS BIGINT) AS avg_input, CAST(floor(coalesce(sum(output_tokens), 0) / count(*) + 0.5) AS BIGINT) AS avg_output, CAST(0 AS BIGINT) AS cached FROM spans WHERE kind = 'request' GROUP BY 1""")
def lane_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.lane_stats(spans(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT file, count(*) AS spans, count(*) FILTER (kind = 'job') AS jobs, count(*) FILTER (kind = 'request') AS requests, CAST(0 AS BIGINT) AS errors, CAST(coalesce(sum(pages) FILTER (kind = 'job'), 0) AS BIGINT) AS pages, max(ms) AS max_ms FROM spans WHERE file IS NOT NULL GROUP BY 1""")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.file_stats(spans(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT pages, count(*) AS jobs, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms, round(avg(ms), 6) AS avg_ms FROM spans WHERE kind = 'job' AND pages IS NOT NULL GROUP BY 1""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.batch_stats(spans(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {SPANS} SELECT pages, count(*) AS jobs FROM spans WHERE kind = 'job' AND pages IS NOT NULL GROUP BY 1 ORDER BY jobs DESC, pages LIMIT 1")
def most_common_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row is the feature."""
    return logspans.most_common_batch(logspans.batch_stats(spans(spark, sf_dir))).select("pages", "jobs")


@query(f"""WITH {SPANS} SELECT count(*) AS spans, count(*) FILTER (kind = 'job') AS jobs, count(*) FILTER (kind = 'request') AS requests, CAST(0 AS BIGINT) AS errors, count(*) FILTER (status = 'open') AS open, max(pages) FILTER (kind IN ('job', 'range')) AS largest_batch, max(ms) AS longest_ms,
CAST(coalesce(sum(input_tokens) FILTER (kind = 'request' AND input_tokens > 0), 0) AS BIGINT) AS input_tokens, CAST(floor(avg(input_tokens) FILTER (kind = 'request' AND input_tokens > 0) + 0.5) AS BIGINT) AS avg_input_tokens, count(DISTINCT file) AS files FROM spans""")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.summary(spans(spark, sf_dir))


@query(f"WITH {SPANS} SELECT coalesce(file, 'global') AS file, min(s) AS start, count(*) AS n FROM spans GROUP BY 1")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logspans.waterfall(spans(spark, sf_dir)).select("file", "start", "n")
