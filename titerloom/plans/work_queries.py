"""Coverage, progress, job selection and the like over orders seen as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.functions.numbers import parse_positive_int
from titerloom.operators import coverage, sets
from titerloom.plans import adapters as A
from titerloom.plans.registry import query
from titerloom.sources import bundle, files as file_sources

B = f"f AS ({A.plain(A.FILES)}), b AS ({A.plain(A.BATCHES)}), cov AS (SELECT DISTINCT file_id, page FROM (SELECT file_id, unnest(generate_series(start_page, stop_page - 1)) AS page FROM b WHERE stop_page > start_page))"
J = f"j AS ({A.plain(A.JOBS)})"
NOW = "timestamp '1999-01-01 00:00:00'"


def _views(spark: SparkSession, sf_dir: str, *sqls: str) -> list[DataFrame]:
    return [A.view(spark, sf_dir, s) for s in sqls]


@query(f"WITH {B} SELECT file_id, count(*) AS covered FROM cov GROUP BY file_id")
def covered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.covered_pages(A.view(spark, sf_dir, A.BATCHES)).groupBy("file_id").agg(F.count(F.lit(1)).alias("covered"))


@query(f"""WITH {B}, free AS (SELECT file_id, page FROM (SELECT file_id, unnest(generate_series(0, page_count - 1)) AS page FROM f) a ANTI JOIN cov USING (file_id, page)),
isl AS (SELECT file_id, page, page - row_number() OVER (PARTITION BY file_id ORDER BY page) AS run FROM free), e AS (SELECT file_id, run, min(page) AS a, max(page) + 1 AS z FROM isl GROUP BY 1, 2),
c AS (SELECT file_id, z, unnest(generate_series(a, z - 1, 2)) AS s FROM e) SELECT file_id, CAST(s AS INT) AS start_page, CAST(least(s + 2, z) AS INT) AS stop_page FROM c""")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, batches = _views(spark, sf_dir, A.FILES, A.BATCHES)
    return coverage.missing_ranges(files, batches)


_RESULTS = "m AS (SELECT l_orderkey AS file_id, CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 'error' WHEN l_returnflag = 'A' AND l_tax > 0.07 THEN 'pending' ELSE 'resolved' END AS status, l_shipdate AS updated_at FROM lineitem)"
PROGRESS = f"""{B}, {_RESULTS}, c AS (SELECT file_id, count(*) FILTER (status = 'resolved') AS ready, count(*) FILTER (status = 'error') AS failed, count(*) AS total, max(updated_at) FILTER (status = 'resolved') AS fresh_at FROM m GROUP BY 1),
v AS (SELECT file_id, count(*) AS covered FROM cov GROUP BY 1),
p AS (SELECT file_id, page_count, coalesce(ready, 0) AS ready, coalesce(failed, 0) AS failed, coalesce(c.total, 0) AS total, fresh_at, coalesce(covered, 0) AS covered FROM f LEFT JOIN c USING (file_id) LEFT JOIN v USING (file_id)),
pr AS (SELECT *, covered >= page_count AND ready = total AS complete FROM p)"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, batches = _views(spark, sf_dir, A.FILES, A.BATCHES)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), F.lit("error")).when((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.07), F.lit("pending")).otherwise(F.lit("resolved"))
    m = li.select(F.col("l_orderkey").alias("file_id"), status.alias("status"), F.col("l_shipdate").alias("updated_at"))
    return coverage.progress(files.select("file_id", "page_count"), m, batches)


@query(f"WITH {PROGRESS} SELECT file_id, ready, failed, total, fresh_at, covered, complete FROM pr")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select("file_id", "ready", "failed", "total", "fresh_at", "covered", "complete")


@query(f"""WITH {PROGRESS}, {J}, g AS (SELECT file_id, bool_or(status = 'failed') AS jf, bool_or(status = 'leased') AS jl, bool_or(status = 'pending') AS jp, arg_max(error_text, (updated_at, id)) FILTER (status = 'failed') AS je FROM j GROUP BY 1),
s AS (SELECT pr.file_id, CASE WHEN complete THEN 'complete' WHEN failed > 0 OR coalesce(jf, false) THEN 'error' WHEN coalesce(jl, false) THEN 'processing' WHEN coalesce(jp, false) THEN 'queued' WHEN covered > 0 OR total > 0 THEN 'processing' ELSE 'uploaded' END AS status, je FROM pr LEFT JOIN g USING (file_id))
SELECT file_id, status, CASE WHEN status = 'error' THEN coalesce(je, 'measurement failed') END AS error FROM s""")
def status_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.project_status(_progress(spark, sf_dir), A.view(spark, sf_dir, A.JOBS)).select("file_id", "status", "error")


@query(f"WITH {J} SELECT id, priority, created_at FROM j WHERE available_at <= {NOW} AND (status = 'pending' OR (status = 'leased' AND lease_until < {NOW})) ORDER BY priority, created_at, id LIMIT 50")
def claim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker's claim: a top-k by nature."""
    return sets.claim(A.view(spark, sf_dir, A.JOBS), F.expr(NOW), 50).select("id", "priority", "created_at")


@query(f"""WITH {J} SELECT id, CASE WHEN status = 'leased' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'leased' THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN status <> 'leased' THEN lease_until END AS lease_until, CASE WHEN status = 'leased' THEN {NOW} ELSE updated_at END AS updated_at FROM j
WHERE NOT ((status = 'resolved' AND updated_at < {NOW} - INTERVAL 6 HOUR) OR (status IN ('failed', 'cancelled') AND updated_at < {NOW} - INTERVAL 48 HOUR))""")
def prune_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.prune(A.view(spark, sf_dir, A.JOBS), F.expr(NOW)).select("id", "status", "attempt_count", "lease_until", "updated_at")


@query(f"""WITH {J} SELECT id, CASE WHEN attempt_count < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN attempt_count < 3 THEN {NOW} + INTERVAL 15 SECOND ELSE available_at END AS available_at FROM j WHERE status = 'failed'""")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.after_failure(A.view(spark, sf_dir, A.JOBS).where("status = 'failed'"), F.expr(NOW)).select("id", "status", "available_at")


@query("""WITH o AS (SELECT 'extract' AS task_type, concat('file:', o_orderkey) AS task_key, CASE WHEN o_orderkey % 3 = 0 THEN 'leased' ELSE 'resolved' END AS status FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT DISTINCT 'extract' AS task_type, concat('file:', l_orderkey) AS task_key FROM lineitem WHERE l_quantity > 45)
SELECT task_type, task_key, CASE WHEN n.task_key IS NOT NULL AND status <> 'leased' THEN 'pending' ELSE status END AS status, n.task_key IS NOT NULL AND status = 'leased' AS rerun_requested FROM o LEFT JOIN n USING (task_type, task_key)
UNION ALL SELECT task_type, task_key, 'pending', false FROM n ANTI JOIN o USING (task_type, task_key)""")
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = lambda c: F.concat(F.lit("file:"), F.col(c).cast("string"))
    jobs = o.where("o_orderkey % 2 = 0").select(F.lit("extract").alias("task_type"), key("o_orderkey").alias("task_key"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("leased")).otherwise(F.lit("resolved")).alias("status"), F.lit(False).alias("rerun_requested"))
    return sets.enqueue(jobs, li.where("l_quantity > 45").select(F.lit("extract").alias("task_type"), key("l_orderkey").alias("task_key")))


@query(f"""WITH {J} SELECT file_id, arg_max(error_text, (updated_at, id)) AS error FROM j WHERE status = 'failed' GROUP BY 1""")
def latest_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = A.view(spark, sf_dir, A.JOBS).where("status = 'failed'")
    return j.groupBy("file_id").agg(F.max_by("error_text", F.struct("updated_at", "id")).alias("error"))


@query(f"WITH f AS ({A.plain(A.FILES)}), {J} SELECT file_id FROM f WHERE code IN ('O', 'P') OR file_id IN (SELECT file_id FROM j WHERE status IN ('pending', 'leased'))")
def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to take up again: by their status, or by a job that waits for them."""
    files, jobs = _views(spark, sf_dir, A.FILES, A.JOBS)
    waiting = jobs.where(F.col("status").isin("pending", "leased")).select("file_id").distinct().withColumn("w", F.lit(True))
    return files.join(waiting, "file_id", "left").where(F.col("code").isin("O", "P") | F.col("w")).select("file_id")


@query("""SELECT o_orderkey AS file_id, o_custkey AS owner FROM orders WHERE o_custkey % 10 <> 0""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left when every tenth customer is deleted with theirs."""
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), A.view(spark, sf_dir, A.FILES)
    _, left = sets.delete_cascade(c, {"files": o}, c.where("c_custkey % 10 = 0"), "c_custkey", "owner")
    return left["files"].select("file_id", "owner")


@query("""WITH d AS (SELECT o_orderkey AS file_id, o_custkey AS owner, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END, o_orderdate) AS day FROM orders)
SELECT file_id, owner, year(day)::INT AS year, rn FROM (SELECT *, row_number() OVER (PARTITION BY owner, year(day) ORDER BY day DESC NULLS LAST, file_id DESC) AS rn FROM d)""")
def file_list_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    files = A.view(spark, sf_dir, A.FILES).withColumn("day", F.coalesce("lab_date", "uploaded_at")).withColumn("year", F.year("day"))
    w = Window.partitionBy("owner", "year").orderBy(F.desc_nulls_last("day"), F.desc("file_id"))
    return files.select("file_id", "owner", "year", F.row_number().over(w).cast("long").alias("rn"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN NULL WHEN 3 THEN 'text/markdown' END AS kind FROM part""")
def upload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k == 0, F.lit(".PDF")).when(k == 1, F.lit(".jpeg")).when(k == 2, F.lit(".xyz")).otherwise(F.lit("")))
    declared = F.when(k == 3, F.lit(" TEXT/x-markdown ; q=1")).when(k == 4, F.lit("image/jpg")).otherwise(F.lit("image/png"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), file_sources.upload_kind(name, declared).alias("kind"))


@query("""SELECT c_custkey AS id, lower(replace(c_name, '#', '')) AS slug, concat('file:', c_custkey, ':text:0:2:144') AS key, c_custkey AS back, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS page FROM customer""")
def task_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = K.file_task_key(F.col("c_custkey"), "text", F.lit(0), F.lit(2), F.lit(144))
    back = K.measurement_of_task(F.concat(F.lit("measurement:"), F.col("c_custkey").cast("string")))
    return c.select(F.col("c_custkey").alias("id"), K.slug(F.col("c_name")).alias("slug"), key.alias("key"), back.alias("back"), parse_positive_int(F.col("c_nationkey").cast("string")).alias("page"))


@query()
def share_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tags = _views(spark, sf_dir, A.FILES, A.TAGS)
    lines = A.view(spark, sf_dir, A.LINES).select("file_id", "id", "type_id", "original_value", "original_unit")
    return bundle.encoded(bundle.file_parts(files, lines, tags)).select("file_id", "json", F.length("base64").alias("length"))


@query("""SELECT l_returnflag AS code, l_linestatus AS status, sum(CASE WHEN l_discount > 0 THEN l_quantity END) AS used FROM lineitem GROUP BY 1, 2""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("status"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("used"))
    return sets.added_up(li, ["code", "status"], "used")


@query("""SELECT file_id, CAST(page AS INT) AS start_page, CAST(page + 1 AS INT) AS stop_page, dpi FROM (SELECT o_orderkey AS file_id, unnest(generate_series(0, 2)) AS page, 144 AS dpi FROM orders WHERE o_orderkey % 2 = 0)
UNION ALL SELECT o_orderkey, 5, 6, CAST(72 + o_orderkey % 100 - 24 AS INT) FROM orders WHERE o_orderkey % 2 = 1 AND 72 + o_orderkey % 100 - 24 >= 96""")
def retry_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    even = F.col("o_orderkey") % 2 == 0
    r = o.select(F.col("o_orderkey").alias("file_id"), F.when(even, 0).otherwise(5).alias("start_page"), F.when(even, 3).otherwise(6).alias("stop_page"), F.when(even, 144).otherwise((72 + F.col("o_orderkey") % 100).cast("int")).alias("dpi"))
    return coverage.retry_plan(r).select("file_id", "start_page", "stop_page", "dpi")
