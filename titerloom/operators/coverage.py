"""Page coverage, progress and status of files, and texts put together from batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import keys as K


def covered_pages(batches: DataFrame) -> DataFrame:
    """(file_id, page) of the half-open page ranges, each page once."""
    start = F.greatest("start_page", F.lit(0))
    some = batches.where(F.col("stop_page") > start)
    return some.select("file_id", F.explode(F.sequence(F.greatest("start_page", F.lit(0)), F.col("stop_page") - 1)).alias("page")).distinct()


def missing_ranges(files: DataFrame, batches: DataFrame, size: int = 2) -> DataFrame:
    """(file_id, start_page, stop_page) to process: runs of uncovered pages, cut by `size`.

    Works on arrays within a file: no page of any file is shuffled but the covered ones."""
    have = covered_pages(batches).groupBy("file_id").agg(F.collect_list("page").alias("have"))
    j = files.where(F.col("page_count") > 0).join(have, "file_id", "left")
    free = F.array_except(F.sequence(F.lit(0), F.col("page_count") - 1), F.coalesce("have", F.array().cast("array<int>")))
    pages = j.select("file_id", free.alias("free")).select("file_id", F.posexplode("free").alias("at", "page"))
    run = pages.withColumn("run", F.col("page") - F.col("at"))
    first = run.groupBy("file_id", "run").agg(F.min("page").alias("a"), (F.max("page") + 1).alias("b"))
    cut = first.select("file_id", "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(size))).alias("start_page"))
    return cut.select("file_id", "start_page", F.least(F.col("start_page") + size, F.col("b")).alias("stop_page"))


def progress(files: DataFrame, measurements: DataFrame, batches: DataFrame) -> DataFrame:
    """Per file: resolved, failed and all results, newest resolved change, pages covered, complete."""
    counts = measurements.groupBy("file_id").agg(
        F.count_if(F.col("status") == "resolved").alias("ready"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.max(F.when(F.col("status") == "resolved", F.col("updated_at"))).alias("fresh_at"),
    )
    covered = covered_pages(batches).groupBy("file_id").agg(F.count(F.lit(1)).alias("covered"))
    j = files.join(counts, "file_id", "left").join(covered, "file_id", "left").fillna(0, ["ready", "failed", "total", "covered"])
    return j.withColumn("complete", (F.col("covered") >= F.col("page_count")) & (F.col("ready") == F.col("total")))


def file_status(complete: Column, failed: Column, job_failed: Column, leased: Column, pending: Column, any_artifact: Column) -> Column:
    return (
        F.when(complete, F.lit("complete"))
        .when((failed > 0) | job_failed, F.lit("error"))
        .when(leased, F.lit("processing"))
        .when(pending, F.lit("queued"))
        .when(any_artifact, F.lit("processing"))
        .otherwise(F.lit("uploaded"))
    )


def project_status(progress_rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """progress() with status and the error to show: the job's, else the file's own."""
    g = jobs.groupBy("file_id").agg(
        F.max(F.col("status") == "failed").alias("job_failed"),
        F.max(F.col("status") == "leased").alias("leased"),
        F.max(F.col("status") == "pending").alias("pending"),
        F.max_by("error_text", F.when(F.col("status") == "failed", F.struct("updated_at", "id"))).alias("job_error"),
    )
    j = progress_rows.join(g, "file_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    any_artifact = (F.col("covered") > 0) | (F.col("total") > 0)
    return j.withColumn("status", file_status(F.col("complete"), F.col("failed"), flag("job_failed"), flag("leased"), flag("pending"), any_artifact)).withColumn("error", F.when(F.col("status") == "error", F.coalesce("job_error", F.lit("measurement failed"))))


def needs(p: DataFrame) -> DataFrame:
    """progress() with text and summary columns -> the work each file still lacks."""
    tasks = F.array(
        F.when(F.col("covered") < F.col("page_count"), F.lit("extract")),
        F.when(F.col("text_assembled_at").isNull(), F.lit("assemble")),
        F.when(F.col("text_assembled_at").isNotNull() & F.col("summary_generated_at").isNull(), F.lit("summary")),
        F.when(F.col("ready") + F.col("failed") < F.col("total"), F.lit("normalise")),
        F.when(F.col("complete") & F.col("search_indexed_at").isNull(), F.lit("index")),
    )
    return p.withColumn("needs", F.filter(tasks, lambda t: t.isNotNull()))


def assembled_text(batches: DataFrame, file: str, order: list[str], text: str) -> DataFrame:
    """One text a file: its batches' trimmed texts in order, blank ones left out, a blank line between."""
    clean = batches.withColumn("__t", K.document_text(F.col(text))).where(F.col("__t").isNotNull())
    g = clean.groupBy(file).agg(F.sort_array(F.collect_list(F.struct(*order, "__t"))).alias("parts"))
    return g.select(file, F.array_join(F.transform("parts", lambda p: p["__t"]), "\n\n").alias("text"))


def merged_extraction(parts: DataFrame) -> DataFrame:
    """Per file: first lab date and source that aren't empty, in page order, and all measurements."""
    at = F.struct("start_page", "stop_page", "id")
    first = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), at)).alias(c)
    return parts.groupBy("file_id").agg(first("lab_date"), first("source"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start_page", "stop_page", "id", "measurements"))), lambda s: s["measurements"])).alias("measurements"))


def retry_plan(ranges: DataFrame, least_dpi: int = 96, step: int = 24) -> DataFrame:
    """What follows a range that was too much: its single pages, or a page at fewer dots an inch."""
    many = F.col("stop_page") - F.col("start_page") > 1
    pages = F.when(many, F.sequence(F.col("start_page"), F.col("stop_page") - 1)).otherwise(F.array("start_page"))
    dpi = F.when(many, F.col("dpi")).otherwise(F.col("dpi") - step)
    return ranges.select("file_id", F.explode(pages).alias("start_page"), dpi.alias("dpi")).where(F.col("dpi") >= least_dpi).withColumn("stop_page", F.col("start_page") + 1)


def year_buckets(files: DataFrame) -> DataFrame:
    """Files by the year of their date, newest first; those without a date last."""
    day = F.coalesce("lab_date", "uploaded_at")
    return files.withColumns({"day": day, "year": F.year(day)}).withColumn("rn", F.row_number().over(Window.partitionBy("year").orderBy(F.desc_nulls_last("day"), F.desc("file_id"))))
