"""Incremental processing: new raw results meet the rules known so far, micro-batch by micro-batch.

The rule tables are read anew for each batch. Rows still pending are kept beside the
resolved ones and tried again with every batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from titerloom.operators.rules import apply_rules

#: Pages and queued work from which extraction is slowed down, and to how many at a time.
MANY_PAGES, LONG_QUEUE, SLOW = 8, 6, 2

Rules = Callable[[SparkSession], dict[str, DataFrame]]


def process(rows: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    return apply_rules(rows, rules["types"], rules["aliases"], rules["unit_rules"], rules["word_rules"], rules.get("failed"))


def start(source: DataFrame, rules: Rules, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a stream of raw results into out/batch=N. The rows that batch N - 1 left pending are put
    through the rules again with batch N; current() is what stands. A batch written again after a
    failure reads the same batch before it and takes the place of its first attempt, so each row
    counts once."""
    raw = source.columns
    kept = StructType([*source.schema.fields, StructField("status", StringType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            before = spark.read.schema(kept).parquet(f"{out}/batch={number - 1}")
            batch = batch.unionByName(before.where("status = 'pending'").select(*raw))
        process(batch, rules(spark)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """Of the rows that start() wrote, those resolved in any batch and those pending in the last."""
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where((F.col("status") != "pending") | (F.col("batch") == F.lit(last)))


def retry_pending(done: DataFrame, raw_columns: list[str], rules: dict[str, DataFrame]) -> DataFrame:
    """done with its pending rows put through the rules again."""
    again = process(done.where("status = 'pending'").select(*raw_columns), rules)
    return done.where("status != 'pending'").unionByName(again)


def fingerprint(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free sum of their hashes: equal before and after, nothing changed."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def affected_files(rows: DataFrame, learned: DataFrame, keys: list[str]) -> DataFrame:
    """Files with rows that a newly learned rule touches."""
    return rows.join(learned.select(*keys).distinct(), keys, "left_semi").select("file_id").distinct()


def concurrency(pages: int, queued: int, most: int) -> int:
    return min(most, SLOW) if pages >= MANY_PAGES and queued >= LONG_QUEUE else most


def spans_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Spans of a stream of events with ids, each once the watermark has passed its end."""
    e = events.withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", late).alias("w"), "kind", "id").agg(
        F.min(F.when(F.col("what") == "start", F.col("ts"))).alias("start"), F.max(F.when(F.col("what") != "start", F.col("ts"))).alias("end"), F.max(F.col("what") == "error").alias("failed")
    )
    return g.select("kind", "id", "start", "end", F.when(F.col("end").isNull(), F.lit("open")).when(F.col("failed"), F.lit("error")).otherwise(F.lit("done")).alias("status"))
