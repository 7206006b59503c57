"""Timelines of medications and events: bars, lanes, range and ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.functions import dates as D


def bars(medications: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """owner, kind, position, start, end, start_month, end_month of every episode and occurrence."""
    m = medications.select("owner", F.lit("medication").alias("kind"), "position", "start_on", "end_on", F.col("still_taking").alias("ongoing"))
    e = events.select("owner", F.lit("event").alias("kind"), "position", "start_on", "end_on", F.col("is_ongoing").alias("ongoing"))
    med = F.col("kind") == "medication"
    end = F.when(med, D.bar_end(F.col("start_on"), F.col("end_on"), F.col("ongoing"), now, True)).otherwise(D.bar_end(F.col("start_on"), F.col("end_on"), F.col("ongoing"), now, False))
    rows = m.unionByName(e).withColumns({"start": D.period_start(F.col("start_on")), "end": end})
    return rows.withColumns({"start_month": D.month_key(F.col("start_on")), "end_month": F.coalesce(D.month_key(F.col("end_on")), F.lit(""))})


def _first_fit(bars: list[tuple]) -> list[tuple]:
    """A bar joins the first lane whose last bar ends by its start, or in its month."""
    lanes: list[int] = []  # the last bar of each
    lane, shown = [], [bar[3] for bar in bars]
    for i, (_, _, start, _, month, _) in enumerate(bars):
        for k, last in enumerate(lanes):
            if start >= bars[last][3] or (bars[last][5] and bars[last][5] == month):
                shown[last] = min(shown[last], start)
                lane.append(k)
                lanes[k] = i
                break
        else:
            lane.append(len(lanes))
            lanes.append(i)
    return [(*bar[:4], k, until) for bar, k, until in zip(bars, lane, shown, strict=True)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of bars, one after the other; the bars of one run are held."""
    names = ["owner", "bar", "start", "end", "lane", "shown_end"]
    held: list[tuple] = []
    types: list[pa.DataType] = []

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for batch in batches:
        kinds = [c.type for c in batch.columns]
        types, done = [*kinds[:4], pa.int32(), kinds[3]], []
        for *bar, head in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if head:
                done += _first_fit(held)
                held = []
            held.append(tuple(bar))
        if done:
            yield packed(done)
    if held:
        yield packed(_first_fit(held))


def lanes(rows: DataFrame) -> DataFrame:
    """rows: owner, bar, start, end, start_month, end_month. Adds lane (from 0) and shown_end,
    where the bar is drawn to. An owner's bars are cut into runs where none of those before is
    still open: every lane is free there, so runs are packed each on its own."""
    types = dict(rows.dtypes)
    schema = f"owner {types['owner']}, bar {types['bar']}, start {types['start']}, end {types['end']}, lane int, shown_end {types['end']}"
    order = Window.partitionBy("owner").orderBy("start", "end", "bar")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.select("owner", "bar", "start", "end", "start_month", "end_month", F.coalesce(F.col("start") >= reached, F.lit(True)).alias("head"))
    runs = cut.withColumn("run", F.count_if("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.repartition("owner", "run").sortWithinPartitions("owner", "run", "start", "end", "bar").drop("run").mapInArrow(_pack, schema)


def time_range(rows: DataFrame) -> DataFrame:
    """first, last day shown: the bars' extent and 3 % of it, or 14 days, on either side."""
    g = rows.agg(F.min("start").alias("a"), F.max("end").alias("b"))
    pad = F.greatest(F.ceil(F.date_diff("b", "a") * 0.03), F.lit(14)).cast("int")
    return g.select(F.date_sub("a", pad).alias("first"), F.date_add("b", pad).alias("last"))


def ticks(range_: DataFrame, n: int = 7) -> DataFrame:
    step = F.date_diff("last", "first") / (n - 1)
    return range_.select("first", "last", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick", "i")).select("tick", F.date_add("first", F.floor(step * F.col("i") + 0.5).cast("int")).alias("day"))
