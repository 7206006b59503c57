"""Spans rebuilt from log lines: events by pattern, starts paired with finishes, statistics.

Events: entry, ts, source, job, kind, what (start or finish), signature, file, pages, duration_ms, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(\S+)\s+(.*)$"
#: Order of the kinds of spans on screen.
KINDS = ("task", "job", "range", "batch", "render", "request", "summary", "source", "marker", "error")


def header(line: Column) -> Column:
    part = lambda k: F.regexp_extract(line, HEADER, k)
    return F.struct(F.try_to_timestamp(F.regexp_replace(part(1), ",", ".")).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("message"))


def entries(lines: DataFrame) -> DataFrame:
    """lines: file, line_no, line. A line with a header opens an entry, those after it continue
    it, and lines before the first header of a file are dropped. The running count is taken
    within a file."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = lines.withColumn("entry", F.sum(F.rlike("line", F.lit(HEADER)).cast("int")).over(w)).where("entry > 0")
    g = opened.groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    h = g.withColumn("h", header(F.element_at("l", 1)["line"]))
    rest = F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda s: s["line"]), "\n")
    return h.select("file", "entry", "h.ts", "h.level", "h.logger", F.concat_ws("\n", "h.message", F.nullif(rest, F.lit(""))).alias("message"))


def field(message: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(message, rf"(?:^|\s){name}=(\S+)", 1), F.lit(""))


def events(rows: DataFrame) -> DataFrame:
    """rows: entry order, ts, message like `request start id=7 file=a.pdf pages=2 lane=fast`. Fields
    may come in any order, and ones not known here may stand between them."""
    m = F.col("message")
    kind = F.regexp_extract(m, rf"^({'|'.join(KINDS)}) (start|finish|error)\b", 1)
    what = F.regexp_extract(m, rf"^({'|'.join(KINDS)}) (start|finish|error)\b", 2)
    out = rows.withColumns({"kind": kind, "what": what}).where("kind != ''")
    cols = {n: field(m, n) for n in ("id", "file", "lane", "status")}
    nums = {n: field(m, n).try_cast("long") for n in ("pages", "duration_ms", "input_tokens", "output_tokens", "cached_tokens")}
    return out.withColumns(cols | nums)


def pair_by_key(ev: DataFrame, key: list[str]) -> DataFrame:
    """Spans of events that carry an id: start and finish meet on it; a finish without its start
    began its duration earlier; a span without a finish is open and ends with the log."""
    g = ev.groupBy(*key).agg(
        F.min(F.when(F.col("what") == "start", F.col("ts"))).alias("began"),
        F.max(F.when(F.col("what") != "start", F.col("ts"))).alias("ended"),
        F.max("duration_ms").alias("duration_ms"),
        F.max(F.col("what") == "error").alias("failed"),
        *[F.max(c).alias(c) for c in ("file", "lane", "pages", "input_tokens", "output_tokens", "cached_tokens")],
    )
    last = ev.agg(F.max("ts").alias("t")).first()["t"]
    back = F.col("ended") - F.make_dt_interval(secs=(F.coalesce("duration_ms", F.lit(0)) / 1000).cast("decimal(18,6)"))
    start = F.coalesce("began", back)
    end = F.greatest(F.coalesce("ended", F.lit(last)), start)
    status = F.when(F.col("ended").isNull(), F.lit("open")).when(F.col("failed"), F.lit("error")).otherwise(F.lit("done"))
    return g.withColumns({"start": start, "end": end, "status": status}).withColumn("ms", F.unix_millis("end") - F.unix_millis("start")).drop("began", "ended", "failed")


def pair_in_order(ev: DataFrame, signature: list[str]) -> DataFrame:
    """Spans of events without an id: the n-th start of a signature with its n-th finish. Right
    where no finish lacks its start; pair_fifo() holds in every case."""
    w = Window.partitionBy(*signature, "what").orderBy("ts", "entry")
    n = ev.where(F.col("what").isin("start", "finish")).withColumn("nth", F.row_number().over(w))
    s, f = n.where("what = 'start'"), n.where("what = 'finish'")
    key = [*signature, "nth"]
    return s.select(*key, F.col("ts").alias("start")).join(f.select(*key, F.col("ts").alias("end")), key, "full_outer")


def pair_fifo(ev: DataFrame, signature: str, slice_of: str = "day") -> DataFrame:
    """Exact first-in first-out pairing within a signature; a finish that finds no open start
    starts its duration earlier.

    A finish finds none where the balance of starts and finishes falls to a new low below zero;
    the n-th of the others takes the n-th start. Balances run within slices of time, and sums of
    slices carry over, so that a signature with a third of all events isn't walked in one task."""
    first, here = Window.unboundedPreceding, Window.partitionBy("signature", "slice").orderBy("ts", "entry")
    to, until = here.rowsBetween(first, 0), here.rowsBetween(first, -1)
    rows = ev.select(F.col(signature).alias("signature"), "ts", "entry", F.coalesce(F.col("what") == "start", F.lit(False)).alias("is_start"), "duration_ms", F.date_trunc(slice_of, "ts").alias("slice"))
    run = rows.withColumns({"starts": F.sum(F.col("is_start").cast("long")).over(to), "seen": F.count(F.lit(1)).over(to)}).withColumn("balance", F.col("starts") * 2 - F.col("seen"))
    run = run.withColumns({"low": F.min("balance").over(to), "low_until": F.min("balance").over(until)})
    earlier = Window.partitionBy("signature").orderBy("slice").rowsBetween(first, -1)
    slices = run.groupBy("signature", "slice").agg(F.max("starts").alias("starts"), F.max("seen").alias("seen"), F.min("balance").alias("low"))
    slices = slices.withColumns({f"{c}_0": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("starts", "seen")}).withColumn("balance_0", F.col("starts_0") * 2 - F.col("seen_0"))
    slices = slices.withColumn("low_0", F.least(F.lit(0), F.min(F.col("balance_0") + F.col("low")).over(earlier))).select("signature", "slice", "starts_0", "seen_0", "balance_0", "low_0")
    x = run.alias("x").join(slices.alias("y"), F.expr("x.signature <=> y.signature and x.slice <=> y.slice")).select("x.*", "starts_0", "seen_0", "balance_0", "low_0")
    starts, seen = F.col("starts_0") + F.col("starts"), F.col("seen_0") + F.col("seen")
    low, low_until = (F.least("low_0", F.col("balance_0") + F.col(c)) for c in ("low", "low_until"))
    # The low below zero is the number of finishes that found none.
    n = F.when(F.col("is_start"), starts).otherwise(seen - starts + low)
    x = x.select("signature", "ts", "duration_ms", "is_start", n.alias("n"), (~F.col("is_start") & (low < low_until)).alias("lone"))
    s, f, lone = x.where("is_start"), x.where("not is_start and not lone"), x.where("lone")
    met = s.alias("s").join(f.alias("f"), F.expr("s.signature <=> f.signature and s.n = f.n"), "left")
    pairs = met.select("s.signature", F.col("s.ts").alias("start"), F.col("f.ts").alias("end"), F.when(F.col("f.n").isNull(), F.lit("open")).otherwise(F.lit("done")).alias("status"))
    back = F.col("ts") - F.make_dt_interval(secs=(F.coalesce("duration_ms", F.lit(0)) / 1000).cast("decimal(18,6)"))
    return pairs.unionByName(lone.select("signature", back.alias("start"), F.col("ts").alias("end"), F.lit("done").alias("status")))


def batch_stats(spans: DataFrame) -> DataFrame:
    """By pages of a batch: jobs, total, greatest and average time."""
    jobs = spans.where("kind in ('job', 'range')").withColumn("rank", F.when(F.col("kind") == "job", 0).otherwise(1))
    best = jobs.agg(F.min("rank").alias("r")).first()["r"]
    use = jobs.where(F.col("rank") == F.lit(best))
    return use.where("pages is not null").groupBy("pages").agg(F.count(F.lit(1)).alias("jobs"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("avg_ms"))


def most_common_batch(stats: DataFrame) -> DataFrame:
    """Of batch_stats() the row with most jobs; of equals the one with fewest pages."""
    return stats.orderBy(F.desc("jobs"), "pages").limit(1)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def lane_stats(spans: DataFrame) -> DataFrame:
    """Requests by lane: number, average and greatest time, files, tokens; averages over all."""
    r = spans.where("kind = 'request'")
    lane = F.coalesce("lane", F.lit("unknown"))
    avg = lambda c: half_up(F.coalesce(F.sum(c), F.lit(0)) / F.count(F.lit(1)))
    return r.groupBy(lane.alias("lane")).agg(
        F.count(F.lit(1)).alias("n"), half_up(F.avg("ms")).alias("avg_ms"), F.max("ms").alias("max_ms"), F.count_distinct("file").alias("files"),
        avg("input_tokens").alias("avg_input"), avg("output_tokens").alias("avg_output"), F.coalesce(F.sum("cached_tokens"), F.lit(0)).alias("cached"),
    )


def file_stats(spans: DataFrame) -> DataFrame:
    return spans.where("file is not null").groupBy("file").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("kind") == "job").alias("jobs"),
        F.count_if(F.col("kind") == "request").alias("requests"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("kind") == "job", F.col("pages"))), F.lit(0)).alias("pages"),
        F.max("ms").alias("max_ms"),
    )


def summary(spans: DataFrame) -> DataFrame:
    """One row of totals."""
    paid = (F.col("kind") == "request") & (F.col("input_tokens") > 0)
    return spans.agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("kind") == "job").alias("jobs"),
        F.count_if(F.col("kind") == "request").alias("requests"),
        F.count_if((F.col("status") == "error") | (F.col("kind") == "error")).alias("errors"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.max(F.when(F.col("kind").isin("job", "range"), F.col("pages"))).alias("largest_batch"),
        F.max("ms").alias("longest_ms"),
        F.coalesce(F.sum(F.when(paid, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        half_up(F.avg(F.when(paid, F.col("input_tokens")))).alias("avg_input_tokens"),
        F.count_distinct("file").alias("files"),
    )


def visible(spans: DataFrame, kinds: list[str], query: str = "") -> DataFrame:
    text = F.lower(F.concat_ws(" ", "kind", "file", "lane", "status"))
    return spans.where(F.col("kind").isin(kinds) & F.contains(text, F.lit(query.lower())))


def in_display_order(spans: DataFrame) -> DataFrame:
    return spans.orderBy("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "id")


def waterfall(spans: DataFrame) -> DataFrame:
    """Spans by file, the ones without a file together and last."""
    g = spans.groupBy("file").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"), F.max("end").alias("end"))
    return g.withColumn("place", F.when(F.col("file").isNull(), 1).otherwise(0)).withColumn("file", F.coalesce("file", F.lit("global")))
