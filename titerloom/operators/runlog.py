"""Spans of work rebuilt from the events of a run log (loggrammar.events()), and their statistics.

An analyser that walks the lines keeps queues and maps of open spans. Each of its rules is a
relation here, over the lines' places:

* by_key: a map from key to the open span. A finish meets the start just before it of its key; a
  start that another follows is lost.
* fifo: a queue. Balances of starts and finishes number both; a finish that finds the queue empty
  stands alone, and began its duration earlier.
* claims: takers, each of which takes the oldest item that is open and not taken. Rows are cut where
  nothing can be open, by two upper bounds on what is, and each stretch is walked with a queue.
* newest: the youngest item that is open at a moment; of a queue these are its last starts, so
  counts tell.

Requests are folded by stretches of their id's events. Orders and counts run in slices (scan), so
that a kind of event with a third of all lines isn't one task's. Where the analyser breaks ties
between spans of the same second by the order of a map, the line's place decides here.

Spans: log, type, subtype, title, files, file, page_start, page_stop, page_count, lane, status, start_ms,
end_ms, duration_ms, place (of the line that made it), closed (of the line that ended it, null if
none did), and fields of its kind. Moments and durations are milliseconds as doubles.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.operators import loggrammar as G
from titerloom.operators.scan import Running, running
from titerloom.sources.shared import written

#: The order of types, what stages and kinds are called, titles of requests and tasks.
TYPE_ORDER = ("job", "request", "range", "batch", "render", "summary", "normalization", "error")
KIND_TO_STAGE = {"Document text": "text", "Structured medical": "measurements"}
REQUEST_LABELS = {
    "document_text_extraction": "Document text request",
    "structured_medical_extraction": "Structured medical request",
    "medical_summary": "Medical summary request",
    "normalize_source_name": "Normalize source request",
    "normalize_marker_names": "Normalize marker names request",
    "normalize_qualitative_values": "Normalize qualitative request",
    "infer_rescaling_factors": "Infer rescaling factors request",
}
TASK_LABELS = {
    "assemble.text": "Assemble text task",
    "process.measurements": "Process measurements task",
    "generate.summary": "Generate summary task",
    "refresh.search": "Refresh search task",
    "canonize.source": "Canonize source task",
}
BATCH_OF_REQUEST = {"document_text_extraction": "Document text", "structured_medical_extraction": "Structured medical"}
COLUMNS = (
    "log", "type", "subtype", "title", "files", "file", "page_start", "page_stop", "page_count", "lane", "status", "start_ms", "end_ms", "duration_ms", "place", "closed", "folded",
    "request_name", "request_id", "attempt", "heartbeats", "retries", "ready_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens", "usage_cost", "context_title", "error",
)
_TYPES = {"files": "array<string>", "heartbeats": "array<double>", "folded": "boolean", "usage_cost": "double"}
_TYPES |= dict.fromkeys(("page_start", "page_stop", "page_count", "place", "closed", "input_tokens", "output_tokens", "cache_read_tokens", "retries"), "long")
_TYPES |= dict.fromkeys(("start_ms", "end_ms", "duration_ms", "ready_ms"), "double")


def one_of(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def began(ts: Column, duration: Column) -> Column:
    """When a span without a start began."""
    return ts - F.coalesce(duration, F.lit(0.0))


def ended(start: Column, ts: Column, duration: Column) -> Column:
    return F.when(F.coalesce(duration, F.lit(0.0)) == 0, ts).otherwise(F.greatest(ts, start + duration))


def by_key(ev: DataFrame, keys: list[str], start: str) -> DataFrame:
    """s and f, a start and a finish of a key; one of them null if it stands alone."""
    w = Window.partitionBy(*keys).orderBy("entry")
    row = F.struct("*")
    near = ev.select("*", row.alias("me")).withColumns({"before": F.lag("me").over(w), "after": F.lead("me").over(w)})
    is_start, none = F.col("event") == start, F.lit(None).cast(near.schema["me"].dataType)
    kept = near.where(~is_start | F.col("after").isNull() | (F.col("after.event") == start))
    s = F.when(is_start, F.col("me")).when(F.col("before.event") == start, F.col("before")).otherwise(none)
    f = F.when(is_start, none).otherwise(F.col("me"))
    lost = is_start & F.col("after").isNotNull()
    return kept.where(~lost).select(s.alias("s"), f.alias("f"))


#: Queues: the start and the finishes of each, and the columns that tell its spans apart.
_RANGE = ("kind", "filename", "start_page", "stop_page", "dpi")
QUEUES = {
    "range": ("rangeStart", ("rangeSuccess", "rangeFailed"), _RANGE),
    "batch": ("batchStart", ("batchDone", "batchFailed"), _RANGE),
    "render": ("renderStart", ("renderDone",), ("path", "start_page", "stop_page", "dpi")),
    "summary": ("summaryStart", ("summaryFinished",), ()),
    "source": ("normalizeSourceStart", ("normalizeSourceFinished",), ()),
    "marker": ("normalizeMarkerStart", ("normalizeMarkerFinished",), ()),
    "marker_batch": ("normalizeMarkerBatchStart", ("normalizeMarkerBatchFinished",), ()),
}


def queued(ev: DataFrame, size: int | None = None) -> DataFrame:
    """The events of all queues, with queue, sig (which of its queues), is_start, n (a start's and the
    finish's that takes it are the same) and lone (a finish that finds its queue empty). Written."""
    queue, sig = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (start, finishes, keys) in QUEUES.items():
        mine = F.col("event").isin(start, *finishes)
        queue = F.when(mine, F.lit(name)).otherwise(queue)
        sig = F.when(mine, F.to_json(F.struct(F.lit(name).alias("q"), *keys))).otherwise(sig)
    rows = ev.withColumns({"queue": queue, "sig": sig}).where("queue is not null").withColumn("is_start", F.col("event").isin(*[q[0] for q in QUEUES.values()]))
    one = F.when(F.col("is_start"), 1).otherwise(-1).cast("long")
    wanted = [Running("starts", "sum", F.col("is_start").cast("long")), Running("seen", "sum", F.lit(1).cast("long")), Running("low", "low", one), Running("low_before", "low", one, before=True)]
    rows = running(rows, ["log", "sig"], "entry", wanted, size)
    low, before = F.least(F.lit(0), "low"), F.least(F.lit(0), F.coalesce("low_before", F.lit(0)))
    takes = F.col("seen") - F.col("starts") + low
    rows = rows.withColumns({"lone": ~F.col("is_start") & (low < before), "n": F.when(F.col("is_start"), F.col("starts")).otherwise(takes)})
    return written(rows.drop("seen", "starts", "low", "low_before"), "queues")


def fifo(queues: DataFrame) -> DataFrame:
    """queue, s and f, paired first in, first out; s null for a finish that finds no start, f for a start
    that nothing takes."""
    row = F.struct(*[c for c in queues.columns if c not in ("queue", "sig", "is_start", "n", "lone")])
    s = queues.where("is_start").select("log", "queue", "sig", "n", row.alias("s"))
    f = queues.where("not is_start and not lone").select(F.col("log").alias("log2"), F.col("sig").alias("sig2"), F.col("n").alias("m"), row.alias("f"))
    met = s.join(f, F.expr("log <=> log2 and sig = sig2 and n = m"), "left").select("queue", "s", "f")
    return met.unionByName(queues.where("lone").select("queue", F.lit(None).cast(met.schema["s"].dataType).alias("s"), row.alias("f")))


def claims(items: DataFrame, takers: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """keys, taker, item: which item each taker takes, the oldest that has begun (at), isn't over
    (until, null: never) and isn't taken. items: keys, at, until; takers: keys, at."""
    item = items.select(*keys, "at", F.lit(0).alias("what"), F.col("until").cast("long").alias("until"))
    over = item.where("until is not null").select(*keys, F.col("until").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("long").alias("until"))
    take = takers.select(*keys, "at", F.lit(2).alias("what"), F.lit(None).cast("long").alias("until"))
    # A line may both end an item and take another; it ends first.
    rows = item.unionByName(over).unionByName(take).withColumn("place", F.col("at") * 3 + F.col("what"))
    untaken = F.when(F.col("what") == 0, 1).when(F.col("what") == 2, -1).otherwise(0).cast("long")
    open_ = F.when(F.col("what") == 0, 1).when(F.col("what") == 1, -1).otherwise(0).cast("long")
    wide = size and 3 * size
    rows = running(rows, keys, "place", [Running("untaken", "sum", untaken), Running("open", "sum", open_), Running("low", "low", untaken)], wide)
    empty = (F.col("untaken") == F.least(F.lit(0), "low")) | (F.col("open") == 0)
    rows = written(rows.select(*keys, "place", "at", "what", "until", empty.cast("long").alias("empty")), "claims")
    rows = written(running(rows, keys, "place", [Running("stretch", "sum", F.col("empty"), before=True)], wide).withColumn("lane", F.xxhash64(*keys, "stretch")), "stretches")
    walked = rows.where("what != 1").select("lane", "place", "at", "what", "until").repartition("lane").sortWithinPartitions("lane", "place")
    pairs = walked.mapInPandas(_walk, "taker long, in_lane long, item long")
    takers = rows.where("what = 2").select(*keys, "lane", "at")
    return takers.join(pairs, F.expr("lane = in_lane and at = taker")).select(*keys, "taker", "item")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by lane and place: a queue of the open items, carried over batches."""
    lane, queue = None, deque()
    for batch in batches:
        out = []
        for of, at, what, until in zip(batch["lane"], batch["at"], batch["what"], batch["until"], strict=True):
            if of != lane:
                lane, queue = of, deque()
            if what == 0:
                queue.append((at, until))
                continue
            while queue and queue[0][1] <= at:  # false for an item without an end
                queue.popleft()
            if queue:
                out.append((at, of, queue.popleft()[0]))
        yield pd.DataFrame(out, columns=["taker", "in_lane", "item"], dtype="int64")


def newest(queues: DataFrame, asking: DataFrame, size: int | None = None) -> DataFrame:
    """log, queue, at, item: for each asking (log, queue, at, tied) the entry of the last start of a queue
    without keys that is open then; tied: of open starts in the same second the first."""
    rows = queues.withColumn("first", F.min(F.when(F.col("is_start"), F.col("n"))).over(Window.partitionBy("log", "queue", "ts_ms")))
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    steps = rows.select("log", "queue", F.col("entry").alias("at"), number(F.col("is_start")).alias("one"), number(~F.col("is_start") & ~F.col("lone")).alias("gone"), F.when(F.col("is_start"), F.col("first")).alias("first"), F.lit(None).cast("boolean").alias("tied"))
    zero = F.lit(0).cast("long")
    asks = asking.select("log", "queue", "at", zero.alias("one"), zero.alias("gone"), F.lit(None).cast("long").alias("first"), "tied")
    both = written(steps.unionByName(asks), "asking")
    run = running(both, ["log", "queue"], "at", [Running("begun", "sum", F.col("one")), Running("over", "sum", F.col("gone")), Running("head", "last", F.col("first"))], size)
    n = F.when(F.col("tied"), F.greatest(F.col("over") + 1, "head")).otherwise(F.col("begun"))
    found = run.where("tied is not null and begun > over").select("log", "queue", "at", n.alias("n"))
    starts = queues.where("is_start").select(F.col("log").alias("of"), F.col("queue").alias("queue2"), F.col("n").alias("m"), F.col("entry").alias("item"))
    return found.join(starts, F.expr("log <=> of and queue = queue2 and n = m")).select("log", "queue", "at", "item")


def spans_of(pairs: DataFrame, type_: Column | str, subtype: Column | str, title: Column | str, finish: Column | None = None, **more: Column) -> DataFrame:
    """Spans of pairs s, f; open ones have no end yet. finish: the status of a span that was closed."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    x = pairs.withColumn("x", F.coalesce("s", "f"))
    start = F.when(F.col("s").isNotNull(), F.col("s.ts_ms")).otherwise(began(F.col("f.ts_ms"), F.col("f.duration_ms")))
    end = F.when(F.col("f").isNotNull(), F.greatest(ended(start, F.col("f.ts_ms"), F.col("f.duration_ms")), start))
    status = F.when(F.col("f").isNull(), F.lit("open")).otherwise(F.lit("success") if finish is None else finish)
    named = {
        "log": F.col("x.log"), "type": lit(type_), "subtype": lit(subtype), "title": lit(title), "files": one_file(F.col("x.filename")),
        "page_start": F.col("x.start_page"), "page_stop": F.col("x.stop_page"), "page_count": F.col("x.page_count"),
        "status": status, "start_ms": start, "end_ms": end, "place": F.col("x.entry"), "closed": F.col("f.entry"),
    } | more
    return shaped(x, named)


def one_file(name: Column) -> Column:
    trimmed = F.trim(name)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(trimmed))


def shaped(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    named = {"file": F.get(named["files"], F.lit(0)), "folded": F.lit(False)} | named
    return rows.select(*[(named[c] if c in named else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in COLUMNS])


def of(ev: DataFrame, *events: str) -> DataFrame:
    return ev.where(F.col("event").isin(*events))


def task_spans(ev: DataFrame) -> DataFrame:
    pairs = by_key(of(ev, "taskSpanStart", "taskSpanFinish"), ["log", "task_type", "job_id", "task_key"], "taskSpanStart")
    kind = F.col("x.task_type")
    type_ = F.when(kind == "generate.summary", F.lit("summary")).when(F.startswith(kind, F.lit("canonize.")), F.lit("normalization")).otherwise(F.lit("job"))
    title = F.coalesce(one_of(TASK_LABELS, kind), F.concat(F.lit("Task "), kind))
    files = F.array_distinct(F.filter(F.transform("x.filenames", lambda f: F.trim(f)), lambda f: f != ""))
    return spans_of(pairs, type_, F.concat(F.lit("task."), kind), title, files=files)


def queue_spans(pairs: DataFrame) -> DataFrame:
    """Of fifo(): the spans of all queues."""
    stage = F.coalesce(one_of(KIND_TO_STAGE, F.col("x.kind")), F.lit("other"))
    queue = F.col("queue")
    by = lambda **of: _chosen(queue, of)
    type_ = F.when(queue.isin("source", "marker", "marker_batch"), F.lit("normalization")).otherwise(queue)
    subtype = by(range=F.concat(F.lit("range."), stage), batch=F.concat(F.lit("batch."), stage), render=F.lit("render.pdf"), summary=F.lit("summary.medical"), source=F.lit("normalize_source"), marker=F.lit("normalize_marker_names"), marker_batch=F.lit("normalize_marker_batch"))
    numbered = F.concat(F.lit("Normalize marker batch "), F.concat_ws("/", "x.batch_index", "x.batch_count"))
    title = by(range=F.concat("x.kind", F.lit(" range")), batch=F.concat("x.kind", F.lit(" batch")), render=F.lit("Render PDF pages"), summary=F.lit("Medical summary"), source=F.lit("Normalize source"), marker=F.lit("Normalize marker names"), marker_batch=numbered)
    finish = F.when(F.col("f.event").isin("rangeFailed", "batchFailed"), F.lit("error")).otherwise(F.lit("success"))
    return spans_of(pairs, type_, subtype, title, finish)


def _chosen(key: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in of.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def own_ends(ev: DataFrame) -> DataFrame:
    """s and f of jobs and the finishes of their id."""
    return by_key(of(ev, "jobStart", "jobRetrySplit", "jobFailed"), ["log", "job_id"], "jobStart")


SIGNATURE = ("stage", "filename", "start_page", "stop_page", "dpi")


def job_items(ev: DataFrame, own: DataFrame) -> DataFrame:
    # Starts that another start of their id follows wait for a range alone.
    started = of(ev, "jobStart").select("log", *SIGNATURE, F.col("entry").alias("at"), F.struct("*").alias("s"))
    paired = own.where("s is not null").select(F.col("s.log").alias("of"), F.col("s.entry").alias("begun"), "f", F.lit(True).alias("kept"))
    return started.join(paired, F.expr("log <=> of and at = begun"), "left").withColumn("until", F.col("f.entry"))


def job_spans(items: DataFrame, own: DataFrame, taken: DataFrame, ranges: DataFrame) -> DataFrame:
    """A job ends with its own finish or with a finished range of its stage, file, pages and resolution,
    which takes the oldest such job that is open; an own finish of a job that is over stands alone."""
    # A finished range's end, which may be later than its line.
    ends = ranges.where("closed is not null").select(F.col("log").alias("log3"), F.col("closed").alias("by"), F.col("end_ms").alias("range_end"), F.col("status").alias("range_status"))
    taken = taken.select(F.col("log").alias("log2"), "item", "taker")
    met = taken.join(ends, F.expr("log2 <=> log3 and taker = by"))
    jobs = items.join(met, F.expr("log <=> log2 and at = item"), "left").where("taker is not null or kept")
    by_range = F.col("taker").isNotNull()
    lone = own.where("s is null").select("s", "f", F.lit(None).cast("long").alias("taker"), F.lit(None).cast("double").alias("range_end"), F.lit(None).cast("string").alias("range_status"))
    late = jobs.where(by_range & F.col("f").isNotNull()).select(F.lit(None).cast(lone.schema["s"].dataType).alias("s"), "f", *lone.columns[2:]).withColumns({c: F.lit(None).cast(lone.schema[c].dataType) for c in lone.columns[2:]})
    rows = jobs.select("s", F.when(~by_range, F.col("f")).alias("f"), "taker", "range_end", "range_status").unionByName(lone).unionByName(late)
    stage = F.col("x.stage")
    title = F.concat(F.when(stage == "measurements", F.lit("Measurements")).otherwise(F.concat(F.upper(F.substring(stage, 1, 1)), F.expr("substring(x.stage, 2)"))), F.lit(" job #"), F.col("x.job_id").cast("string"))
    start = F.when(F.col("s").isNotNull(), F.col("s.ts_ms")).otherwise(began(F.col("f.ts_ms"), F.col("f.duration_ms")))
    own_end = F.when(F.col("f").isNotNull(), F.greatest(ended(start, F.col("f.ts_ms"), F.col("f.duration_ms")), start))
    finish = F.when(F.col("f.event") == "jobRetrySplit", F.lit("split")).when(F.col("f").isNotNull(), F.lit("error"))
    more = {
        "end_ms": F.when(F.col("taker").isNotNull(), F.greatest("range_end", start)).otherwise(own_end),
        "status": F.coalesce("range_status", finish, F.lit("open")),
        "closed": F.coalesce("taker", "f.entry"),
        "error": F.nullif("f.error", F.lit("")),
    }
    return spans_of(rows, "job", F.concat(F.lit("job."), stage), title, **more)


def request_spans(ev: DataFrame, given: DataFrame) -> DataFrame:
    """A stretch of an id's events begins with a start or after a finish. Its span begins with its first
    event, ends with its finish, and is lost if a start cuts it off."""
    rows = of(ev, "requestStart", "requestReady", "requestHeartbeat", "requestRetrying", "requestFinished")
    w = Window.partitionBy("log", "request_id").orderBy("entry")
    first = (F.col("event") == "requestStart") | F.coalesce(F.lag("event").over(w) == "requestFinished", F.lit(True))
    cut = rows.withColumn("first", first.cast("int")).withColumn("stretch", F.sum("first").over(w)).withColumn("last_stretch", F.max("stretch").over(Window.partitionBy("log", "request_id")))
    setup = F.col("lane_wait_ms") + F.col("semaphore_wait_ms") + F.col("client_wait_ms") + F.col("session_create_ms")
    worked = F.when(F.col("event") == "requestReady", setup).when(F.col("event") != "requestStart", F.col("duration_ms")).otherwise(F.lit(0.0))
    at = lambda *events: F.when(F.col("event").isin(*events), F.col("entry"))
    latest = lambda c, *events: F.max_by(c, at(*events))
    lively, said = ("requestReady", "requestHeartbeat"), ("requestStart", "requestRetrying", "requestFinished")
    beats = F.sort_array(F.collect_list(F.when(F.col("event") == "requestHeartbeat", F.struct("entry", "ts_ms", "duration_ms"))))
    g = cut.groupBy("log", "request_id", "stretch").agg(
        F.min("entry").alias("place"), F.min_by("request_name", "entry").alias("request_name"), F.min_by(began(F.col("ts_ms"), worked), "entry").alias("start_ms"),
        F.max("last_stretch").alias("last_stretch"), F.max(at("requestFinished")).alias("closed"), latest("ts_ms", "requestFinished").alias("f_ms"), latest("duration_ms", "requestFinished").alias("f_duration"),
        latest("lane", *lively).alias("lane"), latest(F.concat_ws("/", "attempt", "attempt_max"), *lively).alias("attempt"), latest(F.struct("ts_ms", setup.alias("setup")), "requestReady").alias("ready"),
        beats.alias("beats"), F.count_if(F.col("event") == "requestRetrying").alias("retries"), latest("model", *said).alias("model"),
        latest(F.struct("input_tokens", "output_tokens", "cache_read_tokens", "usage_cost"), "requestFinished").alias("used"), latest("context", "requestStart").alias("context"), F.max(at("requestStart")).alias("asked"),
    )
    whole = g.where("closed is not null or stretch = last_stretch")
    found = whole.join(given, F.expr("log <=> of and place = asked_at"), "left")
    start = F.col("start_ms")
    name = F.coalesce(one_of(REQUEST_LABELS, F.col("request_name")), F.replace("request_name", F.lit("_"), F.lit(" ")))
    told = G.request_context(F.col("context"))
    # A span has what its start says, or else what it took over.
    mine, theirs = told.isNotNull(), F.col("taken")
    pages = F.when(told["stop_page"].isNotNull(), F.greatest(F.lit(0), told["stop_page"] - told["start_page"] + 1))
    named = {
        "log": F.col("log"), "type": F.lit("request"), "subtype": F.col("request_name"), "title": F.concat(name, F.lit(" · "), F.col("request_id")),
        "files": F.when(mine, one_file(told["filename"])).otherwise(F.coalesce(theirs["files"], F.array().cast("array<string>"))),
        "page_start": F.when(mine, told["start_page"]).otherwise(theirs["page_start"]), "page_stop": F.when(mine, told["stop_page"]).otherwise(theirs["page_stop"]), "page_count": F.when(mine, pages).otherwise(theirs["page_count"]),
        "lane": F.col("lane"), "status": F.when(F.col("closed").isNull(), F.lit("open")).otherwise(F.lit("success")), "start_ms": start,
        "end_ms": F.when(F.col("closed").isNotNull(), F.greatest(ended(start, F.col("f_ms"), F.col("f_duration")), start)), "place": F.col("place"), "closed": F.col("closed"),
        "request_name": F.col("request_name"), "request_id": F.col("request_id"), "attempt": F.col("attempt"), "retries": F.col("retries"), "model": F.col("model"),
        "heartbeats": F.transform("beats", lambda b: ended(F.col("start_ms"), b["ts_ms"], b["duration_ms"])), "ready_ms": ended(start, F.col("ready.ts_ms"), F.col("ready.setup")),
        "input_tokens": F.col("used.input_tokens"), "output_tokens": F.col("used.output_tokens"), "cache_read_tokens": F.col("used.cache_read_tokens"), "usage_cost": F.col("used.usage_cost"),
        "context_title": F.coalesce(theirs["title"], F.col("context")),
    }
    return shaped(found, named)


def vague_starts(ev: DataFrame) -> DataFrame:
    """Starts of requests that name no file, also those that were lost: they took their batches too."""
    return of(ev, "requestStart").where(G.request_context(F.col("context")).isNull()).select("log", "request_name", F.col("entry").alias("at"))


def contexts(took: DataFrame, newest_open: DataFrame, spans: DataFrame) -> DataFrame:
    """of, asked_at, taken: the span that a request without a file of its own belongs to: the oldest open
    batch of its kind that no request has, or the newest open summary or normalisation."""
    rank = F.when(F.col("queue") == "marker", 2).otherwise(1)
    every = took.select("log", F.col("taker").alias("at"), "item", F.lit(1).alias("rank")).unionByName(newest_open.select("log", "at", "item", rank.alias("rank")))
    best = every.groupBy("log", "at").agg(F.min_by("item", "rank").alias("item"))
    them = spans.select(F.col("log").alias("log2"), F.col("place").alias("place2"), F.struct("title", "files", "page_start", "page_stop", "page_count").alias("taken"))
    return best.join(them, F.expr("log <=> log2 and item = place2")).select(F.col("log").alias("of"), F.col("at").alias("asked_at"), "taken")


def folded(spans: DataFrame, parents: DataFrame) -> DataFrame:
    """Spans of queues; the only batch of a marker normalisation, if it ended before it, is folded.
    parents: log, at (a batch's start), item (the normalisation's)."""
    ends = spans.where("subtype = 'normalize_marker_names' and closed is not null").select(F.col("log").alias("log2"), F.col("place").alias("of"), F.col("closed").alias("over"))
    only = parents.groupBy("log", "item").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("child")).where("n = 1")
    folding = only.join(ends, F.expr("log <=> log2 and item = of")).select(F.col("log").alias("log3"), "child", "over")
    met = spans.join(folding, F.expr("log <=> log3 and place = child and closed < over"), "left")
    return met.withColumn("folded", F.col("child").isNotNull()).select(*COLUMNS)


def crash_spans(ev: DataFrame) -> DataFrame:
    pairs = of(ev, "workerCrash").select(F.struct("*").alias("s")).withColumn("f", F.col("s"))
    return spans_of(pairs, "error", "worker_crash", F.concat(F.lit("Worker crash · "), F.col("x.worker")), F.lit("error"), files=F.array().cast("array<string>"))


def spans(ev: DataFrame, size: int | None = None) -> DataFrame:
    """All spans; those still open end with the log. Steps that several others use are written."""
    ev = written(ev, "events")
    queues = queued(ev, size)
    of_queues = written(queue_spans(fifo(queues)), "queue-spans")
    own, vague = own_ends(ev), vague_starts(ev)
    jobs = job_items(ev, own)

    # Jobs wait for ranges, and batches for requests: two kinds of claims, told apart by their keys.
    keys = ["log", "key"]
    of_job, of_batch = F.to_json(F.struct(*SIGNATURE)), F.col("title")
    ranges = of(ev, "rangeSuccess", "rangeFailed").withColumn("stage", one_of(KIND_TO_STAGE, F.col("kind"))).where("stage is not null")
    begun = of(ev, "batchStart").select(F.col("log").alias("log2"), F.col("entry").alias("place2"))
    batches = of_queues.where("type = 'batch'").join(begun, F.expr("log <=> log2 and place = place2"))  # the finish of a batch may have come alone
    items = jobs.select("log", of_job.alias("key"), "at", "until").unionByName(batches.select("log", of_batch.alias("key"), F.col("place").alias("at"), F.col("closed").alias("until")))
    kind = F.concat(one_of(BATCH_OF_REQUEST, F.col("request_name")), F.lit(" batch"))
    takers = ranges.select("log", of_job.alias("key"), F.col("entry").alias("at")).unionByName(vague.select("log", kind.alias("key"), "at").where("key is not null"))
    taken = written(claims(written(items, "items"), takers, keys, size), "taken")
    by_range, by_request = taken.where(F.col("key").startswith("{")), taken.where(~F.col("key").startswith("{"))

    queue_of = {"medical_summary": ["summary"], "normalize_source_name": ["source"], "normalize_marker_names": ["marker_batch", "marker"]}
    wanted = F.explode(F.coalesce(F.try_element_at(F.create_map(*[x for n, q in queue_of.items() for x in (F.lit(n), F.array(*map(F.lit, q)))]), F.col("request_name")), F.array().cast("array<string>")))
    asks = vague.select("log", wanted.alias("queue"), "at", F.lit(True).alias("tied"))
    children = of(ev, "normalizeMarkerBatchStart").select("log", F.lit("marker").alias("queue"), F.col("entry").alias("at"), F.lit(False).alias("tied"))
    keyless = queues.where(F.col("queue").isin(*[n for n, q in QUEUES.items() if not q[2]]))
    found = written(newest(keyless, asks.unionByName(children), size), "newest")
    batch_starts = children.select(F.col("log").alias("log2"), F.col("at").alias("at2"))
    parents = found.where("queue = 'marker'").join(batch_starts, F.expr("log <=> log2 and at = at2"), "left_semi")
    of_requests = found.join(batch_starts, F.expr("log <=> log2 and at = at2"), "left_anti")

    every = folded(of_queues, parents)
    for part in (task_spans(ev), job_spans(jobs, own, by_range, of_queues.where("type = 'range'")), request_spans(ev, contexts(by_request, of_requests, of_queues)), crash_spans(ev)):
        every = every.unionByName(part)
    return closed(every, ev)


def closed(spans: DataFrame, ev: DataFrame) -> DataFrame:
    last = ev.groupBy("log").agg(F.max("ts_ms").alias("last_ms")).withColumnRenamed("log", "__log")
    met = spans.join(last, F.expr("log <=> __log"))
    end = F.coalesce("end_ms", F.greatest("last_ms", "start_ms"))
    return met.withColumn("end_ms", end).withColumn("duration_ms", F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms"))).select(*COLUMNS)


def in_order(spans: DataFrame) -> DataFrame:
    """By start, type and title, as on screen."""
    return spans.orderBy("log", "start_ms", F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")), "title", "place")


def visible(spans: DataFrame, types: list[str], query: str = "") -> DataFrame:
    """What filters leave: spans not folded, of these types, with the words in what they show."""
    shown = F.lower(F.concat_ws(" ", "title", F.array_join("files", " "), "subtype", "lane", "model", "request_id", "attempt", "status", "error"))
    return spans.where(~F.col("folded") & F.col("type").isin(*types) & F.contains(shown, F.lit(query.strip().lower())))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def mean(total: str, n: str) -> Column:
    return F.coalesce(half_up(F.try_divide(F.col(total), F.col(n))), F.lit(0).cast("long"))


def batch_stats(spans: DataFrame) -> DataFrame:
    """log, pages, count, total, greatest and average time of jobs; of ranges in a log without jobs that have pages."""
    sized = spans.where("type in ('job', 'range') and page_count is not null")
    g = sized.groupBy("log", "type", F.col("page_count").alias("pages")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    first = F.min("type").over(Window.partitionBy("log"))  # 'job' comes before 'range'
    return g.withColumn("use", first).where("type = use").select("log", "pages", "n", "total_ms", "max_ms", (F.col("total_ms") / F.col("n")).alias("avg_ms"))


def most_common_batch(stats: DataFrame) -> DataFrame:
    """Of each log the size with most jobs; of equals the smallest."""
    return stats.groupBy("log").agg(F.min_by(F.struct("pages", "n"), F.struct(-F.col("n"), "pages")).alias("b")).select("log", "b.*")


def lane_stats(spans: DataFrame) -> DataFrame:
    r = spans.where("type = 'request'").withColumn("lane", F.coalesce(F.nullif("lane", F.lit("")), F.nullif("request_name", F.lit("")), F.lit("unknown")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    g = r.groupBy("log", "lane").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), total("input_tokens"), total("output_tokens"), total("cache_read_tokens"))
    files = r.select("log", "lane", F.explode("files").alias("file")).groupBy("log", "lane").agg(F.count_distinct("file").alias("files"))
    met = g.alias("a").join(files.alias("b"), F.expr("a.log <=> b.log and a.lane = b.lane"), "left")
    return met.select("a.log", "a.lane", "n", (F.col("total_ms") / F.col("n")).alias("avg_ms"), "max_ms", F.coalesce("files", F.lit(0)).alias("files"), mean("input_tokens", "n").alias("avg_input"), mean("output_tokens", "n").alias("avg_output"), F.col("cache_read_tokens").alias("cached"))


def failed() -> Column:
    return (F.col("status") == "error") | (F.col("type") == "error")


def file_stats(spans: DataFrame) -> DataFrame:
    s = spans.select("log", F.explode("files").alias("file"), "type", "status", "page_count", "duration_ms")
    pages = F.when(F.col("type") == "job", F.coalesce("page_count", F.lit(0))).otherwise(F.lit(0))
    return s.groupBy("log", "file").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("type") == "job").alias("jobs"), F.count_if(F.col("type") == "request").alias("requests"), F.count_if(failed()).alias("errors"), F.sum(pages).alias("pages"), F.max("duration_ms").alias("max_ms"))


def waterfall(spans: DataFrame) -> DataFrame:
    """log, file and its spans' number, least start and greatest end; spans without a file together, as global, and last."""
    g = spans.where("not folded").groupBy("log", "file").agg(F.count(F.lit(1)).alias("spans"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return g.withColumn("last", F.col("file").isNull()).withColumn("file", F.coalesce("file", F.lit("global")))


def summary(spans: DataFrame, ev: DataFrame) -> DataFrame:
    """One row of totals a log."""
    paid = (F.col("type") == "request") & (F.col("input_tokens") > 0)
    total = lambda c: F.coalesce(F.sum(F.when(paid, F.coalesce(c, F.lit(0)))), F.lit(0))
    kind = lambda t: F.count_if(F.col("type") == t)
    s = spans.groupBy("log").agg(
        F.count(F.lit(1)).alias("spans"), kind("job").alias("jobs"), kind("request").alias("requests"), F.count_if(failed()).alias("errors"), F.count_if(F.col("status") == "open").alias("open"),
        F.coalesce(F.max(F.when(F.col("type") == "job", F.col("page_count"))), F.lit(0)).alias("largest_batch"), F.max("duration_ms").alias("longest_ms"), F.count_if(paid).alias("paid"),
        total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cache_read_tokens").alias("cached"), F.max("end_ms").alias("last_end"),
    )
    files = spans.select("log", F.explode("files").alias("file")).groupBy("log").agg(F.count_distinct("file").alias("files"))
    load = ev.groupBy("log").agg(F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.coalesce(F.max("queued"), F.lit(0)).alias("peak_queued"), F.coalesce(F.max("active"), F.lit(0)).alias("peak_active"))
    met = load.alias("e").join(s.alias("s"), F.expr("e.log <=> s.log"), "left").join(files.alias("f"), F.expr("e.log <=> f.log"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select(
        "e.log", "events", *map(zero, ("spans", "jobs", "requests", "errors", "open", "files", "largest_batch", "input_tokens", "output_tokens", "cached")), "longest_ms", "peak_queued", "peak_active",
        (F.greatest("last_ms", "last_end") - F.col("first_ms")).alias("duration_ms"), mean("input_tokens", "paid").alias("avg_input"), mean("output_tokens", "paid").alias("avg_output"),
    )
