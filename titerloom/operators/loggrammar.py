"""Events of a run log: a table of line formats, and the one expression that recognises them.

A format is an event, a literal that its messages hold, an expression and the names of its groups.
A message is matched once, against the formats whose literal it holds, in the table's order; its
groups come out as one array, from which every field is typed. Lines may name a reasoning effort as
configured and applied, as newer writers do.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the head of a line that begins an entry.
HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\w+) ([\w.]+) (.*)$"


class Format(NamedTuple):
    event: str
    holds: str
    pattern: str
    fields: tuple[str, ...]


_FILE = ("path", "filename", "start_page", "stop_page", "dpi")
_JOB = ("stage", "job_id", "file_id", "filename", "start_page", "stop_page", "dpi")
_EFFORT = r"(?:configured_)?reasoning_effort=(\S+)(?: applied_reasoning_effort=\S+)?"
_ASKED = r"request_name=(\S+) request_id=(\w+)"
_PAGES = r"pages=(\d+)-(\d+) dpi=(\d+)"

#: The messages of a run, each with the names of its groups.
FORMATS = (
    Format("taskSpanStart", "Task span start ", r"^Task span start task_type=(\S+) job_id=(\d+) task_key=(\S+) file_ids=(\[.*?\]) filenames=(\[.*?\])$", ("task_type", "job_id", "task_key", "file_ids", "filenames")),
    Format("taskSpanFinish", "Task span finish ", r"^Task span finish task_type=(\S+) job_id=(\d+) task_key=(\S+) file_ids=(\[.*?\]) filenames=(\[.*?\]) duration=([\d.]+)s outcome=(\S+)$", ("task_type", "job_id", "task_key", "file_ids", "filenames", "duration_s", "outcome")),
    Format("jobStart", "Extraction job start ", rf"^Extraction job start stage=(\w+) job_id=(\d+) file_id=(\d+) filename=(\S+) {_PAGES} attempts=(\d+) queued_requests=(\d+) active_requests=(\d+)$", (*_JOB, "attempts", "queued", "active")),
    Format("jobRetrySplit", "Extraction job retry split ", rf"^Extraction job retry split stage=(\w+) job_id=(\d+) file_id=(\d+) filename=(\S+) {_PAGES} fallback_ranges=(.+?) duration=([\d.]+)s error=(.*)$", (*_JOB, "fallback_ranges", "duration_s", "error")),
    Format("jobFailed", "Extraction job failed ", rf"^Extraction job failed stage=(\w+) job_id=(\d+) file_id=(\d+) filename=(\S+) {_PAGES} duration=([\d.]+)s error=(.*)$", (*_JOB, "duration_s", "error")),
    Format("rangeStart", " range start path=", rf"^(.+?) range start path=(\S+) filename=(\S+) {_PAGES} page_count=(\d+)$", ("kind", *_FILE, "page_count")),
    Format("rangeSuccess", " range success path=", rf"^(.+?) range success path=(\S+) filename=(\S+) {_PAGES} duration=([\d.]+)s$", ("kind", *_FILE, "duration_s")),
    Format("rangeFailed", " range failed path=", rf"^(.+?) range failed path=(\S+) filename=(\S+) {_PAGES} after ([\d.]+)s$", ("kind", *_FILE, "duration_s")),
    Format("batchStart", "PDF batch extract start ", rf"^PDF batch extract start kind=(.+?) path=(\S+) filename=(\S+) {_PAGES}$", ("kind", *_FILE)),
    Format("batchDone", "PDF batch extract done ", rf"^PDF batch extract done kind=(.+?) path=(\S+) filename=(\S+) {_PAGES} duration=([\d.]+)s$", ("kind", *_FILE, "duration_s")),
    Format("batchFailed", "PDF batch extract failed ", rf"^PDF batch extract failed kind=(.+?) path=(\S+) filename=(\S+) {_PAGES} after ([\d.]+)s$", ("kind", *_FILE, "duration_s")),
    Format("renderStart", "Rendering PDF pages ", rf"^Rendering PDF pages path=(\S+) {_PAGES}$", ("path", "start_page", "stop_page", "dpi")),
    Format("renderDone", "Rendered PDF pages ", rf"^Rendered PDF pages path=(\S+) {_PAGES} image_count=(\d+) duration=([\d.]+)s$", ("path", "start_page", "stop_page", "dpi", "image_count", "duration_s")),
    Format("requestStart", "Copilot request starting ", rf"^Copilot request starting {_ASKED} model=(\S+) {_EFFORT} timeout=([\d.]+)s attachments=(\d+) prompt_chars=(\d+)(?: context=(\S+))?$", ("request_name", "request_id", "model", "effort", "timeout_s", "attachments", "prompt_chars", "context")),
    Format("requestReady", "Copilot request ready ", rf"^Copilot request ready {_ASKED} attempt=(\d+)/(\d+) lane=(\S+) lane_wait_ms=([\d.]+) semaphore_wait_ms=([\d.]+) client_wait_ms=([\d.]+) session_create_ms=([\d.]+)(?: applied_reasoning_effort=\S+)? queued_requests=(\d+) active_requests=(\d+)$", ("request_name", "request_id", "attempt", "attempt_max", "lane", "lane_wait_ms", "semaphore_wait_ms", "client_wait_ms", "session_create_ms", "queued", "active")),
    Format("requestHeartbeat", "Copilot request still running ", rf"^Copilot request still running {_ASKED} lane=(\S+) attempt=(\d+)/(\d+) elapsed=([\d.]+)s queued_requests=(\d+) active_requests=(\d+)$", ("request_name", "request_id", "lane", "attempt", "attempt_max", "duration_s", "queued", "active")),
    Format("requestRetrying", "Copilot request retrying ", rf"^Copilot request retrying {_ASKED} attempt=(\d+)/(\d+) model=(\S+) {_EFFORT} attachments=(\d+) duration=([\d.]+)s delay=([\d.]+)s error=(.*)$", ("request_name", "request_id", "attempt", "attempt_max", "model", "effort", "attachments", "duration_s", "delay_s", "error")),
    Format("requestFinished", "Copilot request finished ", rf"^Copilot request finished {_ASKED} model=(\S+) {_EFFORT} attachments=(\d+) duration=([\d.]+)s response_chars=(\d+) usage_cost=([\d.]+)(?: input_tokens=(\d+) output_tokens=(\d+) cache_read_tokens=(\d+)(?: context=(\S+))?)?$", ("request_name", "request_id", "model", "effort", "attachments", "duration_s", "response_chars", "usage_cost", "input_tokens", "output_tokens", "cache_read_tokens", "context")),
    Format("summaryStart", "Medical summary start ", r"^Medical summary start filename=(\S+) raw_text=(\S+)$", ("filename", "has_raw_text")),
    Format("summaryFinished", "Medical summary finished ", r"^Medical summary finished filename=(\S+) has_summary=(\S+) has_lab_date=(\S+) has_source=(\S+) duration=([\d.]+)s$", ("filename", "has_summary", "has_lab_date", "has_source", "duration_s")),
    Format("normalizeSourceStart", "Normalize source start ", r"^Normalize source start source_present=(\S+) filename_present=(\S+)(?: filename=(\S+))? existing_canonical=(\d+)$", ("source_present", "filename_present", "filename", "existing_canonical")),
    Format("normalizeSourceFinished", "Normalize source finished ", r"^Normalize source finished(?: filename=(\S+))? normalized=(\S+) duration=([\d.]+)s$", ("filename", "normalized", "duration_s")),
    Format("normalizeMarkerStart", "Normalize marker names start ", r"^Normalize marker names start new_names=(\d+) existing_canonical=(\d+) batch_size=(\d+) concurrency=(\d+)$", ("new_names", "existing_canonical", "batch_size", "concurrency")),
    Format("normalizeMarkerBatchStart", "Normalize marker names batch start ", r"^Normalize marker names batch start batch=(\d+)/(\d+) batch_names=(\d+) existing_canonical=(\d+)$", ("batch_index", "batch_count", "batch_names", "existing_canonical")),
    Format("normalizeMarkerBatchFinished", "Normalize marker names batch finished ", r"^Normalize marker names batch finished batch=(\d+)/(\d+) resolved=(\d+) existing_canonical=(\d+)$", ("batch_index", "batch_count", "resolved", "existing_canonical")),
    Format("normalizeMarkerFinished", "Normalize marker names finished ", r"^Normalize marker names finished input_names=(\d+) representative_names=(\d+) resolved=(\d+) duration=([\d.]+)s$", ("input_names", "representative_names", "resolved", "duration_s")),
    Format("workerCrash", "Worker loop crashed ", r"^Worker loop crashed worker=(\S+) task_types=(.+)$", ("worker", "task_types")),
)

FLAGS = ("has_raw_text", "has_summary", "has_lab_date", "has_source", "source_present", "filename_present", "normalized")
LISTS = {"file_ids": "array<long>", "filenames": "array<string>"}
REALS = ("lane_wait_ms", "semaphore_wait_ms", "client_wait_ms", "session_create_ms", "usage_cost")
TEXTS = ("task_type", "task_key", "outcome", "stage", "filename", "fallback_ranges", "error", "kind", "path", "request_name", "request_id", "model", "effort", "context", "lane", "worker", "task_types")
FIELDS = tuple(dict.fromkeys(f for x in FORMATS for f in x.fields))
_APART = "\x1f"


def header(line: Column) -> Column:
    """ts (null if it names no moment), level, logger and message; null for a line that begins no entry."""
    parts = F.split(F.regexp_replace(line, HEADER, _APART.join(f"${k}" for k in range(1, 5))), _APART, 4)
    ts = F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.rlike(line, F.lit(HEADER)), F.struct(ts.alias("ts"), *[F.get(parts, F.lit(k)).alias(n) for k, n in ((1, "level"), (2, "logger"), (3, "message"))]))


def matched(message: Column) -> Column:
    """The event's name and its groups, as an array; null for any other message."""
    out = F.lit(None).cast("array<string>")
    for f in reversed(FORMATS):
        groups = _APART.join([f.event, *[f"${k + 1}" for k in range(len(f.fields))]])
        found = F.contains(message, F.lit(f.holds)) & F.rlike(message, F.lit(f.pattern))
        out = F.when(found, F.split(F.regexp_replace(message, f.pattern, groups), _APART)).otherwise(out)
    return out


def field(name: str, parts: str) -> Column:
    """The text of a field, null where the event has none."""
    at = {f.event: f.fields.index(name) + 1 for f in FORMATS if name in f.fields}
    place = F.create_map(*[F.lit(x) for p in at.items() for x in p])
    return F.nullif(F.get(parts, F.try_element_at(place, F.col("event"))), F.lit(""))


def typed(name: str, value: Column) -> Column:
    if name in LISTS:
        return F.coalesce(F.from_json(value, LISTS[name]), F.array().cast(LISTS[name]))
    if name in FLAGS:
        return value == "True"
    if name.endswith("_s"):
        return value.try_cast("double") * 1000
    if name in REALS:
        return value.try_cast("double")
    return value if name in TEXTS else value.try_cast("long")


def events(entries: DataFrame) -> DataFrame:
    """entries: log, entry (its place), ts, message. The rows that are events, with event and every
    field, seconds as milliseconds (duration_s as duration_ms); ts_ms is the moment as a number."""
    # Generated, not filtered: a condition would be evaluated beside the column, and match twice.
    found = entries.where("ts is not null").select("*", F.explode(F.array_compact(F.array(matched(F.col("message"))))).alias("__parts"))
    found = found.withColumn("event", F.get("__parts", F.lit(0)))
    columns = {}
    for name in FIELDS:
        value = typed(name, field(name, "__parts"))
        columns[name[:-2] + "_ms" if name.endswith("_s") else name] = value if name not in LISTS else F.when(F.col("event").isin("taskSpanStart", "taskSpanFinish"), value)
    named = found.withColumns(columns)
    base = F.coalesce(F.element_at(F.filter(F.split("path", "/"), lambda p: p != ""), -1), "path")
    absent = F.when((F.col("filename") == "None") & F.col("event").startswith("normalizeSource"), F.lit(None)).otherwise(F.col("filename"))
    pages = F.when(F.col("stop_page").isNotNull(), F.greatest(F.lit(0), F.col("stop_page") - F.col("start_page") + 1))
    rest = {
        "filename": F.when(F.col("event").startswith("render"), base).otherwise(absent),
        "context": F.nullif("context", F.lit("none")),
        "page_count": F.coalesce("page_count", pages),
        "ts_ms": F.unix_millis("ts").cast("double"),
    }
    return named.withColumns(rest).drop("__parts")


def request_context(raw: Column) -> Column:
    """``file:p1-2:144dpi`` or ``file:144dpi`` as filename, start_page, stop_page; null for any other text."""
    pages, image = r"^(.+?):p(\d+)-(\d+):(\d+)dpi$", r"^(.+?):(\d+)dpi$"
    part = lambda p, k: F.regexp_extract(raw, p, k)
    whole = F.struct(part(pages, 1).alias("filename"), F.nullif(part(pages, 2), F.lit("")).cast("long").alias("start_page"), F.nullif(part(pages, 3), F.lit("")).cast("long").alias("stop_page"))
    one = F.struct(part(image, 1).alias("filename"), F.lit(None).cast("long").alias("start_page"), F.lit(None).cast("long").alias("stop_page"))
    return F.when(F.rlike(raw, F.lit(pages)), whole).when(F.rlike(raw, F.lit(image)), one)
