"""Run logs: events, spans and statistics, from lines that the events table is written out as.

The SQL recognises the same formats with another engine's expressions, pairs with windows, and finds
what requests and jobs claim by recursion, item after item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.operators import loggrammar as G
from titerloom.operators import runlog as R
from titerloom.plans import adapters as A
from titerloom.plans.registry import query


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _one_group(pattern: str, wanted: int) -> str:
    """The pattern with that group alone: the engine counts to nine."""
    out, n = [], 0
    for k, c in enumerate(pattern):
        if c == "(" and pattern[k - 1] != "\\" and pattern[k + 1] != "?":
            n += 1
            c = "(" if n == wanted else "(?:"
        out.append(c)
    return "".join(out)


def _field(name: str) -> str:
    cases = " ".join(f"WHEN '{f.event}' THEN regexp_extract(message, {_text(_one_group(f.pattern, f.fields.index(name) + 1))}, 1)" for f in G.FORMATS if name in f.fields)
    raw = f"nullif(CASE event {cases} END, '')"
    if name in G.LISTS:
        return raw
    if name in G.FLAGS:
        return f"{raw} = 'True'"
    if name.endswith("_s"):
        return f"TRY_CAST({raw} AS DOUBLE) * 1000"
    return f"TRY_CAST({raw} AS DOUBLE)" if name in G.REALS else raw if name in G.TEXTS else f"TRY_CAST({raw} AS BIGINT)"


_NAMES = {f: f[:-2] + "_ms" if f.endswith("_s") else f for f in G.FIELDS}
EVENTS = f"""lines AS ({A.plain(A.LOG_LINES)}),
heads AS (SELECT log, entry, regexp_extract(line, {_text(G.HEADER)}, 4) AS message, epoch_ms(CAST(regexp_extract(line, {_text(G.HEADER)}, 1) AS TIMESTAMP))::DOUBLE AS ts_ms FROM lines WHERE regexp_matches(line, {_text(G.HEADER)})),
named AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(message, {_text(f.pattern)}) THEN '{f.event}'" for f in G.FORMATS)} END AS event FROM heads),
raw AS (SELECT *, {", ".join(f"{_field(n)} AS {_NAMES[n]}" for n in G.FIELDS)} FROM named WHERE event IS NOT NULL),
ev AS (SELECT * REPLACE (CASE WHEN event LIKE 'render%' THEN regexp_extract(path, '[^/]+$') WHEN event LIKE 'normalizeSource%' THEN nullif(filename, 'None') ELSE filename END AS filename, nullif(context, 'none') AS context, coalesce(page_count, CASE WHEN stop_page IS NOT NULL THEN greatest(0, stop_page - start_page + 1) END) AS page_count) FROM raw)"""

_OF_QUEUE = " ".join(f"WHEN event IN ({', '.join(map(_text, (start, *ends)))}) THEN '{n}'" for n, (start, ends, _) in R.QUEUES.items())
_SIG = " ".join(f"WHEN '{n}' THEN concat_ws('|', '{n}'{''.join(f', CAST({k} AS VARCHAR)' for k in keys)})" for n, (_, _, keys) in R.QUEUES.items())
_STARTS = ", ".join(_text(q[0]) for q in R.QUEUES.values())
_END = "CASE WHEN {t} IS NOT NULL THEN greatest({t}, {s} + coalesce({d}, 0), {s}) END"
QUEUES = f"""q0 AS (SELECT *, CASE {_OF_QUEUE} END AS queue, event IN ({_STARTS}) AS is_start FROM ev),
q1 AS (SELECT *, CASE queue {_SIG} END AS sig FROM q0 WHERE queue IS NOT NULL),
q2 AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE -1 END) OVER w AS balance FROM q1 WINDOW w AS (PARTITION BY log, sig ORDER BY entry)),
q3 AS (SELECT *, NOT is_start AND balance < least(0, coalesce(min(balance) OVER (PARTITION BY log, sig ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lone FROM q2),
q4 AS (SELECT *, row_number() OVER (PARTITION BY log, sig, is_start, lone ORDER BY entry) AS nth FROM q3),
pairs AS (SELECT s.*, f.entry AS closed, f.event AS f_event, f.ts_ms AS f_ms, f.duration_ms AS f_duration, s.ts_ms AS begun FROM q4 s LEFT JOIN q4 f ON s.log = f.log AND s.sig = f.sig AND s.nth = f.nth AND NOT f.is_start AND NOT f.lone WHERE s.is_start
  UNION ALL SELECT *, entry, event, ts_ms, duration_ms, ts_ms - coalesce(duration_ms, 0) FROM q4 WHERE lone),
queue_spans AS (SELECT log, queue, is_start, kind, CASE WHEN queue IN ('source', 'marker', 'marker_batch') THEN 'normalization' ELSE queue END AS type, filename AS file, start_page AS page_start, stop_page AS page_stop, page_count,
  CASE WHEN closed IS NULL THEN 'open' WHEN f_event IN ('rangeFailed', 'batchFailed') THEN 'error' ELSE 'success' END AS status, begun AS start_ms, {_END.format(d="f_duration", t="f_ms", s="begun")} AS end_ms, entry AS place, closed FROM pairs)"""

_KEYED = """{name} AS (SELECT *, lag(event) OVER w AS before, lag(entry) OVER w AS s_entry, lag(ts_ms) OVER w AS s_ms, lead(event) OVER w AS after, lead(entry) OVER w AS f_entry, lead(event) OVER w AS f_event, lead(ts_ms) OVER w AS f_ms, lead(duration_ms) OVER w AS f_duration
  FROM ev WHERE event IN ({events}) WINDOW w AS (PARTITION BY log, {keys} ORDER BY entry))"""
TASKS = _KEYED.format(name="t0", events="'taskSpanStart', 'taskSpanFinish'", keys="task_type, job_id, task_key") + f""",
t1 AS (SELECT *, CASE WHEN before = 'taskSpanStart' THEN s_ms ELSE ts_ms - coalesce(duration_ms, 0) END AS begun FROM t0 WHERE event = 'taskSpanFinish'),
task_spans AS (SELECT log, CASE WHEN task_type = 'generate.summary' THEN 'summary' WHEN task_type LIKE 'canonize.%' THEN 'normalization' ELSE 'job' END AS type, trim(json_extract_string(CASE WHEN before = 'taskSpanStart' THEN started ELSE filenames END, '$[0]')) AS file,
    'success' AS status, begun AS start_ms, {_END.format(d="duration_ms", t="ts_ms", s="begun")} AS end_ms, CASE WHEN before = 'taskSpanStart' THEN s_entry ELSE entry END AS place, entry AS closed
  FROM (SELECT t1.*, s.filenames AS started FROM t1 LEFT JOIN ev s ON t1.before = 'taskSpanStart' AND s.log = t1.log AND s.entry = t1.s_entry)
  UNION ALL SELECT log, CASE WHEN task_type = 'generate.summary' THEN 'summary' WHEN task_type LIKE 'canonize.%' THEN 'normalization' ELSE 'job' END, trim(json_extract_string(filenames, '$[0]')), 'open', ts_ms, NULL, entry, NULL FROM t0 WHERE event = 'taskSpanStart' AND after IS NULL)"""

_JOB_KEY = "concat_ws('|', 'job', log, {stage}, filename, start_page, stop_page, dpi)"
_STAGE_OF = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.KIND_TO_STAGE.items()) + " END"
_VAGUE = r"(context IS NULL OR NOT regexp_matches(context, '^.+?:\d+dpi$|^.+?:p\d+-\d+:\d+dpi$'))"
_BATCH_OF = "CASE request_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.BATCH_OF_REQUEST.items()) + " END"
CLAIMS = _KEYED.format(name="j0", events="'jobStart', 'jobRetrySplit', 'jobFailed'", keys="job_id") + f""",
items AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY spot) AS n FROM (
  SELECT {_JOB_KEY.format(stage="stage")} AS key, entry AS spot, CASE WHEN f_event <> 'jobStart' THEN f_entry END AS until FROM j0 WHERE event = 'jobStart'
  UNION ALL SELECT concat_ws('|', 'batch', log, kind), place, closed FROM queue_spans WHERE queue = 'batch' AND is_start)),
takers AS (SELECT key, list(spot ORDER BY spot) AS all_of FROM (
  SELECT {_JOB_KEY.format(stage=_STAGE_OF)} AS key, entry AS spot FROM ev WHERE event IN ('rangeSuccess', 'rangeFailed') AND {_STAGE_OF} IS NOT NULL
  UNION ALL SELECT concat_ws('|', 'batch', log, {_BATCH_OF}), entry FROM ev WHERE event = 'requestStart' AND {_BATCH_OF} IS NOT NULL AND {_VAGUE}) GROUP BY key),
claim AS (
  SELECT key, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS taker FROM takers
  UNION ALL SELECT key, n, CASE WHEN taker IS NULL THEN taken ELSE list_append(taken, taker) END, item, taker FROM (
    SELECT c.key, i.n, c.taken, i.spot AS item, list_min(list_filter(k.all_of, lambda x: x > i.spot AND x < coalesce(i.until, 9223372036854775807) AND NOT list_contains(c.taken, x))) AS taker
    FROM claim c JOIN items i ON i.key = c.key AND i.n = c.n + 1 JOIN takers k ON k.key = c.key)),
taken AS (SELECT item, taker FROM claim WHERE taker IS NOT NULL)"""
JOBS = f"""j1 AS (SELECT j.*, t.taker, r.end_ms AS range_end, r.status AS range_status FROM j0 j LEFT JOIN taken t ON j.event = 'jobStart' AND t.item = j.entry LEFT JOIN queue_spans r ON r.queue = 'range' AND r.closed = t.taker),
job_spans AS (
  SELECT log, 'job' AS type, filename AS file, start_page AS page_start, stop_page AS page_stop, page_count,
    CASE WHEN taker IS NOT NULL THEN range_status WHEN f_event = 'jobRetrySplit' THEN 'split' WHEN f_event = 'jobFailed' THEN 'error' ELSE 'open' END AS status, ts_ms AS start_ms,
    CASE WHEN taker IS NOT NULL THEN greatest(range_end, ts_ms) WHEN f_event <> 'jobStart' THEN {_END.format(d="f_duration", t="f_ms", s="ts_ms")} END AS end_ms, entry AS place, coalesce(taker, f_entry) AS closed
  FROM j1 WHERE event = 'jobStart' AND (taker IS NOT NULL OR f_event IS NULL OR f_event <> 'jobStart')
  UNION ALL SELECT f.log, 'job', f.filename, f.start_page, f.stop_page, f.page_count, CASE f.event WHEN 'jobRetrySplit' THEN 'split' ELSE 'error' END, f.ts_ms - coalesce(f.duration_ms, 0), f.ts_ms, f.entry, f.entry
  FROM j1 f LEFT JOIN taken t ON t.item = f.s_entry WHERE f.event <> 'jobStart' AND (f.before IS NULL OR f.before <> 'jobStart' OR t.taker IS NOT NULL))"""

_SETUP = "lane_wait_ms + semaphore_wait_ms + client_wait_ms + session_create_ms"
_SPOKE = "event IN ('requestReady', 'requestHeartbeat')"
_SAID = "event IN ('requestStart', 'requestRetrying', 'requestFinished')"
REQUESTS = f"""r0 AS (SELECT *, CASE WHEN event = 'requestStart' OR coalesce(lag(event) OVER w, 'requestFinished') = 'requestFinished' THEN 1 ELSE 0 END AS first FROM ev WHERE request_id IS NOT NULL WINDOW w AS (PARTITION BY log, request_id ORDER BY entry)),
r1 AS (SELECT *, sum(first) OVER (PARTITION BY log, request_id ORDER BY entry) AS stretch, sum(first) OVER (PARTITION BY log, request_id) AS stretches FROM r0),
r2 AS (SELECT log, request_id, stretch, max(stretches) AS stretches, min(entry) AS place, arg_min(request_name, entry) AS request_name, arg_min(ts_ms - CASE event WHEN 'requestStart' THEN 0 WHEN 'requestReady' THEN {_SETUP} ELSE coalesce(duration_ms, 0) END, entry) AS start_ms,
  max(entry) FILTER (event = 'requestFinished') AS closed, max(ts_ms) FILTER (event = 'requestFinished') AS f_ms, max(duration_ms) FILTER (event = 'requestFinished') AS f_duration, arg_max(lane, entry) FILTER ({_SPOKE}) AS lane,
  arg_max(concat(attempt, '/', attempt_max), entry) FILTER ({_SPOKE}) AS attempt, count(*) FILTER (event = 'requestRetrying') AS retries, count(*) FILTER (event = 'requestHeartbeat') AS beats, arg_max(model, entry) FILTER ({_SAID}) AS model,
  max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_read_tokens) AS cache_read_tokens, max(context) FILTER (event = 'requestStart') AS context, count(*) FILTER (event = 'requestStart') > 0 AS asked FROM r1 GROUP BY 1, 2, 3),
asking AS (SELECT log, place AS spot, unnest(CASE request_name WHEN 'medical_summary' THEN ['summary'] WHEN 'normalize_source_name' THEN ['source'] WHEN 'normalize_marker_names' THEN ['marker_batch', 'marker'] END) AS queue FROM r2 WHERE asked AND {_VAGUE}),
newest AS (SELECT a.log, a.spot, a.queue, s.place AS item FROM asking a JOIN queue_spans s ON s.log = a.log AND s.queue = a.queue AND s.is_start AND s.place < a.spot AND (s.closed IS NULL OR s.closed > a.spot) QUALIFY row_number() OVER (PARTITION BY a.log, a.spot, a.queue ORDER BY s.start_ms DESC, s.place) = 1),
context_of AS (SELECT t.taker AS spot, t.item FROM taken t JOIN queue_spans s ON s.queue = 'batch' AND s.place = t.item UNION ALL SELECT spot, item FROM newest QUALIFY row_number() OVER (PARTITION BY spot ORDER BY queue DESC) = 1),
request_spans AS (SELECT r.log, 'request' AS type, CASE WHEN {_VAGUE.replace("context", "r.context")} OR NOT r.asked THEN s.file ELSE regexp_extract(r.context, '^(.+?):(p\\d+-\\d+:)?\\d+dpi$', 1) END AS file,
    CASE WHEN {_VAGUE.replace("context", "r.context")} THEN s.page_count ELSE CASE WHEN r.context LIKE '%:p%' THEN greatest(0, CAST(regexp_extract(r.context, ':p(\\d+)-(\\d+):', 2) AS BIGINT) - CAST(regexp_extract(r.context, ':p(\\d+)-(\\d+):', 1) AS BIGINT) + 1) END END AS page_count,
    CASE WHEN r.closed IS NULL THEN 'open' ELSE 'success' END AS status, r.start_ms, {_END.format(d="f_duration", t="f_ms", s="r.start_ms")} AS end_ms, r.place, r.closed, request_name, request_id, lane, attempt, retries, beats, model, input_tokens, output_tokens, cache_read_tokens
  FROM r2 r LEFT JOIN context_of c ON r.asked AND c.spot = r.place LEFT JOIN queue_spans s ON s.log = r.log AND s.place = c.item AND s.queue NOT IN ('marker', 'marker_batch') WHERE r.closed IS NOT NULL OR stretch = stretches)""".replace("\\\\d", "\\d")

PARENTS = """parent AS (SELECT b.log, b.place AS child, b.closed AS child_closed, arg_max(m.place, m.place) AS item FROM queue_spans b JOIN queue_spans m ON b.log = m.log AND b.queue = 'marker_batch' AND b.is_start AND m.queue = 'marker' AND m.is_start AND m.place < b.place AND (m.closed IS NULL OR m.closed > b.place) GROUP BY 1, 2, 3),
fold AS (SELECT p.log, max(child) AS child FROM parent p JOIN queue_spans m ON m.log = p.log AND m.place = p.item GROUP BY p.log, p.item HAVING count(*) = 1 AND max(child_closed) < max(m.closed))"""
ALL = f"""WITH RECURSIVE {EVENTS}, {QUEUES}, {TASKS}, {CLAIMS}, {JOBS}, {REQUESTS}, {PARENTS},
loose AS (
  SELECT q.log, type, file, page_count, status, start_ms, end_ms, place, closed, f.child IS NOT NULL AS folded, NULL AS lane, NULL AS request_name, NULL AS input_tokens, NULL AS output_tokens, NULL AS cache_read_tokens FROM queue_spans q LEFT JOIN fold f ON q.queue = 'marker_batch' AND q.is_start AND f.log = q.log AND f.child = q.place
  UNION ALL SELECT log, type, file, NULL, status, start_ms, end_ms, place, closed, false, NULL, NULL, NULL, NULL, NULL FROM task_spans
  UNION ALL SELECT log, type, file, page_count, status, start_ms, end_ms, place, closed, false, NULL, NULL, NULL, NULL, NULL FROM job_spans
  UNION ALL SELECT log, type, file, page_count, status, start_ms, end_ms, place, closed, false, lane, request_name, input_tokens, output_tokens, cache_read_tokens FROM request_spans
  UNION ALL SELECT log, 'error', NULL, NULL, 'error', ts_ms, ts_ms, entry, entry, false, NULL, NULL, NULL, NULL, NULL FROM ev WHERE event = 'workerCrash'),
last_of AS (SELECT log, max(ts_ms) AS last_ms, min(ts_ms) AS first_ms, count(*) AS events, max(coalesce(queued, 0)) AS peak_queued, max(coalesce(active, 0)) AS peak_active FROM ev GROUP BY log),
spans AS (SELECT s.* REPLACE (coalesce(end_ms, greatest(last_ms, start_ms)) AS end_ms), coalesce(end_ms, greatest(last_ms, start_ms)) - start_ms AS duration_ms FROM loose s JOIN last_of USING (log))
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.view(spark, sf_dir, A.LOG_LINES)
    return G.events(lines.withColumn("h", G.header(F.col("line"))).where("h is not null").select("log", "entry", "h.*"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.written(R.spans(events(spark, sf_dir)), "spans")


_SHOWN = [_NAMES[f] for f in G.FIELDS if f not in G.LISTS]


@query(f"WITH {EVENTS} SELECT log, entry, ts_ms, event, {', '.join(_SHOWN)} FROM ev")
def runlog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("log", "entry", "ts_ms", "event", *_SHOWN)


@query(ALL + "SELECT log, type, place, closed, status, start_ms, end_ms, duration_ms, file, page_count, folded FROM spans")
def runlog_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("log", "type", "place", "closed", "status", "start_ms", "end_ms", "duration_ms", "file", "page_count", "folded")


@query(ALL + "SELECT log, request_id, place, request_name, lane, attempt, model, retries, beats, file, page_count, status, input_tokens, output_tokens, cache_read_tokens FROM request_spans")
def runlog_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).where("type = 'request'")
    return s.select("log", "request_id", "place", "request_name", "lane", "attempt", "model", "retries", F.size("heartbeats").cast("long").alias("beats"), "file", "page_count", "status", "input_tokens", "output_tokens", "cache_read_tokens")


_LANE = "coalesce(lane, request_name, 'unknown')"


@query(ALL + f"""SELECT log, {_LANE} AS lane, count(*) AS n, sum(duration_ms) / count(*) AS avg_ms, max(duration_ms) AS max_ms, count(DISTINCT file) AS files, CAST(floor(coalesce(sum(input_tokens), 0) / count(*) + 0.5) AS BIGINT) AS avg_input,
CAST(floor(coalesce(sum(output_tokens), 0) / count(*) + 0.5) AS BIGINT) AS avg_output, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cached FROM spans WHERE type = 'request' GROUP BY ALL""")
def runlog_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lane_stats(spans(spark, sf_dir))


_FAILED = "status = 'error' OR type = 'error'"


@query(ALL + f"SELECT log, file, count(*) AS spans, count(*) FILTER (type = 'job') AS jobs, count(*) FILTER (type = 'request') AS requests, count(*) FILTER ({_FAILED}) AS errors, CAST(coalesce(sum(page_count) FILTER (type = 'job'), 0) AS BIGINT) AS pages, max(duration_ms) AS max_ms FROM spans WHERE file IS NOT NULL GROUP BY ALL")
def runlog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.file_stats(spans(spark, sf_dir))


@query(ALL + "SELECT log, page_count AS pages, count(*) AS n, sum(duration_ms) AS total_ms, max(duration_ms) AS max_ms, sum(duration_ms) / count(*) AS avg_ms FROM spans WHERE type = 'job' AND page_count IS NOT NULL GROUP BY ALL")
def runlog_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_stats(spans(spark, sf_dir))


@query(ALL + "SELECT log, coalesce(file, 'global') AS file, file IS NULL AS last, count(*) AS spans, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM spans WHERE NOT folded GROUP BY ALL")
def runlog_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.waterfall(spans(spark, sf_dir))


_PAID = "type = 'request' AND input_tokens > 0"


@query(ALL + f"""SELECT s.log, any_value(events) AS events, count(*) AS spans, count(*) FILTER (type = 'job') AS jobs, count(*) FILTER (type = 'request') AS requests, count(*) FILTER ({_FAILED}) AS errors, count(*) FILTER (status = 'open') AS open, count(DISTINCT file) AS files,
coalesce(max(page_count) FILTER (type = 'job'), 0) AS largest_batch, CAST(coalesce(sum(input_tokens) FILTER ({_PAID}), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER ({_PAID}), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens) FILTER ({_PAID}), 0) AS BIGINT) AS cached,
max(duration_ms) AS longest_ms, any_value(peak_queued) AS peak_queued, any_value(peak_active) AS peak_active, greatest(any_value(last_ms), max(end_ms)) - any_value(first_ms) AS duration_ms,
CAST(coalesce(floor(sum(input_tokens) FILTER ({_PAID}) / count(*) FILTER ({_PAID}) + 0.5), 0) AS BIGINT) AS avg_input, CAST(coalesce(floor(sum(output_tokens) FILTER ({_PAID}) / count(*) FILTER ({_PAID}) + 0.5), 0) AS BIGINT) AS avg_output
FROM spans s JOIN last_of l ON s.log = l.log GROUP BY s.log""")
def runlog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return R.summary(spans(spark, sf_dir), ev)
