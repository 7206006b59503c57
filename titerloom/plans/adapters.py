"""The given star-schema tables seen as the model's: results, files, rules, documents, logs.

Each view is one SELECT in the SQL that Spark and other engines share, so a query and the SQL
it is held against read the very same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Results: one an event. Nulls, words, flags and missing conversions by the id.
RESULTS = """
SELECT event_id AS id, event_type AS marker, concat('group ', length(event_type) % 3) AS group_name, user_id AS file_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_id % 11 <> 0 THEN value END AS value,
  CASE WHEN event_id % 22 = 0 THEN concat('<', event_id % 120) WHEN event_id % 11 = 0 THEN 'Negative.' END AS text,
  CASE WHEN event_id % 33 = 0 THEN event_id % 2 = 0 END AS flag,
  event_id % 17 = 0 AS missing,
  CASE WHEN event_id % 3 <> 0 THEN CAST(5 AS DOUBLE) END AS low,
  CASE WHEN event_id % 5 <> 0 THEN CAST(100 AS DOUBLE) END AS high
FROM {events}
"""
#: Results with many markers: one a line item, by part.
LINES = """
SELECT l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 8 + l_linenumber AS id, l_partkey AS type_id, l_orderkey AS file_id,
  l_quantity AS original_value, CASE WHEN l_linestatus = 'F' THEN 'mg / dL' WHEN l_linenumber = 7 THEN NULL ELSE 'MMOL/l' END AS original_unit,
  l_linenumber AS line, l_returnflag AS code, l_shipdate AS ts, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
FROM {lineitem}
"""
TYPES = """
SELECT p_partkey AS type_id, concat('M', p_partkey) AS type_name, p_type AS group_name, CASE WHEN p_partkey % 7 <> 0 THEN 'mmol/L' END AS canonical_unit
FROM {part}
"""
#: Unit rules by type: some have no rule, some a rule without a factor.
UNIT_RULES = """
SELECT p_partkey AS id, p_partkey AS type_id, 'mg/dl' AS original_key, 'mmol/l' AS canonical_key, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) / 100 END AS factor
FROM {part} WHERE p_partkey % 3 <> 0
"""
FILES = """
SELECT o_orderkey AS file_id, concat('order-', o_orderkey) AS filename, o_orderdate AS uploaded_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS lab_date, CAST(7 AS INT) AS page_count, o_orderstatus AS code, o_orderpriority AS priority, o_totalprice AS total, o_custkey AS owner
FROM {orders}
"""
TAGS = """
SELECT o_orderkey AS file_id, concat('status:', o_orderstatus) AS tag FROM {orders}
UNION ALL SELECT o_orderkey AS file_id, o_orderpriority AS tag FROM {orders}
UNION ALL SELECT o_orderkey AS file_id, concat(' source : S ', o_custkey % 7) AS tag FROM {orders} WHERE o_custkey % 2 = 0
"""
BATCHES = """
SELECT l_orderkey AS file_id, CAST(l_linenumber - 1 AS INT) AS start_page, CAST(l_linenumber - 1 + l_suppkey % 3 AS INT) AS stop_page FROM {lineitem} WHERE l_partkey % 2 = 0
"""
JOBS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'extract' ELSE 'index' END AS task_type, concat('file:', o_orderkey % 5000) AS task_key, o_custkey AS file_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'leased' WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'resolved' ELSE 'pending' END AS status,
  CAST(o_orderkey % 4 * 50 AS INT) AS priority, o_orderdate AS created_at, o_orderdate AS available_at, o_orderdate AS lease_until, o_orderdate AS updated_at,
  CAST(o_orderkey % 6 AS INT) AS attempt_count, CASE WHEN o_orderkey % 7 = 0 THEN concat('failure ', o_orderkey % 13) END AS error_text
FROM {orders}
"""
#: Log lines of requests and jobs: starts and finishes by the id, some finishes without a start.
LOG_EVENTS = """
SELECT event_id AS entry, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type IN ('click', 'view') THEN 'request' WHEN event_type = 'error' THEN 'job' ELSE 'batch' END AS kind,
  concat(CASE WHEN event_type IN ('click', 'view') THEN 'request' WHEN event_type = 'error' THEN 'job' ELSE 'batch' END,
         CASE WHEN event_id % 2 = 0 THEN ' start' ELSE ' finish' END, ' id=', event_id / 2, CASE WHEN event_id % 7 <> 0 THEN concat(' file=f', user_id) ELSE '' END,
         CASE WHEN event_id % 3 = 0 THEN concat(' lane=l', user_id % 4) ELSE '' END, ' effort=high pages=', user_id % 5, ' duration_ms=', event_id % 900,
         ' input_tokens=', event_id % 50, ' output_tokens=', event_id % 20) AS message
FROM {events}
""".replace("event_id / 2", "(event_id - event_id % 2)")

#: Two run logs, one line an event, of every kind of message: starts and finishes that interleave,
#: some without the other; requests with and without a context; lines that are no event.
_K = "event_id % 41"
_C = "CAST((event_id - event_id % 41) / 41 AS BIGINT)"
_STAGE = "CASE WHEN user_id % 2 = 0 THEN 'text' ELSE 'measurements' END"
_KIND = "CASE WHEN user_id % 5 = 0 THEN 'Other' WHEN user_id % 2 = 0 THEN 'Document text' ELSE 'Structured medical' END"
_PAGES = "CASE WHEN user_id % 4 < 2 THEN '1-2' ELSE '3-3' END, ' dpi=144'"
_TOOK = "' duration=', event_id % 900, '.', user_id % 10, 's'"
_NAME = "CASE user_id % 6 WHEN 0 THEN 'document_text_extraction' WHEN 1 THEN 'structured_medical_extraction' WHEN 2 THEN 'medical_summary' WHEN 3 THEN 'normalize_source_name' WHEN 4 THEN 'normalize_marker_names' ELSE 'other_name' END"
_OWN = f"' filename=f', user_id % 3, '.pdf pages=', {_PAGES}"
_PATH = f"' path=/d/f', user_id % 3, '.pdf', {_OWN}"
_TASK = "' task_type=', CASE WHEN user_id % 3 = 0 THEN 'generate.summary' WHEN user_id % 3 = 1 THEN 'canonize.source' ELSE 'assemble.text' END, ' job_id=', event_id % 5, ' task_key=file:', user_id % 3, ' file_ids=[1,2] filenames=[\"f', user_id % 3, '.pdf\"]'"
_JOB_OF = lambda back: f"' stage=', {_STAGE}, ' job_id=', {back}, ' file_id=', user_id % 3, {_OWN}"
_ASK = lambda c, x: f"' request_name=', {_NAME}, ' request_id=r', {c}, 'x', {x}"
_MODEL = "' model=m', user_id % 2, ' reasoning_effort=high'"
MESSAGE = f"""CASE
  WHEN {_K} < 2 THEN concat('Task span start', {_TASK}) WHEN {_K} < 4 THEN concat('Task span finish', {_TASK}, {_TOOK}, ' outcome=done')
  WHEN {_K} < 7 THEN concat('Extraction job start', {_JOB_OF('event_id')}, ' attempts=1 queued_requests=', user_id % 9, ' active_requests=', user_id % 4)
  WHEN {_K} = 7 THEN concat('Extraction job retry split', {_JOB_OF('event_id - 1 - user_id % 3')}, ' fallback_ranges=1-1,2-2', {_TOOK}, ' error=too large')
  WHEN {_K} = 8 THEN concat('Extraction job failed', {_JOB_OF('event_id - 43 - user_id % 3')}, {_TOOK}, ' error=no luck')
  WHEN {_K} < 11 THEN concat({_KIND}, ' range start', {_PATH}, ' page_count=2') WHEN {_K} < 13 THEN concat({_KIND}, ' range success', {_PATH}, {_TOOK})
  WHEN {_K} = 13 THEN concat({_KIND}, ' range failed', {_PATH}, ' after ', event_id % 900, '.5s')
  WHEN {_K} < 16 THEN concat('PDF batch extract start kind=', {_KIND}, {_PATH}) WHEN {_K} = 16 THEN concat('PDF batch extract done kind=', {_KIND}, {_PATH}, {_TOOK})
  WHEN {_K} = 17 THEN concat('PDF batch extract failed kind=', {_KIND}, {_PATH}, ' after ', event_id % 900, '.5s')
  WHEN {_K} = 18 THEN concat('Rendering PDF pages path=/d/f', user_id % 3, '.pdf pages=', {_PAGES}) WHEN {_K} = 19 THEN concat('Rendered PDF pages path=/d/f', user_id % 3, '.pdf pages=', {_PAGES}, ' image_count=2', {_TOOK})
  WHEN {_K} < 22 OR ({_K} = 37 AND user_id % 7 < 2) THEN concat('Copilot request starting', {_ASK(_C, _K + ' % 2')}, {_MODEL}, ' timeout=900s attachments=2 prompt_chars=', event_id,
    CASE WHEN user_id % 5 = 0 THEN concat(' context=f', user_id % 3, '.pdf:p1-2:144dpi') WHEN user_id % 5 = 1 THEN ' context=none' WHEN user_id % 5 = 2 THEN ' context=scan.png:300dpi' ELSE '' END)
  WHEN {_K} = 22 THEN concat('Copilot request ready', {_ASK(_C, '0')}, ' attempt=1/3 lane=l', user_id % 4, ' lane_wait_ms=', user_id, '.5 semaphore_wait_ms=1.0 client_wait_ms=2.0 session_create_ms=3.0 applied_reasoning_effort=high queued_requests=', user_id % 7, ' active_requests=', user_id % 5)
  WHEN {_K} = 23 THEN concat('Copilot request still running', {_ASK(f'{_C} - user_id % 2', '1')}, ' lane=l', user_id % 4, ' attempt=2/3 elapsed=', event_id % 900, '.25s queued_requests=0 active_requests=1')
  WHEN {_K} = 24 THEN concat('Copilot request retrying', {_ASK(_C, '0')}, ' attempt=1/3', {_MODEL}, ' attachments=2', {_TOOK}, ' delay=2s error=reset')
  WHEN {_K} = 25 THEN concat('Copilot request finished', {_ASK(f'{_C} - user_id % 2', '0')}, {_MODEL}, ' attachments=2', {_TOOK}, ' response_chars=9 usage_cost=0.3300 input_tokens=', event_id % 700, ' output_tokens=', event_id % 90, ' cache_read_tokens=', user_id, ' context=none')
  WHEN {_K} = 26 AND user_id % 3 > 0 THEN concat('Copilot request finished', {_ASK(_C, '1')}, {_MODEL}, ' attachments=2', {_TOOK}, ' response_chars=9 usage_cost=1')
  WHEN {_K} = 27 THEN concat('Medical summary start filename=f', user_id % 3, '.pdf raw_text=True') WHEN {_K} = 28 THEN concat('Medical summary finished filename=f', user_id % 3, '.pdf has_summary=True has_lab_date=False has_source=True', {_TOOK})
  WHEN {_K} = 29 THEN concat('Normalize source start source_present=True filename_present=True filename=', CASE WHEN user_id % 2 = 0 THEN 'None' ELSE 'g.pdf' END, ' existing_canonical=4')
  WHEN {_K} = 30 AND user_id % 5 > 0 THEN concat('Normalize source finished normalized=True', {_TOOK})
  WHEN {_K} = 31 THEN concat('Normalize marker names start new_names=', user_id, ' existing_canonical=5 batch_size=100 concurrency=2') WHEN {_K} = 32 OR ({_K} = 35 AND user_id % 3 = 0) THEN concat('Normalize marker names batch start batch=1/', 1 + user_id % 2, ' batch_names=5 existing_canonical=7')
  WHEN {_K} = 33 THEN 'Normalize marker names batch finished batch=1/2 resolved=4 existing_canonical=7' WHEN {_K} = 34 AND user_id % 4 > 0 THEN concat('Normalize marker names finished input_names=5 representative_names=4 resolved=3', {_TOOK})
  WHEN {_K} = 36 AND user_id % 5 = 0 THEN 'Worker loop crashed worker=w1 task_types=text,summary'
  ELSE concat('Saved file ', user_id) END"""
LOG_LINES = f"""
SELECT concat('run', user_id % 2) AS log, event_id AS entry, concat(substr(CAST(CAST(ts AS TIMESTAMP) AS STRING), 1, 19), CASE WHEN user_id % 3 = 0 THEN ' NOTICE' ELSE ' INFO' END, ' app.worker ', {MESSAGE}) AS line
FROM {{events}}
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows, with the tables it names read from sf_dir."""
    tables = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def plain(sql: str) -> str:
    """The view's SQL over tables by their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
