"""A stream's requests equal the batch's."""

import random
import tempfile

from pyspark.sql import functions as F

from titerloom.operators import loggrammar as G
from titerloom.operators import runlog as R
from titerloom.streaming import requests as S


def line(r, k):
    asked = f"request_name=medical_summary request_id=r{r.randrange(9)}"
    took = f"duration={r.randrange(0, 9)}.5s"
    kinds = [
        f"Copilot request starting {asked} model=m reasoning_effort=e timeout=9s attachments=1 prompt_chars=1 context=c.png:300dpi",
        f"Copilot request ready {asked} attempt=1/3 lane=l{k % 3} lane_wait_ms=1.5 semaphore_wait_ms=2 client_wait_ms=0 session_create_ms=0 queued_requests=1 active_requests=1",
        f"Copilot request still running {asked} lane=h attempt=2/3 elapsed=4.5s queued_requests=1 active_requests=1", f"Copilot request retrying {asked} attempt=1/3 model=n reasoning_effort=e attachments=1 {took} delay=1s error=e",
        f"Copilot request finished {asked} model=m reasoning_effort=e attachments=1 {took} response_chars=1 usage_cost=0.5 input_tokens={k} output_tokens=2 cache_read_tokens=3", f"Copilot request finished {asked} model=m reasoning_effort=e attachments=1 {took} response_chars=1 usage_cost=0.5",
    ]
    return f"2024-01-01 00:{k // 60 % 60:02d}:{k % 60:02d} INFO app.x {r.choice(kinds)}"


def test_stream_equals_batch(spark):
    r = random.Random(4)
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [("l", k, line(r, k)) for k in range(400)]
    # Lines of another log, a day later, let the others' time run out.
    rows += [("z", 400 + 100 * k, line(r, 0).replace("2024-01-01", "2024-01-02")) for k in range(2)]
    for part in range(6):
        cut = [x for x in rows if x[1] // 100 == part]
        spark.createDataFrame(cut, "log string, entry long, line string").coalesce(1).write.parquet(f"file://{folder}/in/{part}")
    shape = "log string, entry long, line string"

    def events(lines):
        return G.events(lines.withColumn("h", G.header(F.col("line"))).select("log", "entry", "h.*"))

    stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    out = S.request_spans(events(stream).withWatermark("ts", "1 second"), idle_ms=60_000)
    query = out.writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(150) and query.exception() is None
    columns = ["log", "request_id", "place", "request_name", "status", "start_ms", "end_ms", "closed", "lane", "attempt", "retries", "heartbeats", "ready_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens", "usage_cost"]
    got = spark.read.parquet(f"file://{folder}/out").select(columns).collect()
    batch = R.request_spans(events(spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(f"file://{folder}/in")), spark.createDataFrame([], "of string, asked_at long, taken struct<title: string, files: array<string>, page_start: long, page_stop: long, page_count: long>"))
    want = batch.select(columns).collect()
    plain = lambda x: tuple(tuple(v) if isinstance(v, list) else v for v in x)
    closed = lambda rows: sorted((plain(x) for x in rows if x["status"] == "success" and x["log"] == "l"), key=str)
    assert closed(got) == closed(want) and len(closed(want)) > 40
    ends = columns.index("end_ms")
    left = lambda rows: sorted((plain(x)[:ends] + plain(x)[ends + 1 :] for x in rows if x["status"] == "open" and x["log"] == "l"), key=str)
    assert left(got) == left(want) and left(want)
