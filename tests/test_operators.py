"""Operators on small fixtures."""

import datetime as dt
import os

from pyspark.sql import functions as F


from titerloom.operators import coverage, effective, history, logspans, reports, rules, search, sets, timeline
from titerloom.sources import bundle, files
from titerloom.streaming import pipeline

ROWS = "marker string, group_name string, file_id long, id long, ts timestamp, value double, text string, flag boolean, missing boolean, low double, high double"


def at(day):
    return dt.datetime(2024, 1, day)


def test_overview_keeps_the_newest_pair_together(spark):
    rows = [
        ("iron", "Blood", 1, 1, at(1), 5.0, None, None, False, 1.0, None),
        ("iron", "Blood", 2, 2, at(2), 6.0, None, None, False, None, 9.0),
        ("iron", "Blood", 3, 3, at(3), 12.0, None, None, False, None, None),
        ("zinc", "", 1, 4, at(1), None, None, True, False, None, None),
    ]
    got = {r["marker"]: r for r in history.overview(spark.createDataFrame(rows, ROWS)).collect()}
    iron = got["iron"]
    assert tuple(iron["range"]) == (None, 9.0) and iron["status"] == "high" and iron["previous"]["id"] == 2
    assert iron["tags"] == ["group:Blood", "multipleMeasurements", "someOutOfRange"] and iron["total_count"] == 3
    assert got["zinc"]["status"] == "positive" and got["zinc"]["previous"] is None and got["zinc"]["tags"][0] == "singleMeasurement"


def test_envelopes_without_own_file(spark):
    rows = [("m", "", f, i, at(1), v, None, None, False, None, None) for i, (f, v) in enumerate([(1, 1.0), (1, 9.0), (2, 3.0), (3, 9.0), (3, float("inf"))])]
    got = {r["file_id"]: (r["file_count"], r["value_count"], r["value_min"], r["value_max"]) for r in history.envelopes_without_own_file(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: (2, 2, 3.0, 9.0), 2: (2, 3, 1.0, 9.0), 3: (2, 3, 1.0, 9.0)}


def test_overrides(spark):
    rows = spark.createDataFrame([(1, 5.0, None, True), (2, 5.0, 7.0, False)], "id long, value double, user_value double, user_value_override boolean")
    got = effective.with_effective(rows, ("value",)).orderBy("id").collect()
    assert [r["effective_value"] for r in got] == [None, 5.0] and got[0]["user_edited_fields"] == ["value"] and not got[1]["has_user_edits"]
    edits = spark.createDataFrame([(1, {"value": "8"}, ["value"]), (2, {"value": "8.5"}, [])], "id long, set map<string,string>, reset array<string>")
    got = effective.apply_edits(rows, edits, "id", ("value",)).orderBy("id").collect()
    assert [(r["user_value"], r["user_value_override"]) for r in got] == [(None, False), (8.5, True)]


def _ladder(spark, rows, failed=None):
    types = spark.createDataFrame([(1, "Iron", "Blood", "g/L"), (2, "Zinc", None, None), (3, "Germ", "Other", None)], "type_id long, type_name string, group_name string, canonical_unit string")
    aliases = spark.createDataFrame([("iron", 1), ("zinc", 2), ("germ", 3)], "alias_key string, type_id long")
    units = spark.createDataFrame([(1, "mg/l", "g/l", 0.001), (1, "u/l", "g/l", None)], "type_id long, original_key string, canonical_key string, factor double")
    words = spark.createDataFrame([("reactive", "Positive", True)], "word_key string, word string, flag boolean")
    df = spark.createDataFrame(rows, "id long, raw_name string, original_value double, original_text string, original_unit string, original_low double, original_high double")
    return {r["id"]: r for r in rules.apply_rules(df, types, aliases, units, words, failed).collect()}


def test_ladder(spark):
    rows = [
        (1, "IRON", 500.0, None, "mg/L", 100.0, 900.0),
        (2, "Iron", 5.0, None, "G/l", 1.0, 2.0),
        (3, "Iron", 5.0, None, "U/L", 1.0, 2.0),
        (4, "Iron", 5.0, None, "mol", 1.0, 2.0),
        (5, "Copper", 5.0, None, None, None, None),
        (6, "Zinc", 5.0, None, "g", None, None),
        (7, "Germ", None, "Reactive", None, None, 3.0),
        (8, "Germ", None, "<5", None, None, 5.0),
        (9, "Germ", None, "odd", None, None, None),
        (10, "Germ", None, None, None, 1.0, 2.0),
        (11, "Germ", None, "...", None, None, None),
    ]
    got = _ladder(spark, rows)
    assert (got[1]["canonical_value"], got[1]["canonical_low"], got[1]["status"], got[1]["check_anomaly"]) == (0.5, 0.1, "resolved", True)
    assert (got[2]["canonical_value"], got[2]["status"]) == (5.0, "resolved")
    assert (got[3]["canonical_value"], got[3]["status"], got[3]["check_anomaly"]) == (None, "resolved", False)
    assert got[4]["status"] == "pending" and got[4]["needs"] == ["conversion:1|mol|g/l"]
    assert got[5]["needs"] == ["marker:copper"] and got[5]["type_id"] is None
    assert set(got[6]["needs"]) == {"group:2", "unit:2"} and got[6]["canonical_value"] is None
    assert (got[7]["qualitative_value"], got[7]["qualitative_flag"], got[7]["canonical_high"]) == ("Positive", True, None)
    assert (got[8]["qualitative_value"], got[8]["qualitative_flag"], got[8]["canonical_high"]) == ("negative", False, 5.0)
    assert got[9]["needs"] == ["word:odd"] and got[10]["status"] == "resolved" and got[10]["canonical_low"] == 1.0
    assert got[11]["status"] == "error"
    failed = spark.createDataFrame([("word:odd",)], "task string")
    assert _ladder(spark, rows, failed)[9]["status"] == "error"


def test_anomaly(spark):
    env = spark.createDataFrame([("m", 9, 3, 3, 4.0, 6.0, 3, 1.0, 1.2, 3, 9.0, 10.0)], "marker string, file_id long, file_count long, value_count long, value_min double, value_max double, low_count long, low_min double, low_max double, high_count long, high_min double, high_max double")
    rows = spark.createDataFrame([(1, "m", 9, 5000.0, 1000.0, 9500.0), (2, "m", 9, 5.0, 1.0, 9.0), (3, "m", 9, 5000.0, None, None), (4, "m", 9, 77777.0, None, None)], "id long, marker string, file_id long, value double, low double, high double")
    out = rules.anomaly_candidates(rows, env)
    got = {r["id"]: (r["outlier"], r["candidates"], r["factor"]) for r in out.collect()}
    assert got == {1: (True, [0.001], 0.001), 2: (False, [], None), 3: (True, [0.001], None), 4: (True, [], None)}
    none = spark.createDataFrame([], "id long, signature string, state string, factor double")
    out = rules.review_signature(out.withColumn("unit", F.when(F.col("id") == 3, F.lit("µg/\"L"))), env)
    import hashlib
    import json

    signed = {"canonical_unit": 'µg/"L', "canonical_value": "5000", "reference_low": None, "reference_high": None, "historical_value_min": "4", "historical_value_max": "6", "historical_reference_low_min": "1", "historical_reference_low_max": "1.2", "historical_reference_high_min": "9", "historical_reference_high_max": "10", "history_sample_count": 3, "history_range_count": 3, "candidate_factors": ["0.001"]}
    assert {r["id"]: r["signature"] for r in out.collect()}[3] == hashlib.sha1(json.dumps(signed, sort_keys=True).encode()).hexdigest()
    done = {r["id"]: r for r in rules.apply_reviews(out, none).collect()}
    assert [done[i]["status"] for i in (1, 2, 3, 4)] == ["resolved", "resolved", "pending", "resolved"] and done[1]["value"] == 5.0
    review = spark.createDataFrame([(3, done[3]["signature"], "resolved", 0.001)], "id long, signature string, state string, factor double")
    assert {r["id"]: r["value"] for r in rules.apply_reviews(out, review).collect()}[3] == 5.0


def test_upserts_and_queue(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (3, "f", 2)], "k long, v string, n long")
    assert {(r.k, r.v) for r in sets.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "d"), (3, "f")}
    assert {(r.k, r.v) for r in sets.insert_missing(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "b"), (3, "e")}
    jobs = spark.createDataFrame([("t", "a", "leased", False), ("t", "b", "failed", False)], "task_type string, task_key string, status string, rerun_requested boolean")
    wanted = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c"), ("t", "c")], "task_type string, task_key string")
    once = sets.enqueue(jobs, wanted)
    assert {tuple(r) for r in once.collect()} == {("t", "a", "leased", True), ("t", "b", "pending", False), ("t", "c", "pending", False)}
    assert {tuple(r) for r in sets.enqueue(once, wanted).collect()} == {tuple(r) for r in once.collect()}


def test_coverage(spark):
    f = spark.createDataFrame([(1, 7), (2, 2)], "file_id long, page_count int")
    b = spark.createDataFrame([(1, 2, 3), (1, -4, 1), (1, 5, 5)], "file_id long, start_page int, stop_page int")
    got = sorted(tuple(r) for r in coverage.missing_ranges(f, b).collect())
    assert got == [(1, 1, 2), (1, 3, 5), (1, 5, 7), (2, 0, 2)]


def test_lanes(spark):
    d = lambda m, day=1: dt.date(2024, m, day)
    rows = [("p", 1, d(1), d(3), "2024-01", "2024-03"), ("p", 2, d(2), d(4), "2024-02", "2024-04"), ("p", 3, d(3), d(5), "2024-03", "2024-05"), ("p", 4, d(4, 1), d(6), "2024-04", "")]
    got = {r["bar"]: (r["lane"], r["shown_end"]) for r in timeline.lanes(spark.createDataFrame(rows, "owner string, bar long, start date, end date, start_month string, end_month string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 1, 3: 0, 4: 1} and got[2][1] == d(4)


def test_log_entries_and_pairing(spark):
    text = ["stray", "2024-01-01 10:00:00,250 INFO app.jobs job start id=1", "more", "2024-01-01 10:00:01 ERROR app boom"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    got = logspans.entries(lines).orderBy("entry").collect()
    assert [(r["level"], r["message"]) for r in got] == [("INFO", "job start id=1\nmore"), ("ERROR", "boom")] and got[0]["ts"].microsecond == 250000
    ev = [("s", at(1), 1, "finish", 500), ("s", at(2), 2, "start", None), ("s", at(3), 3, "start", None), ("s", at(4), 4, "finish", None)]
    df = spark.createDataFrame(ev, "sig string, ts timestamp, entry long, what string, duration_ms long")
    got = sorted((str(r["start"]), str(r["end"]), r["status"]) for r in logspans.pair_fifo(df, "sig").collect())
    assert got == [("2023-12-31 23:59:59.500000", "2024-01-01 00:00:00", "done"), ("2024-01-02 00:00:00", "2024-01-04 00:00:00", "done"), ("2024-01-03 00:00:00", "None", "open")]


def test_search(spark):
    docs = spark.createDataFrame([(1, "iron test", "lab"), (2, "ironing", "iron lab"), (3, "zinc", "x")], "doc_id long, raw string, tags string")
    got = {r["doc_id"]: r["score"] for r in search.bm25(docs, "iron lab", {"raw": 1.2, "tags": 2.2}).collect()}
    assert set(got) == {1, 2} and got[2] < got[1]
    assert search.bm25(docs, "!!", {"raw": 1.0}).count() == 0
    assert {r["doc_id"]: r["score"] for r in search.offline(docs, "iron", {"raw": 2, "tags": 4}).collect()} == {1: 2, 2: 6}


def test_sources(spark, tmp_path):
    for name, body in {"a": b"%PDF", "a.originalName": b"scan.pdf", "b.txt": b"\xef\xbb\xbfx\r\ny\n", "c.bin": b"?"}.items():
        (tmp_path / name).write_bytes(body)
    known = spark.createDataFrame([], "path string")
    got = {os.path.basename(r["path"]): (r["kind"], r["original_name"]) for r in files.scan_uploads(spark, str(tmp_path), known).collect()}
    assert got == {"a": ("application/pdf", "scan.pdf"), "b.txt": ("text/plain", None)}
    assert files.read_texts(spark, str(tmp_path / "b.txt")).first()["text"] == "x\ny"


def test_bundle_blanks_private_columns(spark):
    f = spark.createDataFrame([(1, "/secret", "raw")], "file_id long, filepath string, ocr_raw string")
    m = spark.createDataFrame([(1, 5.0)], "file_id long, value double")
    t = spark.createDataFrame([(1, "b"), (1, "a")], "file_id long, tag string")
    text = bundle.file_parts(f, m, t).first()["json"]
    assert "secret" not in text and '"ocr_raw":null' in text and '"tags":["a","b"]' in text


def test_stream_resolves_pending_later(spark, tmp_path):
    raw = "id long, raw_name string, original_value double, original_text string, original_unit string, original_low double, original_high double"
    spark.createDataFrame([(1, "Iron", 5.0, None, None, None, None), (2, "New", 1.0, None, None, None, None)], raw).write.parquet(str(tmp_path / "in"))
    table = {
        "types": spark.createDataFrame([(1, "Iron", "Blood", "g/L")], "type_id long, type_name string, group_name string, canonical_unit string"),
        "aliases": spark.createDataFrame([("iron", 1)], "alias_key string, type_id long"),
        "unit_rules": spark.createDataFrame([], "type_id long, original_key string, canonical_key string, factor double"),
        "word_rules": spark.createDataFrame([], "word_key string, word string, flag boolean"),
    }
    source = spark.readStream.schema(raw).parquet(str(tmp_path / "in"))
    pipeline.start(source, lambda s: table, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert {r["id"]: r["status"] for r in done.collect()} == {1: "resolved", 2: "pending"}
    table["aliases"] = spark.createDataFrame([("iron", 1), ("new", 1)], "alias_key string, type_id long")
    cols = [c.strip().split(" ")[0] for c in raw.split(",")]
    again = pipeline.retry_pending(done, cols, table)
    assert {r["id"]: r["status"] for r in again.collect()} == {1: "resolved", 2: "resolved"}
    assert pipeline.fingerprint(again) != pipeline.fingerprint(done)


def test_trends_draw_every_point_over_a_span_of_one(spark):
    rows = spark.createDataFrame([("a", i, i, float(i % 2) / 10) for i in range(30)] + [("b", i, i, float(i)) for i in range(8)] + [("c", 1, 1, 3.0)], "marker string, id long, ts long, value double")
    got = {r["marker"]: r["trend"] for r in history.trend_glyphs(rows).collect()}
    assert got == {"a": "▁▂" * 15, "b": "▁▂▃▄▅▆▇█", "c": "1 result"}


def test_gauges_marks_and_failures(spark):
    df = spark.createDataFrame([(5.0, 2.0, 4.0, 1.2, 5.5), (3.0, 2.0, 12.0, -2.0, 16.0), (10.0, None, 4.0, 8.0, 12.0), (0.0, None, None, -1.0, 1.0)], "v double, a double, b double, x double, y double")
    for r in df.select("x", "y", reports.gauge_bounds(F.col("v"), F.col("a"), F.col("b")).alias("g")).collect():
        assert abs(r["g"]["a"] - r["x"]) < 1e-9 and abs(r["g"]["b"] - r["y"]) < 1e-9
    df = spark.createDataFrame([("low", False, "⬇️ "), ("high", False, "⬆️ "), ("normal", False, "↔️ "), ("neutral", False, ""), ("normal", True, ""), ("positive", False, "")], "c string, w boolean, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", reports.mark(F.col("c"), F.col("w")).alias("got")).collect())
    says = {"HTTP 413": "request-too-large", "Failed to parse request body": "request-too-large", "Timeout waiting for session.idle": "timeout", "timeout": "ValueError", "Too Many Requests": "rate-limit", "429": "rate-limit", "HTTP 429: failed to parse request": "rate-limit", "429 timeout session.idle": "timeout", "bad json": "ValueError"}
    df = spark.createDataFrame(list(says.items()), "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", sets.failure_kind(F.col("t"), F.lit("ValueError")).alias("got")).collect())
    assert df.limit(1).select(sets.failure_kind(F.lit("x"), F.lit("TimeoutError")).alias("k")).first()["k"] == "timeout"


def test_stream_takes_pending_rows_along(spark, tmp_path):
    raw = "id long, raw_name string, original_value double, original_text string, original_unit string, original_low double, original_high double"
    row = lambda i, name: (i, name, 1.0, None, None, None, None)
    table = {
        "types": spark.createDataFrame([(1, "Iron", "Blood", "g/L")], "type_id long, type_name string, group_name string, canonical_unit string"),
        "aliases": spark.createDataFrame([("iron", 1)], "alias_key string, type_id long"),
        "unit_rules": spark.createDataFrame([], "type_id long, original_key string, canonical_key string, factor double"),
        "word_rules": spark.createDataFrame([], "word_key string, word string, flag boolean"),
    }
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows, names in (([row(1, "Iron"), row(2, "New"), row(3, "Odd")], ["iron"]), ([row(4, "Iron")], ["iron", "new"])):
        spark.createDataFrame(rows, raw).write.mode("append").parquet(folder)
        table["aliases"] = spark.createDataFrame([(n, 1) for n in names], "alias_key string, type_id long")
        pipeline.start(spark.readStream.schema(raw).parquet(folder), lambda s: table, out, ck).awaitTermination(60)
    assert sorted((r["id"], r["status"]) for r in pipeline.current(spark, out).collect()) == [(1, "resolved"), (2, "resolved"), (3, "pending"), (4, "resolved")]
