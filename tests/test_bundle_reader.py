"""What a reader asks of a bundle, and small texts of the display."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from titerloom.operators import display as D
from titerloom.sources.bundle import Bundle


@pytest.fixture(scope="module")
def bundle(spark):
    f = spark.createDataFrame
    files = f([(1, "Blood one.pdf", "2024-01-02", "2024-01-01", 2, "application/pdf", "raw iron text", None, ["u1", "u2"], "/secret"), (2, "two.png", "2024-02-02", None, 1, "image/png", None, "English IRON " + "x " * 100, None, "/secret")], "file_id long, filename string, uploaded_at string, lab_date string, page_count int, mime_type string, raw string, translated string, page_image_urls array<string>, filepath string")
    values = f([(1, 11, "Iron", "2024-01-01", "5 mg"), (1, 10, "Zinc", None, "1"), (2, 12, "Iron", "2023-01-01", "6 mg")], "file_id long, id long, marker string, measured_at string, value_text string")
    tags = f([(1, "b"), (1, "a"), (2, "a")], "file_id long, tag string")
    markers = f([("Iron", "Blood", 10), ("Zinc", None, None), ("Alpha", "Blood", 10)], "marker string, group_name string, display_order int")
    marks = f([("Iron", "t"), ("Alpha", "t"), ("Alpha", "u")], "marker string, tag string")
    history = f([("Iron", "2024-01-01", 11, 5.0), ("Iron", "2023-01-01", 12, 6.0)], "marker string, at string, id long, value double")
    out = Bundle(spark, "file://" + tempfile.mkdtemp(prefix="spark-") + "/b")
    out.write(files, values, tags, markers, marks, history, history)
    return out


def ids(df, c="file_id"):
    return [r[c] for r in df.collect()]


def test_reader(bundle):
    assert sorted(ids(bundle.files())) == [1, 2] and ids(bundle.files(["a", "b"])) == [1] and bundle.files().where("filepath <> ''").count() == 0
    assert ids(bundle.measurements(), "id") == [10, 12, 11] and ids(bundle.measurements(1), "id") == [10, 11]
    assert tuple(bundle.page_info(1).first()) == (2, "application/pdf") and bundle.page_image(1, 2).first()["url"] == "u2" and bundle.page_image(1, 3).first()["url"] is None
    assert bundle.text_preview(1).first()[0] == "raw iron text" and bundle.text_preview(9).count() == 0
    assert sorted(ids(bundle.file_tags(), "tag")) == ["a", "b"] and sorted(ids(bundle.marker_tags(), "tag")) == ["t", "u"] and len(ids(bundle.marker_names(), "marker")) == 3
    assert ids(bundle.overview(), "marker") == ["Alpha", "Iron", "Zinc"] and ids(bundle.overview(["t", "u"]), "marker") == ["Alpha"]
    assert [tuple(x) for x in bundle.detail("Iron").first()["history"]] == [("2023-01-01", 12, 6.0), ("2024-01-01", 11, 5.0)] and bundle.detail("none").count() == 0
    assert len(bundle.sparkline("Iron").first()["sparkline"]) == 2


def test_lists_are_pruned_and_filters_pushed(bundle):
    plan = bundle._read("files").where("file_id = 1").select("measurements.id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file_id,1)" in plan and "measurements:array<struct<id:bigint>>" in plan


def test_search(bundle):
    got = bundle.search("iron").collect()
    assert [(r["file_id"], r["score"]) for r in got] == [(2, 8), (1, 7)] and got[0]["marker_names"] == ["Iron"] and got[0]["tag_list"] == ["a"]
    assert [tuple(s) for s in got[1]["snippets"]] == [("measurements", "Zinc 1\nIron 5 mg"), ("raw", "raw iron text")]
    assert got[0]["snippets"][1]["text"].endswith("x …") and ids(bundle.search("iron blood")) == [1] and ids(bundle.search("iron", ["b"])) == [1] and bundle.search(" ").count() == 0


def test_small_texts(spark):
    one = spark.range(1)
    pair = lambda a, b: F.struct(F.lit(a).alias("done"), F.lit(b).alias("total"))
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(D.progress_summary(pair(1, 2), pair(0, 2), pair(3, 4))) == "Measurements 1/2p · Text 0/2p · Ready markers 3/4"
    assert [get(D.conversion_warning(F.lit(m), F.lit(u))) for m, u in ((True, "mg"), (True, "1"), (True, None), (False, "mg"), (None, "mg"))] == ["No conversion rule for mg", "No conversion rule", "No conversion rule", None, None]
    names = lambda *n: F.array(*map(F.lit, n))
    assert get(D.marker_names(names(" b ", "a", "", "b"))) == ["b", "a"]
    assert get(D.export_name(names("Iron total"))) == "iron-total-history" and get(D.export_name(names("A", "B", "C", "D"))) == "a-b-c-4-markers-history"
    assert get(D.export_path(names(" "))) == "/exports" and get(D.export_path(names("A b", "ü", "A b"))) == "/exports?marker=A+b&marker=%C3%BC"
    line = lambda *x: get(D.prompt_line(*[F.lit(v).cast("string") for v in x]))
    assert line("Iron", "5", None, "mg", "1", "6") == "- **Iron**: 5 mg (ref 1–6)" and line("X", "5", "negative", None, None, "6") == "- **X**: negative"


def test_payload_and_statuses(spark):
    files = spark.createDataFrame([(1, "2024-01-01", "Lab"), (2, None, None)], "file_id long, lab_date string, source_name string")
    rows = [(1, 2, "Iron", "resolved", None, 'nega"tive', "mg", None, 6.0, None, 3), (1, 1, "Zinc", "resolved", 5.0, "x", None, None, None, "2024-01-01", None), (1, 3, "No", "pending", 1.0, None, None, None, None, None, None)]
    m = spark.createDataFrame(rows, "file_id long, id long, marker_name string, normalization_status string, original_value double, qualitative_value string, original_unit string, original_reference_low double, original_reference_high double, measured_at string, page_number int")
    got = {r["file_id"]: json.loads(r["payload"]) for r in D.medical_payload(files, m).collect()}
    result = lambda n, v, u, hi, at, page: {"marker_name": n, "value": v, "unit": u, "reference_low": None, "reference_high": hi, "measured_at": at, "page_number": page}
    assert got == {1: {"lab_date": "2024-01-01", "source": "Lab", "measurements": [result("Zinc", 5.0, None, None, "2024-01-01", None), result("Iron", 'nega"tive', "mg", 6.0, None, 3)]}, 2: {"lab_date": None, "source": None, "measurements": []}}
    keys = spark.createDataFrame([("a",), ("a",), ("",), ("c",), (None,)], "task_key string")
    jobs = spark.createDataFrame([("t", "a", "done"), ("u", "c", "failed"), ("t", "b", "pending")], "task_type string, task_key string, status string")
    assert [tuple(r) for r in D.job_statuses(keys, jobs, "t").collect()] == [("a", "done")]
    groups = spark.createDataFrame([(["a", "b"],), (["c"],)], "markers array<string>")
    assert D.marker_count(groups).first()[0] == 3 and D.marker_count(groups.where("false")).first()[0] == 0
