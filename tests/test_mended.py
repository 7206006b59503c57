"""Values that are stated by hand."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from titerloom.functions import dates as D
from titerloom.functions import keys as K
from titerloom.operators import display, reports
from titerloom.sources import files


def values(spark, f, xs, kind="string"):
    return [r["y"] for r in spark.createDataFrame([(x,) for x in xs], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_log_durations(spark):
    want = {450.0: "450ms", 0.4: "0ms", 999.6: "1000ms", 2340.0: "2.34s", 9999.0: "10.00s", 12_340.0: "12.3s", 60_000.0: "1m 0s", 65_400.0: "1m 5s", 3_599_600.0: "1h 0m", 7_260_000.0: "2h 1m", math.inf: "—", math.nan: "—", None: "—"}
    assert values(spark, D.log_duration, list(want), "double") == list(want.values())


def test_first_object(spark):
    want = {
        '{"a":1} and }': '{"a":1}', '{"a":1} {"b":2}': '{"a":1}', 'say {"a": {"b": "}"}, "c": "{"} there }': '{"a": {"b": "}"}, "c": "{"}', '{"a": "\\\\"} }': '{"a": "\\\\"}', '{"a": "\\"}"} x': '{"a": "\\"}"}',
        "none": None, "} {": None, '{"a": 1': None, '```json\n{"a": {"b": 1}}\n``` done': '{"a": {"b": 1}}', '```json\n{"a":1}\n```': '{"a":1}', ' [1, 2] ': "[1, 2]", 'it said "{" and {"x": 2}!': None,
        "": None, "``` {}": "{}", '{"a": "' + "y" * 50_000 + '\\n"} {': '{"a": "' + "y" * 50_000 + '\\n"}',
    }
    assert values(spark, display.json_object, list(want)) == list(want.values())


def test_folding_covers_all_decompositions(spark):
    odd = ["㎎/㎗", "①②", "ʰ", "𝟓𝐀", "ﬁne Ǆ", "Ångström", "Москва", "½", "ﷺ", "⑴", "naïve ÀÉ", "áb", "中文x", "Å", ""]
    assert values(spark, K.to_ascii, odd) == [unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in odd]


def test_preload_kinds(spark):
    want = {"a.JPE": "image/jpeg", "b.markdown": "text/markdown", "c.pdf": "application/pdf", "d.doc": None, "e": None, "f.bat": "text/plain", "g.txt.gz": "text/plain", "h.tar": None}
    assert values(spark, files.preload_kind, list(want)) == list(want.values())


def brute_axis(lo, hi, marks):
    """Step by step, as one would by hand."""
    digits = lambda x: 0 if x == math.floor(x) else len(re.sub(r"^[^.]*\.?", "", repr(x).split("e")[0])) - int((repr(x).split("e") + ["0"])[1])
    near = lambda x, p: math.floor(x * 10.0**p + 0.5) / 10.0**p
    if lo == hi:
        pad = 1.0 if lo == 0 else abs(lo) * 0.2
        lo, hi = lo - pad, hi + pad
    best = None
    steps = set()
    for n in range(4, 9):
        raw = (hi - lo) / (n - 1)
        power = math.pow(10.0, math.floor(math.log10(raw)))
        steps.add(next((s for s in (1.0, 2.0, 2.5, 5.0, 10.0) if raw / power <= s), 10.0) * power)
    for step in sorted(steps):
        p = digits(step) + 6
        a, b = near(math.floor(lo / step) * step, p), near(math.ceil(hi / step) * step, p)
        ticks = [near(a + step * k, p) for k in range(max(2, math.floor((b - a) / step + 0.5) + 1))]
        gap = ticks[1] - ticks[0]
        tolerance = max(gap * 0.05, math.pow(10.0, -(digits(gap) + 2)))
        missed = sum(all(abs(t - m) > tolerance for t in ticks) for m in marks)
        score = missed * 3 + 4 * max(0, len(ticks) - 8) + 4 * max(0, 4 - len(ticks)) + abs(len(ticks) - 6) + max(0, ticks[-1] - ticks[0] - (hi - lo)) / (hi - lo) + digits(gap) * 0.25
        if best is None or score < best[0]:
            best = score, ticks
    return best[1]


def test_axes(spark):
    import random

    r = random.Random(1)
    rows = [(5.0, 5.0, []), (0.0, 0.0, [1.0]), (0.0, 100.0, [40.0]), (3.9, 6.1, [4.0, 5.6]), (-3.0, 7.0, []), (0.0012, 0.0093, [0.002])]
    rows += [(lo := round(r.uniform(-50, 50), r.randrange(4)), round(lo + r.choice([0.01, 0.5, 7, 300]) * r.random() + 0.001, 4), [round(r.uniform(-60, 60), 1) for _ in range(r.randrange(3))]) for _ in range(150)]
    frame = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, lo double, hi double, m array<double>")
    got = {x["k"]: x["t"] for x in frame.select("k", reports.nice_axis(F.col("lo"), F.col("hi"), F.col("m")).alias("t")).collect()}
    for k, x in enumerate(rows):
        assert got[k] == pytest.approx(brute_axis(*x), abs=1e-9), x
    none = spark.range(1).select(reports.nice_axis(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("t")).first()["t"]
    assert none == [0.0, 0.5, 1.0]


def test_explanations(spark):
    point = "struct<value double, text string, flag boolean, missing boolean>"
    rows = [
        ("A", (5.0, None, None, False), (4.0, None, None, False), (1.0, 4.5), "high"),
        ("B", (None, "negative", False, False), (None, "positive", True, False), (None, None), "negative"),
        ("C", (None, "trace", None, False), None, (None, None), "no_range"),
        ("D", (None, None, None, False), (1.0, None, None, False), (None, 2.0), "no_range"),
    ]
    frame = spark.createDataFrame(rows, f"marker string, latest {point}, previous {point}, range struct<low double, high double>, status string").withColumn("unit", F.when(F.col("marker") == "A", F.lit("mg/dL")))
    got = {r["marker"]: r["insight"].split("\n\n") for r in reports.insight_line(frame).collect()}
    e = reports.EXPLAINED
    assert got["A"] == ["## A", "Latest value: **5 mg/dL**. Status: **high**.", "Reference range from the report: **1 to 4.5 mg/dL**.", e["high"], "Compared with the previous result, the marker is **up** by **1 mg/dL**."]
    assert got["B"] == ["## B", "Latest result: **negative**.", e["negative"], "Compared with the previous result, it changed from **positive** to **negative**."]
    assert got["C"] == ["## C", "Latest result: **trace**.", e["qualitative"]]
    assert got["D"] == ["## D", "Latest value: **unavailable**. Status: **no range**."]
