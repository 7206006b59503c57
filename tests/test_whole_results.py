"""Report rows and statuses over all rows, by either name."""

import pytest

from titerloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("report_rows", "threshold_status"))
def test_no_row_is_left_out(spark, name):
    part, whole = (registry.QUERIES[n](spark, DATA) for n in (name, f"{name}_whole"))
    cols = part.columns
    a, b = ([tuple(r) for r in df.select(*cols).collect()] for df in (part, whole))
    assert len(a) == len(b) and set(a) == set(b)


def test_rows_with_a_number(spark):
    q = lambda name: registry.QUERIES[f"{name}_whole"](spark, DATA)
    events = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert q("report_rows").count() == q("threshold_status").count() == events
    numeric = q("threshold_status").where("id % 11 != 0")
    assert {"low", "high", "in_range"} <= {r["status"] for r in numeric.select("status").distinct().collect()}
