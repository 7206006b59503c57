"""Keys, ladder and guides over all rows, by either name."""

import pytest

from titerloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("alias_key", "c1_ladder", "guide_top3"))
def test_no_row_is_left_out(spark, name):
    part, whole = (registry.QUERIES[n](spark, DATA) for n in (name, f"{name}_whole"))
    cols = part.columns
    a, b = ([tuple(r) for r in df.select(*cols).collect()] for df in (part, whole))
    assert len(a) == len(b) and set(a) == set(b)


def test_open_thresholds_and_guides(spark):
    q = lambda name: registry.QUERIES[f"{name}_whole"](spark, DATA)
    assert q("c1_ladder").count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert q("c1_ladder").where("word = 'in_range' and not flag").count() > 0
    assert q("guide_top3").where("type_id % 10 != 0").count() > 0 and q("guide_top3").where("guide_type % 3 = 0").count() > 0


def test_keys_of_lines_with_a_plus(spark, tmp_path):
    spark.createDataFrame([(1, "+1 (555) 01\na+b - c"), (2, "T-Cell [x]")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line"]): r["key"] for r in registry.QUERIES["alias_key_whole"](spark, str(tmp_path)).collect()}
    assert got == {(1, "+1 (555) 01"): "1 555 01", (1, "a+b - c"): "ab c", (2, "T-Cell [x]"): "t cell x"}
