"""The index in files: folding, prefixes, freshness, snippets."""

import tempfile

import pytest
from pyspark.sql import functions as F

from titerloom.operators import fulltext as T
from titerloom.operators import search

DOCS = "doc_id long, filename string, raw string"


@pytest.fixture
def index(spark):
    docs = spark.createDataFrame([(1, "Über.pdf", "Das Blutbild über alles, überall"), (2, "b.pdf", "Москва река"), (3, "c_d.pdf", "uber " + "x " * 40 + "Ferritin und Überblick y " + "z " * 40), (4, None, None)], DOCS)
    out = T.Index(spark, "file://" + tempfile.mkdtemp(prefix="spark-") + "/i", ["filename", "raw"])
    assert out.version() == 0
    out.build(docs)
    return out, docs


def found(index, query, **more):
    return sorted(r["doc_id"] for r in index.search(query, {"filename": 1.0, "raw": 1.2}, **more).collect())


def test_folded_words(spark):
    texts = ["Éà_ñ ǺB", "МОСКВА Йод", "Ελλάδα", "áb 12ab", "中文 x", None]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(T.tokens(F.col("x")).alias("t")).collect()]
    assert got == [["ea", "n", "ab"], ["москва", "йод"], ["ελλάδα"], ["ab", "12ab"], ["中文", "x"], None]
    assert T.asked("Über a_b ÜBER") == ["uber", "a", "b"]


def test_search(index):
    i, _ = index
    assert found(i, "uber") == [1, 3] and found(i, "Über ferr") == [3] and found(i, "моск") == [2] and found(i, "река МОСКВА") == [2]
    assert found(i, "d") == [3] and found(i, "u") == [] and found(i, "nothing") == [] and found(i, "--") == []
    assert found(i, "uber", allowed=index[1].where("doc_id = 1")) == [1]
    plain = {r["doc_id"]: r["score"] for r in search.bm25(index[1], "uber", {"filename": 1.0, "raw": 1.2}).collect()}
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in i.search("uber", {"filename": 1.0, "raw": 1.2}).collect()} == plain


def test_refresh(spark, index):
    i, _ = index
    i.refresh(spark.createDataFrame([(1, "neu.pdf", "ganz anders"), (9, "n.pdf", "über neu")], DOCS), spark.createDataFrame([(2,)], "doc_id long"))
    assert i.version() == 2 and found(i, "uber") == [3, 9] and found(i, "neu") == [1, 9] and found(i, "моск") == [] and i.lengths().count() == 4


def test_snippets_and_decoration(spark, index):
    i, docs = index
    files = docs.withColumn("uploaded_at", F.lit("2024-01-01").cast("timestamp"))
    tags = spark.createDataFrame([(3, "b"), (3, "a")], "doc_id long, tag string")
    values = spark.createDataFrame([(3, "resolved", "Zinc"), (3, "resolved", "Iron"), (3, "resolved", "Iron"), (3, "pending", "No")], "doc_id long, status string, name string")
    got = {r["doc_id"]: r for r in T.decorated(i.search("uber ferr", {"filename": 1.0, "raw": 1.2}), files, tags, values, ["filename", "raw"]).collect()}
    assert list(got) == [3] and got[3]["tag_list"] == ["a", "b"] and got[3]["marker_names"] == ["Iron", "Zinc"]
    assert got[3]["raw_snippet"] == " … " + "x " * 8 + "Ferritin und Überblick y " + ("z " * 8).strip() + " … "
    assert got[3]["filename_snippet"] == "c_d.pdf"
    one = {r["doc_id"]: r for r in T.decorated(i.search("uber", {"filename": 1.0, "raw": 1.2}), files, tags, values, ["filename", "raw"]).collect()}
    assert one[1]["raw_snippet"] == "Das Blutbild über alles, überall" and one[1]["marker_names"] == [] and one[1]["filename_snippet"] == "Über.pdf"


def _folded_one_by_one(x):
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(T.WORD), F.lit(0)), T.fold), lambda t: t != "")


def test_whole_texts_fold_as_words_do(spark):
    texts = ["ΟΔΟΣ.α ΟΔΟΣ α ΣΑΣ", "áb ́ x-́y ́̂", "İstanbul ǅ Ⓐ Ⅻ ﬁ K x", "Ab9_c\x00D ß", "", None, "naïvé Ñ̃ 12́3"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(T.tokens(F.col("x")).alias("a"), _folded_one_by_one(F.col("x")).alias("b"), T.n_tokens(F.col("x")).alias("n"))
    for r in df.collect():
        assert r["a"] == r["b"] and r["n"] == (None if r["b"] is None else len(r["b"]))


def test_refresh_writes_what_changed(spark, index, monkeypatch):
    i, _ = index
    monkeypatch.setattr(T, "MAX_VERSIONS", 3)
    for k in range(2, 7):
        i.refresh(spark.createDataFrame([(1, f"n{k}.pdf", "über neu"), (k + 100, None, "über")], DOCS), spark.createDataFrame([(k + 99,)], "doc_id long"))
        rows = spark.read.parquet(f"{i.path}/{k}/postings").count()
        # Five tokens changed; at the limit of versions all that hold are written: those of documents 2 and 3, too.
        assert rows == 5 if k < 4 else rows >= 5, (k, rows)
        assert found(i, "uber") == [1, 3, k + 100] and found(i, "моск") == [2] and found(i, "blutbild") == [] and found(i, f"n{k}") == [1]
        assert i.postings().where("doc_id = 1").count() == 4
        assert len({r["since"] for r in i._sizes().collect()}) <= 4
