"""Training rows where one id, or none, holds much of the table."""

import collections

from pyspark.sql import functions as F

from titerloom.llm import langid, toxicity


def test_labelled_rows_of_one_id_are_bounded(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text"))
    one = spark.range(1500).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels = one.union(spark.range(1500, 3000).select(F.col("id").alias("doc_id"), F.lit(0)))
    none = F.lit(False)
    got = toxicity.training_rows(docs, labels, none, 400).collect()
    assert len(got) == 400 and 100 < sum(r["toxic"] for r in got) < 170
    every = toxicity.training_rows(docs, labels, none, 10_000).collect()
    assert len(every) == 1500 * 2 + 1500
    copies = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["toxic"] for r in toxicity.training_rows(copies, labels, none, 400).collect()) == [0, 1]


def test_rows_of_a_language_are_bounded(spark):
    rows = [(None, f"text {i}", "xx") for i in range(600)] + [(7, f"text {i}", "yy") for i in range(600)] + [(i, f"text {i}", "zz") for i in range(15)] + [(None, "same", "ww")] * 300
    got = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False), 40)
    assert collections.Counter(r["lang"] for r in got.collect()) == {"xx": 40, "yy": 40, "zz": 15, "ww": 1}
