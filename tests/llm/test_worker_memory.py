"""What a worker holds: little of a task's rows at once, and nothing of other operators."""

import pandas as pd
import pytest

from titerloom.llm import bpe, token_records, toxicity
from titerloom.llm.common import releasing
from titerloom.llm.queries import tokenizer_path

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_worker_keeps_an_encoder_for_encoding_only():
    bpe.encoder(tokenizer_path())
    assert list(releasing(iter, bpe.encoder)(iter([1]))) == [1]
    assert bpe.encoder.cache_info().currsize == 1
    assert list(releasing(iter)(iter([1]))) == [1]
    assert bpe.encoder.cache_info().currsize == 0
    bpe.encoder(tokenizer_path())
    assert list(releasing(iter, token_records.encoder)(iter([1]))) == [1]
    assert bpe.encoder.cache_info().currsize == 0


@pytest.mark.parametrize("operator", ["bpe", "toxicity"])
def test_long_texts_come_to_workers_in_small_batches(spark, operator):
    from pyspark.sql import functions as F

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    spark.conf.unset(SETTING)
    docs = spark.range(12).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    if operator == "bpe":
        bpe.encode_digests(docs, tokenizer_path())
    else:
        toxicity.score_toxicity(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(False))
    most = docs.select(together("text").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert most[1] == 12 and most[0] <= 4_000_000  # whole texts of 1 MB, of which 2 MB begin no third or fourth


def test_a_sessions_own_batch_size_stays(spark):
    spark.conf.set(SETTING, "5m")
    try:
        bpe.encode_digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path())
        assert spark.conf.get(SETTING) == "5m"
    finally:
        spark.conf.unset(SETTING)
