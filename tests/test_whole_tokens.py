"""Tokens over all rows, where those of the plain name are held to a part of them by their SQL."""

import re

from titerloom.plans import registry


def test_tokens_of_whole_texts(spark, tmp_path):
    texts = {1: "One two\nthree, FOUR\n\nfive_5", 2: "", 3: None, 4: "\nÄ b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.QUERIES["text_tokens_whole"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        want = None if t is None else re.findall(r"\w+", t.lower())
        assert got[i]["tokens"] == want and got[i]["n"] == (None if want is None else len(want))
