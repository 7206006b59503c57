"""Search over documents: postings with prefix match and BM25, and the weighted substring search.

Documents: doc_id and text columns. The postings of a query come from one pass that keeps only
tokens that begin with a query token, so a search shuffles a few rows for each document hit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.operators import fulltext

#: Weights of the indexed columns, and of the offline search's fields.
COLUMN_WEIGHTS = {"filename": 1.0, "tags": 2.2, "summary": 3.4, "raw": 1.2, "translated": 1.8, "measurements": 2.5}
FIELD_WEIGHTS = {"filename": 6, "measurements": 5, "tags": 4, "translated": 3, "raw": 2}
K1, B = 1.2, 0.75


def build_documents(files: DataFrame, tags: DataFrame, measurements: DataFrame) -> DataFrame:
    """The index's rows: complete files only. files: file_id, filename, status, summary, raw, translated.
    tags: file_id, tag. measurements: file_id, id, status, name (null: untyped), value_text."""
    t = tags.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), " ").alias("tags"))
    m = measurements.where((F.col("status") == "resolved") & F.col("name").isNotNull())
    lines = m.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat_ws(" ", "name", "value_text").alias("line")))), lambda s: s["line"]), "\n").alias("measurements"))
    d = files.where("status = 'complete'").join(t, "file_id", "left").join(lines, "file_id", "left")
    return d.select(F.col("file_id").alias("doc_id"), *[K.search_text(F.col(c)).alias(c) for c in COLUMN_WEIGHTS])


def stale(complete: Column, indexed_at: Column, *changed: Column) -> Column:
    return complete & (indexed_at.isNull() | F.coalesce(F.greatest(*changed) > indexed_at, F.lit(False)))


def bm25(documents: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """doc_id, score of the documents in which every query token begins a word of some column;
    the smaller the better. A token's frequency is the weighted number of its hits."""
    tokens = fulltext.asked(query)
    if not tokens:
        return documents.select("doc_id").where(F.lit(False)).withColumn("score", F.lit(0.0))
    cols = list(weights)
    split = documents.select("doc_id", *[fulltext.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols])

    def hits(c: str, token: str) -> Column:
        starts = (lambda x: F.startswith(x, F.lit(token))) if len(token) >= 2 else (lambda x: x == token)
        return F.size(F.filter(c, starts)) * F.lit(weights[c])

    counted = split.select("doc_id", sum((F.size(c) for c in cols), F.lit(0)).alias("len"), *[sum((hits(c, t) for c in cols), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(tokens)])
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(tokens))]).first()
    j = counted.where(" and ".join(f"tf{i} > 0" for i in range(len(tokens))))
    score = F.lit(0.0)
    for i in range(len(tokens)):
        idf = max(math.log((totals["n"] - totals[f"n{i}"] + 0.5) / (totals[f"n{i}"] + 0.5)), 1e-6)
        tf = F.col(f"tf{i}")
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (totals["avg"] or 1.0)))
    return j.select("doc_id", score.alias("score"))


def top(scored: DataFrame, documents: DataFrame, limit: int = 25) -> DataFrame:
    """Best first; of equals the newest upload. The limit lies between 1 and 100."""
    n = max(1, min(100, limit))
    return scored.join(documents.select("doc_id", "uploaded_at"), "doc_id").orderBy("score", F.desc("uploaded_at"), "doc_id").limit(n)


def token_snippet(x: Column, tokens: list[str], words: int = 20) -> Column:
    """A run of words from the first hit on, or from the start; marks where the text goes on."""
    parts = F.split(x, " ")
    at = F.array_position(F.transform(parts, lambda w: F.exists(F.array(*map(F.lit, tokens)), lambda t: F.startswith(F.lower(w), t))), F.lit(True))
    start = F.greatest(at, F.lit(1))
    body = F.array_join(F.slice(parts, start.cast("int"), words), " ")
    return F.concat(F.when(start > 1, F.lit(" … ")).otherwise(""), body, F.when(start + words - 1 < F.size(parts), F.lit(" … ")).otherwise(""))


def offline(documents: DataFrame, query: str, weights: dict[str, int] | None = None) -> DataFrame:
    """Documents whose text holds every query token somewhere; score: the weights of the fields
    that hold each token, added up; the greater the better."""
    weights = weights or FIELD_WEIGHTS
    tokens = list(dict.fromkeys(K.query_tokens(query)))
    lows = documents.select("*", *[F.lower(F.coalesce(c, F.lit(""))).alias(f"__{c}") for c in weights])
    if not tokens:
        return documents.where(F.lit(False)).withColumn("score", F.lit(0))
    has = lambda c, t: F.contains(F.col(f"__{c}"), F.lit(t))
    every = None
    for t in tokens:
        some = None
        for c in weights:
            some = has(c, t) if some is None else some | has(c, t)
        every = some if every is None else every & some
    score = sum((F.when(has(c, t), w).otherwise(0) for t in tokens for c, w in weights.items()), F.lit(0))
    return lows.where(every).withColumn("score", score).select(*documents.columns, "score")
