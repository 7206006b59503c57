"""Op 5: weighted rendezvous hashing of record keys, built-in functions only.

Every (key, shard) pair gets a pseudo-random u in (0, 1) from md5; the shard with
the least -ln(u)/weight wins. A shard's score does not depend on the other
shards, so a key moves only when a new shard beats its old winner: one more
shard takes its fair part, into itself, and nothing else moves. The law that
holds is therefore ``key``.

Slots number each shard's rows from 0 without a gap. Rows are ordered by a
digest of (key, text checksum, size). The digest's leading digits cut a shard
into about sqrt(N) ranges: one pass counts ranges, a running sum over the counts
gives offsets, and rows are numbered inside their range only. Rows that agree in
everything are counted first and expanded last, so a key that holds a third of
the table costs one row until the end.

Defined cases: null doc_id is the key ''; null text has size 1 and checksum 0;
repeated rows get distinct slots; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX = 13  # 52 bits of the digest: exact in a double
CHUNK = 10_000  # repeated rows expanded by one output row of the first step


def shard_of(key: Column, weights: list[float]) -> Column:
    """The winning shard's index for a string key; shards are numbered from 0."""
    scores = []
    for shard, weight in enumerate(weights):
        digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double") + 0.5) / F.lit(float(16**HEX))
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def rendezvous_shards(docs: DataFrame, weights: list[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Copies first: few enough columns to aggregate on before anything is hashed.
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = distinct.select(
        "*",
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, new_weight]).alias("grown_shard"),
        F.md5(F.concat_ws("|", key, "text_crc32", "size").cast("binary")).alias("digest"),
    )
    digits = max(1, round(math.log(max(docs.count(), 1)) / 2 / math.log(16)))
    placed = placed.withColumn("range", F.substring("digest", 1, digits))
    counts = placed.groupBy("shard", "range").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("digest", F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("at", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["shard", "range"])
    chunks = first.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    return chunks.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("offset") + F.col("at") + F.col("chunk"), F.col("offset") + F.col("at") + F.least(F.col("chunk") + CHUNK, F.col("copies")) - 1)).alias("slot"),
        "grown_shard",
    )
