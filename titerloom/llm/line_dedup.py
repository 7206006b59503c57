"""Op 2: removal of lines that many distinct sites share.

Each line's 64-bit hash gets a HyperLogLog sketch of its sites; partial sketches
merge in the aggregation, so the most frequent line is one small row of each task.
Lines whose estimate is clear of MIN_SITES by the sketch's error band are decided
by it; the few near the threshold get an exact distinct count. Of a boilerplate
line the first occurrence (least doc_id, text hash, position) stays, every other
one is cut from its document.

Boilerplate hashes are broadcast up to BROADCAST_LINES and shuffled beyond; texts
meet their cut positions in one join, in which only touched documents have a row.

Defined cases: lines are compared after trimming ASCII white space; blank lines are never
removed; a null site is one site; null text stays null; a document may lose all
its lines (text ''); repeated rows keep or lose the same lines; extra columns
stay, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import bounded_broadcast, join_rows, materialize, text_hash

MIN_SITES = 10
#: log2 of the sketch's registers; its relative error is 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 12
BROADCAST_LINES = 1_000_000


def line_key(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, thash, site, pos, line (hash) of the lines that aren't blank."""
    rows = docs.select("doc_id", text_hash().alias("thash"), F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"), F.split("text", "\n").alias("lines"))
    each = rows.select("doc_id", "thash", "site", F.posexplode("lines").alias("pos", "text"))
    return each.where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).select("doc_id", "thash", "site", "pos", line_key(F.col("text")).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines on min_sites distinct sites or more."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sites"), F.count(F.lit(1)).alias("n"))
    # A line can't be on more sites than it has occurrences.
    counted = materialize(sketched.where(F.col("n") >= min_sites).select("line", F.hll_sketch_estimate("sites").alias("estimate")), "line-sites")
    band = max(1.0, 3 * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    sure = counted.where(F.col("estimate") > min_sites + band).select("line")
    near = counted.where(F.abs(F.col("estimate") - min_sites) <= band).select("line")
    pairs = lines.join(bounded_broadcast(near, BROADCAST_LINES), "line").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return materialize(sure.unionByName(exact), "boilerplate")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text less its boilerplate lines, n_lines (not blank, before) and n_removed."""
    lines = lines_of(docs, site)
    found = boilerplate(lines, min_sites)
    places = materialize(lines.join(bounded_broadcast(found, BROADCAST_LINES), "line").select("line", "doc_id", "thash", "pos").distinct(), "line-places")
    first = places.groupBy("line").agg(F.min(F.struct("doc_id", "thash", "pos")).alias("first"))
    spare = places.join(first, "line").where(~F.struct("doc_id", "thash", "pos").eqNullSafe(F.col("first")))
    cuts = spare.groupBy("doc_id", "thash").agg(F.collect_set("pos").alias("__cuts"))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "thash")]
    joined = join_rows(docs.select(*kept, text_hash().alias("thash")), cuts, "left").withColumn("__lines", F.split("text", "\n"))
    left = F.array_join(F.filter("__lines", lambda x, i: ~F.array_contains("__cuts", i)), "\n")
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(left)
    n_lines = F.size(F.filter("__lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in kept],
        F.coalesce(n_lines, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__cuts"), F.lit(0)).alias("n_removed"),
    )
