"""Sets of word shingles: what near-duplicate documents are decided by.

Two texts are linked if the sets of their WIDTH-word shingles have a Jaccard similarity of
LEAST / OUT_OF or more. Texts of equal sets become one class, named by a hash of the set.

Candidates: besides the links that a caller brings, classes that share a band, a hash of ROWS
minima of the set under random hashes. Two sets of a similarity s share one of BANDS bands
with a probability of 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, 0.99999 at 0.85.

Comparison: first each class meets one leader of a few of its bands, then leaders of all bands,
members of a band's largest component, and confirmed pairs become components, while the pairs
are many and a turn halves them; that settles large groups of copies in linear work. Then all pairs that share a band
and are not yet in one component are compared: what is outside a band's largest component
meets the band. Sketches rule pairs out before any set is moved: bit i is the parity of the
number of members in bucket i, so that two sketches differ in no more bits than their sets in
members. Every pair left is decided by the whole sets.

Defined cases: fewer than WIDTH words make one shingle; null and empty text have the
empty set, and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from titerloom.llm.common import bounded_broadcast, materialize, releasing, text_hash
from titerloom.llm.graph import components

WIDTH = 5
LEAST, OUT_OF = 4, 5
BANDS, ROWS = 20, 5
#: Bits in which fingerprints of similar sets may differ: similar sets of the least similarity
#: differ in 9.7 of 64 bits, with a standard deviation of 2.9; strangers in 32.
FAR = 24
#: Longs of a sketch.
SKETCH = 4
#: What a class is compared by before its set is.
OF = ("n", "fp", *(f"p{i}" for i in range(SKETCH)))
#: Bands whose leaders are met first.
FIRST_BANDS = 3
#: Rows of some 80 bytes that are broadcast.
MAX_BROADCAST = 100_000
#: Bytes of the sets that are broadcast at once.
SET_BYTES = 16 << 20
#: Leaders met before all pairs that are left, while those are many.
TURNS = 8
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    import xxhash

    digest, words = xxhash.xxh64_intdigest, (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < width:
        return np.array([digest(b" ".join(words), width)], np.uint64).view(np.int64)
    w = np.array([digest(x, 42) for x in words], np.uint64)
    h = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def set_name(s: np.ndarray) -> np.int64:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 7)], np.uint64).view(np.int64)[0]


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key a band; the empty set has none, as its copies share a class."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (s[at : at + 4096].view(np.uint64)[:, None] * _MULTIPLIERS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for minimum in least.reshape(BANDS, ROWS).T:
        key = (key ^ minimum) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of the members' numbers by bucket, as SKETCH longs."""
    odd = np.bincount((s.view(np.uint64) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from releasing(lambda batches: (pd.Series([shingles(t) for t in batch], dtype=object) for batch in batches))(texts)


def _enough(overlap: Column, n: Column, m: Column) -> Column:
    return overlap * (LEAST + OUT_OF) >= (n + m) * LEAST


def _can_be() -> Column:
    """Whether the sets of x and y, by size, fingerprint and sketch, may be similar."""
    sizes = F.least("x.n", "y.n") * OUT_OF >= F.greatest("x.n", "y.n") * LEAST
    differing = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    parities = sum((differing(f"p{i}") for i in range(SKETCH)), F.lit(0))
    return sizes & (differing("fp") <= FAR) & (parities * (OUT_OF + LEAST) <= (F.col("x.n") + F.col("y.n")) * (OUT_OF - LEAST))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs u, v of names of sets, those that are similar. u may be the leader of very many."""
    leaders = sets.join(pairs.select(F.col("u").alias("skey")).distinct(), "skey", "left_semi")
    size = leaders.agg(F.sum(F.size("s") * 8)).first()[0] or 0
    of = [(leaders if k == "u" else sets).select(F.col("skey").alias(k), F.col("s").alias(f"s_{k}")) for k in ("u", "v")]
    both = pairs.join(of[1], "v").join(F.broadcast(of[0]) if size <= SET_BYTES else of[0], "u")
    return materialize(both.where(_enough(F.size(F.array_intersect("s_u", "s_v")), F.size("s_u"), F.size("s_v"))).select("u", "v"), "confirmed")


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, held: list[DataFrame]) -> DataFrame:
    """skey, s of the classes in pairs u, v and others; held: what was read so far, which is added to."""
    asked = pairs.select(F.col("u").alias("skey")).union(pairs.select("v")).distinct()
    for sets in held:
        asked = asked.join(sets, "skey", "left_anti")
    named = materialize(classes.join(asked, "skey", "left_semi").select("skey", "thash"), "asked")
    if not held or not named.isEmpty():
        texts = docs.select("text", text_hash().alias("thash")).join(bounded_broadcast(named, MAX_BROADCAST), "thash")
        held.append(materialize(texts.dropDuplicates(["skey"]).select("skey", _sets("text").alias("s")), "sets"))
    return reduce(DataFrame.union, held)


def set_links(docs: DataFrame, classes: DataFrame, first: DataFrame) -> DataFrame:
    """classes: skey, thash (of one text), bands and the columns OF; first: links u, v to begin
    with. Returns node, root over the names of sets."""
    held: list[DataFrame] = []
    tried = materialize(first, "first-links")
    edges = confirmed(tried, _sets_of(docs, classes, tried, held))
    most, before = BANDS * classes.count(), None
    for turn in range(TURNS + 2):
        root = components(edges)
        bands = F.slice("bands", 1, FIRST_BANDS) if turn == 0 else F.col("bands")
        # One row a class meets its root; only what lies in a band of several roots is paired.
        now = classes.join(root, classes["skey"] == root["node"], "left").select("skey", *OF, bands.alias("bands"), F.coalesce("root", "skey").alias("root"))
        rows = now.select(F.explode("bands").alias("key"), "skey", *OF, "root")
        kinds = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.min_by("skey", F.xxhash64("skey", F.lit(turn))).alias("lead"))
        sizes = kinds.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root", "lead")).alias("top"))
        open_ = materialize(sizes.where("roots > 1").select("key", "all", "own", F.col("top.root").alias("top"), "top.lead"), "open-bands")
        left = open_.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()[0]
        if turn and not left:
            return root
        last = turn > TURNS or turn and (left <= most or before is not None and 2 * left > before)
        if last:
            few = rows.join(bounded_broadcast(open_.select("key", "top"), MAX_BROADCAST), "key").where("root <> top")
            once = (F.col("y.root") == F.col("x.top")) | (F.col("x.skey") < F.col("y.skey"))
        else:
            few, once = open_.select("key", F.col("lead").alias("skey")).join(now.drop("bands"), "skey"), F.lit(True)
        few = bounded_broadcast(materialize(few, "few"), MAX_BROADCAST)
        pairs = few.alias("x").join(rows.alias("y"), "key").where((F.col("x.root") != F.col("y.root")) & _can_be() & once).select(F.col("x.skey").alias("u"), F.col("y.skey").alias("v")).distinct()
        pairs = materialize(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        # What is linked stays linked to its root, so that each turn begins where the last ended.
        edges = root.select(F.col("node").alias("u"), F.col("root").alias("v")).union(confirmed(pairs, _sets_of(docs, classes, pairs, held)))
        before, tried = left if turn else None, tried.union(pairs)
        if last:
            return components(edges)
