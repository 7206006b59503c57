"""Op 10: SimHash near-duplicates, compared bit-sliced.

Fingerprints: over the XXH64 of every 3-word shingle, a bit is 1 if set in over
half of them. Equal fingerprints become one class, and only classes are compared.

Candidates: the 64 bits are cut into blocks; two fingerprints within the radius
agree on all but ``radius`` blocks, so each class is dealt to one table per choice
of blocks that may agree. More classes get more blocks, so that a table's groups
stay small: any choice finds every link.

Comparison: a partition's groups stand as 64 bit planes, bit r of a plane being
row r's. Shifted by d rows and XORed, a plane gives one differing bit of 64 pairs
a machine word; carry-save counters add the planes up, and blocks of words in
which every pair has passed the radius are abandoned. A group emits links to one
root per connected part, never its pairs. Groups over HOT rows are cut into
chunks, and every two chunks meet in a task of their own.

Defined cases: null or empty text has fingerprint zero, which is linked like any
other; null doc_id never names a component unless all its ids are null; repeated
rows share a class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from titerloom.llm.common import materialize, releasing, small_batches, text_hash
from titerloom.llm.graph import components
from titerloom.llm.shingle_sets import OF, band_keys, set_links, set_name, shingles, sketch

RADIUS = 3
SHINGLE = 3
HOT = 8192
SLAB = 1 << 15  # rows compared at once, beside the last group's
BLOCK = 64  # words abandoned together
PART = 1 << 14  # shingles hashed at once


def bit_majority(parts: Iterable[np.ndarray]) -> int:
    """Of all hashes together, the bits set in over half, as an unsigned integer."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in parts:
        n += len(h)
        # Bit k of all eight bytes at once, each byte a counter of up to 255 rows.
        lanes = np.zeros((8, -(-len(h) // 255) * 255), np.uint64)
        lanes[:, : len(h)] = (h >> np.arange(8, dtype=np.uint64)[:, None]) & np.uint64(0x0101010101010101)
        counts += lanes.reshape(8, -1, 255).sum(2, dtype=np.uint64).view(np.uint8).reshape(8, -1, 8).sum(1, dtype=np.int64).T.ravel()
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """As an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return bit_majority(np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + PART], last[at : at + PART], strict=True)], np.uint64) for at in range(0, len(first), PART))


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from releasing(lambda batches: (pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64)) for batch in batches))(texts)


def bit_planes(fps: np.ndarray, words: int) -> np.ndarray:
    """64 planes of `words` 64-bit words; bit r of plane b is bit b of row r."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.zeros((64, words * 64), np.uint8)
    rows[:, : len(fps)] = bits.T
    return np.packbits(rows, axis=1, bitorder="little").view(np.uint64)


def near_at(planes: np.ndarray, d: int, asked: np.ndarray, radius: int) -> np.ndarray:
    """Rows r, among those asked (packed bits), that differ from row r + d in radius bits at most."""
    blocks = asked.reshape(-1, BLOCK)
    live = np.flatnonzero(blocks.any(axis=1))
    if not live.size:
        return live
    depth = radius.bit_length()
    over = ~blocks[live]
    sums = np.zeros((depth, *over.shape), np.uint64)
    whole, part = divmod(d, 64)
    reach = np.arange(BLOCK)
    at = live[:, None] * BLOCK + reach
    for b in range(64):
        plane = planes[b]
        moved = plane[at + whole] >> np.uint64(part)
        if part:
            moved |= plane[at + whole + 1] << np.uint64(64 - part)
        carry = plane[at] ^ moved
        for k in range(depth):
            sums[k], carry = sums[k] ^ carry, sums[k] & carry
        over |= carry
        if b % 8 == 7:
            alive = ~(over == ~np.uint64(0)).all(axis=1)
            if not alive.all():
                live, over, sums, at = live[alive], over[alive], sums[:, alive], at[alive]
                if not live.size:
                    return live
    # Of the counts that fit the counters, those above the radius go as well.
    more, same = np.zeros_like(over), ~np.zeros_like(over)
    for k in reversed(range(depth)):
        if not radius >> k & 1:
            more |= same & sums[k]
            same &= ~sums[k]
        else:
            same &= sums[k]
    bits = np.unpackbits((~(over | more)).view(np.uint8), bitorder="little").reshape(live.size, -1)
    row, bit = np.nonzero(bits)
    return live[row] * BLOCK * 64 + bit


def links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key. Returns rows and the roots of their connected part in the group."""
    n = len(keys)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    end = np.repeat(np.concatenate((start[1:], [n])), np.diff(np.concatenate((start, [n]))))
    left = end - np.arange(n) - 1  # rows after this one in its group
    words = (n // (64 * BLOCK) + 1) * BLOCK
    planes = bit_planes(fps, words + (int(left.max(initial=0)) // 64 + 2))
    root = np.arange(n)
    for d in range(1, int(left.max(initial=0)) + 1):
        asked = np.zeros(words * 64, np.uint8)
        asked[:n] = left >= d
        found = near_at(planes, d, np.packbits(asked, bitorder="little").view(np.uint64), radius)
        for r in found[root[found] != root[found + d]].tolist():
            a, b = r, r + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while not np.array_equal(up := root[root], root):
            root = up
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _link_groups(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            row, root = links(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(f[row].view(np.int64)), pa.array(f[root].view(np.int64))], ["u", "v"])

        for batch in batches:
            held_k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
            held_f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(held_k) >= SLAB and held_k[0] != held_k[-1]:
                cut = int(np.flatnonzero(held_k != held_k[-1])[-1]) + 1
                yield linked(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k):
            yield linked(held_k, held_f)

    return releasing(run)


def table_keys(fp: Column, classes: int, radius: int) -> Column:
    """One key a table. More classes take more blocks, each key then covering more bits."""
    blocks = radius + 1 if classes < 1 << 22 else radius + 2 if classes < 1 << 30 else radius + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(table), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """classes: fp, distinct. Returns u, v: enough links for the connected parts."""
    n = classes.count()
    dealt = classes.select("fp", F.explode(table_keys(F.col("fp"), n, radius)).alias("key"))
    large = materialize(dealt.groupBy("key").count().where(F.col("count") > hot).select(F.col("key"), F.ceil(F.col("count") * 2 / hot).cast("int").alias("chunks")), "hot-keys")
    if large.limit(1).count():
        cut = dealt.join(large, "key", "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
        pairs = cut.select("fp", "key", "chunks", "chunk", others.alias("other"))
        dealt = pairs.select("fp", F.when(F.col("chunks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))).alias("key"))
    spread = dealt.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return spread.mapInArrow(_link_groups(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, thash, fp (signed), root (a fp that names the component) and component_id for every row of docs."""
    rows = materialize(docs.select("doc_id", text_hash().alias("thash"), _fingerprints("text").alias("fp")), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    root = components(fingerprint_links(classes.select("fp"), radius))
    member = classes.join(root, classes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(member.select("fp", "root"), "fp").join(named, "root").select("doc_id", "thash", "fp", "root", "component_id")


def _signed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = [(set_name(s), len(s), np.uint64(bit_majority([s.view(np.uint64)])).view(np.int64), *sketch(s), band_keys(s)) for s in map(shingles, batch)]
        yield pd.DataFrame(rows, columns=SIGNATURE.names)


SIGNATURE = StructType().add("skey", LongType())
for column in OF:
    SIGNATURE.add(column, IntegerType() if column == "n" else LongType())
SIGNATURE.add("bands", ArrayType(LongType()))


@F.pandas_udf(SIGNATURE)
def _signatures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A text's shingle set: its name, size, fingerprint and bands."""
    yield from releasing(_signed)(texts)


def similar_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, thash, root for every row of docs: root names the component of texts linked by
    a 5-word Jaccard similarity of 0.8 or more. Links of fingerprints within the radius come
    first; as similar sets lie up to FAR bits apart, bands find the others, and the whole
    sets decide on each (shingle_sets)."""
    small_batches(docs.sparkSession)
    rows = materialize(docs.select("doc_id", text_hash().alias("thash"), _signatures("text").alias("s")).select("doc_id", "thash", "s.*"), "signatures")
    classes = materialize(rows.groupBy("skey").agg(F.min(F.struct("thash", *OF, "bands")).alias("c")).select("skey", "c.*"), "set-classes")
    named = materialize(classes.groupBy("fp").agg(F.min("skey").alias("name")), "named-fingerprints")
    near = fingerprint_links(named.select("fp"), radius)
    u, v = (named.select(F.col("fp").alias(k), F.col("name").alias(f"name_{k}")) for k in "uv")
    links = near.join(u, "u").join(v, "v").select(F.col("name_u").alias("u"), F.col("name_v").alias("v"))
    same = classes.join(named, "fp").where("skey <> name").select(F.col("name").alias("u"), F.col("skey").alias("v"))
    root = set_links(docs, classes, links.union(same).distinct())
    return rows.join(root, rows["skey"] == root["node"], "left").select("doc_id", "thash", F.coalesce("root", "skey").alias("root"))


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
