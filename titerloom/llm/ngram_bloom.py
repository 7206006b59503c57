"""Op 9: language-model scores from a log-frequency Bloom filter.

Counting: each partition sorts and counts 64-bit hashes of its words and word pairs
and sends them by hash range as delta-coded blocks; each range is merged in a task
of its own. A frequent word is one entry of each partition, so no range is hot.
Words keep exact counts. A pair's count c becomes its level 1 + floor(log2 c), and
the pair enters its range's Bloom filter once for each level up to its own.

Scoring: a pair's count is read back by probing levels 1, 2, ... until one is
missing, and stands for the least count of its level, so that the shares of all
followers of a word add up to 1 at most. With N training tokens of V kinds,
P(w | v) = m * q(vw)/c(v) + (1 - m) * (c(w) + 1)/(N + V + 1) with m = c(v)/(c(v) + BACKOFF);
a pair never seen has q(vw) = 0, and after a v never seen the second part is all. Over all
words and one unknown, P adds up to 1 at most (but for false positives of the filter).

Words' counts and the filter follow the corpus. They are broadcast up to MAX_BROADCAST
bytes; beyond it, chunks of texts send their distinct hashes to the ranges as packed
blocks and get values back in that order: same numbers, more shuffling.

Defined cases: null or empty text is its end token alone; without training rows
N = V = 0; an empty table scores nothing; repeated rows count and score each; a very long
text is hashed in blocks cut at spaces; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import give_back, id_crc, materialize, release_shuffles, releasing, text_hash

PROBES = 8  # a pair never seen passes for seen once in 2 ** PROBES times
BITS = 1.44 * PROBES  # of the filter for each entry: half of them are set
BACKOFF = 128.0  # a word seen so often trusts its pairs as much as the single word
MAX_BROADCAST = 256_000_000
RANGE_TEXT = 4_000_000  # bytes of training text to a hash range
CHUNK_TEXT = 8_000_000  # bytes of text whose hashes are looked up together, where they aren't broadcast
SLAB = 1 << 19  # bytes of text hashed at once
HELD = 1 << 19  # hashes a task holds before it counts them
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
U = np.uint64
_rng = np.random.default_rng(42)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of a public 64-bit generator: spreads every bit over all."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _hashed_block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < len(b):
        n = max(len(b), 2 * SLAB)
        _tables[:] = [_powers(_BASE, n), _powers(_BASE_INVERSE, n)]
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate(([U(0)], np.cumsum(_BYTE[b] * _tables[0][: len(b)], dtype=np.uint64)))
    return mixed((total[end] - total[start]) * _tables[1][start] + (end - start).astype(np.uint64)), start


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the place where it starts, by blocks cut at spaces."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= 2 * SLAB:
        return _hashed_block(b)
    cuts = [0]
    while cuts[-1] < len(b):
        at, space = cuts[-1] + SLAB, np.zeros(0, int)
        while at < len(b) and not len(space := np.flatnonzero(_SPACE[b[at : at + SLAB]])):
            at += SLAB
        cuts.append(min(at + int(space[0]) if len(space) else len(b), len(b)))
    parts = [(h, start + lo) for lo, hi in zip(cuts, cuts[1:], strict=False) for h, start in [_hashed_block(b[lo:hi])]]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _slabs(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Consecutive texts of about SLAB bytes together: first, last + 1, joined, offsets."""
    at, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        parts.append((text or "").encode().lower())
        size += len(parts[-1]) + 1
        if size >= SLAB or i == len(texts) - 1:
            yield at, i + 1, b"\n".join(parts), np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            at, parts, size = i + 1, [], 0


def tokens(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first row, last + 1, row of each token (from 0), token, token before it."""
    for first, last, raw, offsets in _slabs(texts):
        h, start = _hashed(raw)
        n = last - first
        row = np.searchsorted(offsets, start, side="right") - 1
        ends = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
        tok = np.empty(len(h) + n, np.uint64)
        tok[ends] = END
        tok[np.arange(len(h)) + row] = h
        before = np.empty_like(tok)
        before[1:] = tok[:-1]
        before[0] = START
        before[ends[:-1] + 1] = START
        yield first, last, np.repeat(np.arange(n), np.diff(np.concatenate(([-1], ends)))), tok, before


def pair_hash(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mixed(before * U(0x9FB21C651E98DF25) + tok)


def _counted(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their counts summed."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate((h[:1] == h[:1], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(c, first) if len(first) else c


def packed(h: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane: the high planes are nearly all zero."""
    gaps = np.diff(h, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    planes = np.concatenate((gaps.ravel(), np.minimum(c, 255).astype(np.uint8), c[c >= 255].astype(np.int64).view(np.uint8)))
    return len(h).to_bytes(8, "little") + zlib.compress(planes.tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zlib.decompress(blob[8:]), np.uint8)
    h = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    c = raw[8 * n : 9 * n].astype(np.int64)
    c[c == 255] = raw[9 * n :].view(np.int64)
    return h, c


def packed_values(c: np.ndarray) -> bytes:
    return len(c).to_bytes(8, "little") + zlib.compress(np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype(np.int64).tobytes(), 1)


def unpacked_values(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zlib.decompress(blob[8:]), np.uint8)
    c = raw[:n].astype(np.int64)
    c[c == 255] = raw[n:].view(np.int64)
    return c


def _count_partition(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}

        def flushed() -> pd.DataFrame:
            rows = []
            for order, parts in held.items():
                if parts:
                    h, c = np.unique(np.concatenate(parts), return_counts=True)
                    cuts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() + [len(h)]
                    rows += [(order, k, packed(h[a:b], c[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                parts.clear()
            return pd.DataFrame(rows, columns=["order", "range", "blob"])

        size = 0
        for batch in batches:
            for _, _, _, tok, before in tokens(batch["text"].tolist()):
                held[1].append(tok)
                held[2].append(pair_hash(before, tok))
                size += len(tok)
                if size >= HELD:
                    yield flushed()
                    size = 0
        if size:
            yield flushed()

    return run


def level(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


def level_count(q: np.ndarray) -> np.ndarray:
    """The least of a level's counts; 0 for level 0."""
    return np.where(q > 0, 2.0 ** (q - 1), 0.0)


def _salt(q: int) -> np.uint64:
    return U(q * 0x632BE59BD9B4E019 % (1 << 64))


def _places(h: np.ndarray, q: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    g = mixed(h + _salt(q))
    step = (g >> U(32)) | U(1)
    size = np.asarray(size, np.uint64)
    for i in range(PROBES):
        yield ((g & U(0xFFFFFFFF)) + U(i) * step) % size


def _merge_range(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    order, where = key
    parts = [unpacked(b) for b in rows["blob"]]
    h, c = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    if order == 1:
        blob = h.tobytes() + c.astype(np.int64).tobytes()
    else:
        q = level(c)
        size = max(64, math.ceil(BITS * q.sum() / 64) * 64)
        bits = np.zeros(size, bool)
        for k in range(1, int(q.max()) + 1):
            for at in _places(h[q >= k], k, size):
                bits[at.astype(np.int64)] = True
        blob = np.packbits(bits, bitorder="little").tobytes()
    return pd.DataFrame([(order, where, len(h), int(c.sum()), blob)], columns=["order", "range", "n", "total", "blob"])


def gathered(blocks: Iterator[tuple[int, int, int, bytes]]) -> tuple[bytearray, bytearray, bytearray, list[int], list[int]]:
    """Blocks (order, range, entries, bytes), in the order of ranges, as five tables: words,
    ascending, and their counts; the ranges' filters, one behind another, with range and bytes of each."""
    words, counts, filters, where, lengths = bytearray(), bytearray(), bytearray(), [], []
    for order, at, n, blob in blocks:
        if order == 1:
            words += blob[: 8 * n]
            counts += blob[8 * n :]
        else:
            filters += blob
            where.append(at)
            lengths.append(len(blob))
    return words, counts, filters, where, lengths


class Model:
    """What a task needs to score: words' counts, the pairs' filter, N, V and the training rows.
    tables: as gathered() returns them; views of them, no copies."""

    def __init__(self, tables: tuple, bits: int, n: int, v: int, rows: int, backoff: float = BACKOFF):
        self.bits, self.n, self.v, self.rows, self.backoff = bits, n, v, rows, backoff
        words, counts, filters, where, lengths = tables
        self.words, self.count, self.filter = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(filters, np.uint8)
        #: Where each range's filter begins, and its bits (0: none).
        self.begin, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        size = np.array(lengths, np.uint64) * U(8)
        self.begin[where], self.size[where] = np.cumsum(size) - size, size

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of words."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        known, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, known), len(self.words) - 1)
        return np.where(self.words[at] == known, self.count[at], 0)[back]

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Of pairs: probed level by level until one is missing."""
        known, back = np.unique(h, return_inverse=True)
        q = np.zeros(len(known), np.int64)
        where = (known >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(known), np.int64)
        alive, k = np.flatnonzero(self.size[where]), 0
        while alive.size:
            k += 1
            g = mixed(known[alive] + _salt(k))
            spot, step = g & U(0xFFFFFFFF), (g >> U(32)) | U(1)
            begin, size = self.begin[where[alive]], self.size[where[alive]]
            for _ in range(PROBES):
                at = begin + spot % size
                kept = np.flatnonzero((self.filter[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1)
                if len(kept) < len(alive):
                    alive, spot, step, begin, size = alive[kept], spot[kept], step[kept], begin[kept], size[kept]
                spot = spot + step
            q[alive] = k
        return q[back]

    def log10(self, c: np.ndarray, before: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base and model log-probabilities from counts of the word, of the one before, and of the pair."""
        flat = (c + 1) / (self.n + self.v + 1)
        trust = before / (before + self.backoff)
        full = trust * np.minimum(pair / np.maximum(before, 1), 1) + (1 - trust) * flat
        return np.log10(flat), np.log10(full)


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score_texts(model: Model, texts: list[str | None]) -> pd.DataFrame:
    out = []
    for first, last, row, tok, before in tokens(texts):
        c = model.counts(tok)
        prior = np.empty_like(c)
        prior[1:] = c[:-1]
        prior[before == START] = model.rows
        base, full = model.log10(c, prior, level_count(model.levels(pair_hash(before, tok))))
        n = last - first
        out.append(pd.DataFrame({"n_tokens": np.bincount(row, minlength=n), "n_known": np.bincount(row, c > 0, n).astype(np.int64), "base_score": np.bincount(row, base, n), "score": np.bincount(row, full, n)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})


def count_model(train: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of all ranges (order, range, n, total, blob), in the shared folder, and the
    number of leading hash bits that name a range."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, math.ceil(math.log2(max(size / RANGE_TEXT, 1))))
    sent = train.select("text").mapInPandas(releasing(_count_partition(bits)), "order int, range long, blob binary")
    merged = sent.groupBy("order", "range").applyInPandas(_merge_range, "order int, range long, n long, total long, blob binary")
    return materialize(merged, "ngrams"), bits


def _chunk_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and token before it, of all texts."""
    parts = [(row + first, tok, before) for first, _, row, tok, before in tokens(texts)]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted; np.unique() without counts looks each up in a table, which takes many times as long."""
    h = np.sort(h)
    return h[np.concatenate((h[:1] == h[:1], h[1:] != h[:-1]))]


def _asked(bits: int):
    """A chunk's distinct words and pairs, sorted, as blocks by range."""

    def run(chunk: pa.Table) -> pa.Table:
        _, tok, before = _chunk_tokens(chunk["text"].to_pylist())
        rows = []
        for order, h in ((1, _distinct(tok)), (2, _distinct(pair_hash(before, tok)))):
            cuts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() + [len(h)]
            rows += [(order, k, packed(h[a:b], np.ones(b - a, np.int64))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        at = chunk["chunk"][0].as_py()
        give_back()
        return pa.table({"chunk": pa.array([at] * len(rows), pa.int64()), "order": pa.array([r[0] for r in rows], pa.int32()), "range": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _answers(asked: pa.Table, block: pa.Table) -> pa.Table:
    """To each block of hashes their values, words' counts or pairs' levels, in the order asked."""
    rows, kept = asked.num_rows, (asked["chunk"], asked["order"], asked["range"])
    values: list[bytes] = []
    if rows:
        order = asked["order"][0].as_py()
        # One range alone, which every probe here is of.
        model = Model(gathered(zip(block["order"].to_pylist(), [0] * block.num_rows, block["n"].to_pylist(), block["blob"].to_pylist(), strict=True)), 0, 0, 0, 0)
        parts = [unpacked(b)[0] for b in asked["blob"].to_pylist()]
        h = np.concatenate(parts)
        found = model.counts(h) if order == 1 else model.levels(h)
        values = [packed_values(v) for v in np.split(found, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table([*kept, pa.array(values, pa.binary())], names=["chunk", "order", "range", "values"])


def _scored_chunk(n: int, v: int, rows: int, backoff: float):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        found = answers.sort_by([("order", "ascending"), ("range", "ascending")])
        row, tok, before = _chunk_tokens(chunk["text"].to_pylist())
        got = {1: [np.zeros(0, np.int64)], 2: [np.zeros(0, np.int64)]}
        for order, blob in zip(found["order"].to_pylist(), found["values"].to_pylist(), strict=True):
            got[order].append(unpacked_values(blob))

        def values(order: int, h: np.ndarray) -> np.ndarray:
            known, back = np.unique(h, return_inverse=True)
            of = np.concatenate(got[order])
            if len(of) != len(known):
                raise ValueError("a chunk's texts are not those it asked for")
            return of[back]

        c = values(1, tok)
        prior = np.empty_like(c)
        prior[1:] = c[:-1]
        prior[before == START] = rows
        base, full = Model(gathered(iter(())), 0, n, v, rows, backoff).log10(c, prior, level_count(values(2, pair_hash(before, tok))))
        size = chunk.num_rows
        sums = {"n_tokens": np.bincount(row, minlength=size), "n_known": np.bincount(row, c > 0, size).astype(np.int64), "base_score": np.bincount(row, base, size), "score": np.bincount(row, full, size)}
        out = pa.table({"doc_id": chunk["doc_id"], "times": chunk["times"], **sums})
        give_back()
        return out

    return run


def _by_join(docs: DataFrame, blocks: DataFrame, bits: int, n: int, v: int, rows: int, backoff: float) -> DataFrame:
    """score_texts() for counts too large to broadcast. Texts are dealt to chunks; a chunk sends its distinct
    hashes to their ranges, and gets values back in the same order. No row is made for a token."""
    release_shuffles(docs.sparkSession)  # those of the counting
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_TEXT))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", text_hash()), F.lit(chunks)).alias("chunk"), "doc_id", text_hash().alias("thash"), "text").repartition("chunk")
    keyed = dealt.groupBy("chunk", "doc_id", "thash").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times")).drop("thash")
    asked = keyed.groupBy("chunk").applyInArrow(_asked(bits), "chunk long, order int, range long, blob binary")
    found = asked.groupBy("order", "range").cogroup(blocks.groupBy("order", "range")).applyInArrow(_answers, "chunk long, order int, range long, values binary")
    answers = materialize(found, "answers")
    del asked, found
    release_shuffles(docs.sparkSession)
    scored = keyed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored_chunk(n, v, rows, backoff), f"doc_id {kind}, times long, {SCORES}")
    # Equal rows were scored once.
    return scored.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("copy", "times")


def score_language_model(docs: DataFrame, train: DataFrame, max_broadcast: int = MAX_BROADCAST, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    blocks, bits = count_model(train)
    sums = blocks.agg(
        F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias("size"),
        F.coalesce(F.sum(F.when(F.col("order") == 1, F.col("total"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("order") == 1, F.col("n"))), F.lit(0)).alias("v"),
    ).first()
    rows = train.count()
    if sums["size"] > max_broadcast:
        scored = _by_join(docs, blocks, bits, sums["n"], sums["v"], rows, backoff)
    else:
        spark = docs.sparkSession
        ordered = blocks.select("order", "range", "n", "blob").orderBy("order", "range")
        held = spark.sparkContext.broadcast(gathered(map(tuple, ordered.toLocalIterator())))
        n, v = sums["n"], sums["v"]

        @F.pandas_udf(SCORES)
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = Model(held.value, bits, n, v, rows, backoff)
            yield from releasing(lambda batches: (score_texts(model, batch.tolist()) for batch in batches))(texts)

        scored = docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
    return scored.withColumn("train_tokens", F.lit(sums["n"]).cast("long"))


def held_out_rows(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 7 == 2
