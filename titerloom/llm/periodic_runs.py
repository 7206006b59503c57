"""Runs of repetition in a text's words, found by seeds that are extended along diagonals.

A run is a stretch of words with smallest period q (words q apart are the same) and at least
``least`` words and ``times`` periods, that neither neighbouring word continues. Along its diagonal,
the pairs (i, i + q), it has max(least - q, (times - 1) q) matches in a row, so of lags from m to
2m - 1 every diagonal of a run holds a k-gram of k = m at a multiple of m: the seeds. Each seed's
occurrences m to 2m - 1 words on are looked up in an index of the document's k-grams.

* Up to two occurrences are two diagonals to extend.
* More of them form a progression, as they overlap: the seed itself is periodic with a smaller
  period p. Then only two diagonals can hold a run of smallest period m or more, those that lay the
  ends, or the starts, of the seed's and the occurrences' stretches of period p on one another;
  none can if these are one stretch. So no group of occurrences is ever paired off.

A table by lag holds the stretches extended so far, so that each is extended once, whatever seeds
lie in it. Seeds, occurrences and extended matches grow with n log n for a text of n words.

Lags below 16 have a class of their own, whose seeds are shorter and all of whose occurrences, 15
at most, are extended. A stretch found with a multiple of its period is the same stretch found
with the period, which is kept.

A text is the unit: one of any length is read whole, by one task. Texts without any repeated k-gram
of the least guaranteed overlap, the many, are passed over by hashes of their words, which can raise
a false suspicion, but can't miss one; suspected texts are compared word by word.

Rows: null texts have no words; rows are independent of one another, so repeated rows and doc_ids
each give a row, a null doc_id stays null; an empty table gives none; other columns take no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import releasing

LEAST, TIMES = 24, 3
#: Lags below it are looked for together; a power of two.
SHORT = 16
#: Words of the texts that are looked through at once.
AT_ONCE = 300_000
RUNS = "array<struct<start long, length long, period long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def overlap(lag: int, least: int = LEAST, times: int = TIMES) -> int:
    """Matches in a row that a run of this period has on its diagonal."""
    return max(least - lag, (times - 1) * lag)


def short_overlap(least: int, times: int) -> int:
    return min(overlap(q, least, times) for q in range(1, SHORT))


class Diagonals:
    """The stretches of matches of words a lag apart, each extended once."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.table: dict[int, tuple[list[int], list[int]]] = {}

    def stretch(self, lag: int, at: int) -> tuple[int, int]:
        """Where the matches begin and end around word at, which matches word at + lag."""
        starts, ends = self.table.setdefault(lag, ([], []))
        k = bisect_right(starts, at) - 1
        if k >= 0 and at < ends[k]:
            return starts[k], ends[k]
        start, end = self.back(lag, at), self.forth(lag, at)
        starts.insert(k + 1, start)
        ends.insert(k + 1, end)
        return start, end

    def forth(self, lag: int, at: int) -> int:
        w, last, step = self.words, len(self.words) - lag, 64
        while at < last:
            to = min(at + step, last)
            differ = w[at:to] != w[at + lag : to + lag]
            if differ.any():
                return at + int(differ.argmax())
            at, step = to, min(2 * step, 1 << 16)
        return last

    def back(self, lag: int, at: int) -> int:
        w, step = self.words, 64
        while at > 0:
            to = max(0, at - step)
            differ = w[to:at] != w[to + lag : at + lag]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = to, min(2 * step, 1 << 16)
        return 0


def doubled(names: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the k-grams of twice the length: equal numbers, equal words."""
    pairs = names[:-length].astype(np.int64) * (int(names.max()) + 1) + names[length:]
    return np.unique(pairs, return_inverse=True)[1]


def occurrences(names: np.ndarray, seeds: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index, all positions by k-gram, and for each seed where in it those lo to hi - 1 words on begin and end."""
    order = np.argsort(names, kind="stable")
    width = len(names) + hi
    keys = names[order] * width + order
    base = names[seeds] * width + seeds
    return order, np.searchsorted(keys, base + lo), np.searchsorted(keys, base + hi)


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of words, numbers of 0 and above, as (start, length, period), by start, then period."""
    if times < 3 or least < SHORT:
        raise ValueError(f"runs of at least 3 periods and {SHORT} words are found")
    n, diagonals = len(words), Diagonals(words)
    if n < least:
        return []
    names, length = np.unique(words, return_inverse=True)[1], 1
    # Short lags: seeds of half the least overlap, rounded down to a power of two.
    common = short_overlap(least, times)
    size = 1 << max(0, ((common + 1) // 2).bit_length() - 1)
    while length < size and length < len(names):
        names, length = doubled(names, length), 2 * length
    classes = [(1, SHORT, size, common - size + 1)]
    classes += [(m, 2 * m, m, m) for m in (SHORT << k for k in range(64)) if m * times <= n]
    for lo, hi, size, stride in classes:
        while length < size and 2 * length <= n:
            names, length = doubled(names, length), 2 * length
        if length < size or int(names.max()) + 1 == len(names):
            break  # no k-gram occurs twice, nor does a longer one
        seeds = np.arange(0, len(names), stride)
        order, first, last = occurrences(names, seeds, lo, hi)
        for k in np.flatnonzero(last > first):
            at, found = int(seeds[k]), order[first[k] : last[k]]
            if lo == 1 or len(found) < 3:
                for other in found.tolist():
                    diagonals.stretch(other - at, at)
            else:
                other, period = int(found[0]), int(found[1] - found[0])
                here, there = diagonals.stretch(period, at), diagonals.stretch(period, other)
                if here != there:
                    for a, b in zip(here, there, strict=True):
                        if lo <= b - a < hi and words[at] == words[at + b - a]:
                            diagonals.stretch(b - a, at)
    shortest: dict[tuple[int, int], int] = {}
    for lag, (starts, ends) in diagonals.table.items():
        for start, end in zip(starts, ends, strict=True):
            if end - start >= overlap(lag, least, times):
                shortest[start, end + lag] = min(lag, shortest.get((start, end + lag), lag))
    return sorted((start, end - start, lag) for (start, end), lag in shortest.items())


def suspects(texts: list[list[bytes]], size: int) -> set[int]:
    """The texts in which some size words in a row, by their hashes, come twice."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(counts.sum())
    if total < size:
        return set()
    grams = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, total).view(np.uint64)
    length, odd = 1, np.uint64(0x9E3779B97F4A7C15)
    while length < size:
        step = min(length, size - length)  # the two halves may overlap
        grams = (grams[:-step] ^ (grams[:-step] >> np.uint64(29))) * odd + grams[step:]
        length += step
    text = np.repeat(np.arange(len(texts)), counts)
    whole = text[: len(grams)] == text[size - 1 :]
    grams, text = grams[whole], text[: len(whole)][whole]
    grams += text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return set()
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    return set(np.unique(text[twice[at] == grams]).tolist())


def numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words less those that a run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def repeated_from(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For one id in ten (by its crc32), the words with a part repeated from some word on; ids and
    places are given by a rule. A null id's words stay as they are."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + period]
    return words[:a] + (part * ((n - a) // len(part) + 1))[: n - a]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start, then period) and
    collapsed, the words outside of runs and of each run its first period, joined by a space.
    change: applied to the words and doc_id of each row first. No row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, row = batch.column(0).to_pylist(), batch.column(1), 0
            while row < len(ids):
                group: list[list[bytes]] = []
                size, first = 0, row
                while row < len(ids) and (not group or size < AT_ONCE):
                    # bytes.split() parts at space and 09 to 0D.
                    words = (texts[row].as_py() or "").encode().split()
                    group.append(change(words, ids[row]) if change else words)
                    size += len(group[-1])
                    row += 1
                found = {k: find_runs(numbers(group[k]), least, times) for k in suspects(group, short_overlap(least, times))}
                columns = [
                    pa.array(ids[first:row], pa.int64()),
                    pa.array([len(w) for w in group], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, [])] for k in range(len(group))], _RUNS),
                    pa.array([b" ".join(collapsed(w, found.get(k, []))) for k, w in enumerate(group)], pa.binary()).cast(pa.string()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def greatest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    none = F.lit(None).cast("struct<start long, length long, period long>")
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))


def digest(docs: DataFrame) -> DataFrame:
    """Of periodic_runs(): doc_id, n_runs, the greatest run and digests of all runs and of the words kept."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = docs.withColumn("best", greatest())
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
