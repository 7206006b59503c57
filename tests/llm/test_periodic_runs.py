"""Runs of words against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from titerloom.llm import periodic_runs as P


def brute_runs(w, least=24, times=3):
    """Every period in turn; a stretch counts with its smallest period."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and w[i] == w[i + q]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i - start + q
                if length >= max(least, times * q):
                    found.setdefault((start, length), q)
                start = None
    return sorted((s, length, q) for (s, length), q in found.items())


def repetitive(r, depth=3):
    """Words with repetitions in repetitions, ends torn off, and near repetitions."""
    if depth == 0:
        return [r.choice("ab" if r.random() < 0.7 else "abcdef") for _ in range(r.randrange(1, 12))]
    out = []
    for _ in range(r.randrange(1, 4)):
        part = repetitive(r, depth - 1)
        part = part * r.randrange(1, 7)
        part = part[: r.randrange(1, len(part) + 1)]
        if r.random() < 0.3:
            part[r.randrange(len(part))] = "x"
        out += part
    return out


def test_runs_equal_brute_force():
    r = random.Random(3)
    with_runs = 0
    for _ in range(1500):
        w = repetitive(r)[:400]
        got = P.find_runs(P.numbers(w))
        assert got == brute_runs(w), " ".join(w)
        with_runs += bool(got)
    assert with_runs > 300


def test_seeds_that_are_periodic_themselves():
    for p in (1, 2, 3, 7):
        block = [f"b{k}" for k in range(p)]
        for a, b, c in ((60, 61, 3), (64, 40, 4), (33, 90, 5), (128, 1, 4)):
            word = (block * a)[:a] + ["x"] + (block * b)[:b] + ["y"]
            for w in (word * c, (word * c)[5:-7], (block * 300)[:300] + word * c, [*word * c, *word[:-3]]):
                assert P.find_runs(P.numbers(w)) == brute_runs(w)
    aabb = [*(["p"] * 40 + ["u"]) * 2, *(["p"] * 40 + ["v"]) * 2] * 4
    assert P.find_runs(P.numbers(aabb)) == brute_runs(aabb)


def test_other_bounds():
    r = random.Random(5)
    for _ in range(300):
        w = repetitive(r)[:300]
        for least, times in ((16, 3), (24, 4), (60, 3)):
            assert P.find_runs(P.numbers(w), least, times) == brute_runs(w, least, times)
    with pytest.raises(ValueError):
        P.find_runs(np.array([1]), 10)


def test_long_texts_stay_quick():
    assert P.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    r = np.random.default_rng(1)
    part = r.integers(0, 1000, 70_001)
    w = np.concatenate([r.integers(0, 1000, 999), part, part, part, part[:5]])
    assert P.find_runs(w) == brute_ends(w, 999, 3 * 70_001 + 5, 70_001)
    passage = r.integers(0, 9, 100)
    copies = np.concatenate([np.concatenate([passage, r.integers(0, 10**9, r.integers(1, 9))]) for _ in range(3000)])
    assert P.find_runs(copies) == []


def brute_ends(w, start, length, q):
    while start and w[start - 1] == w[start - 1 + q]:
        start, length = start - 1, length + 1
    return [(start, length, q)]


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(words) if i not in gone)))


def test_the_query_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 700)
    r = random.Random(11)
    docs = [(i, " ".join(repetitive(r)) if i % 3 else " ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randrange(90)))) for i in range(300)]
    docs += [(None, "a b " * 30), (None, None), (900, None), (901, ""), (902, " \t\n\x0b\x0c\r"), (5, docs[5][1]), (5, docs[5][1]), (903, "é\x1c é\x1c\xa0é  " * 40), (904, "one " * 20_000), (-7, "x y z " * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as runs", "'s' as collapsed", "2 as n_words").repartition(3)
    got = [tuple(x) for x in P.digest(P.periodic_runs(frame, change=P.repeated_from)).collect()]
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    small = [d for d in docs if d[0] != 904]
    assert sorted((x for x in got if x[0] != 904), key=key) == sorted((brute_row(*d) for d in small), key=key)
    assert len([x for x in got if x[0] == 904]) == 1 and sum(x[1] > 0 for x in got) > 40
    plain = P.periodic_runs(frame).where("doc_id = 904").first()
    assert [tuple(x) for x in plain["runs"]] == [(0, 20_000, 1)] and plain["collapsed"] == "one" and plain["n_words"] == 20_000
    assert P.digest(P.periodic_runs(frame.where("false"))).count() == 0


def test_the_greatest_is_compared_exactly(spark):
    rows = [([(0, 30, 10), (50, 31, 10), (90, 62, 20)],), ([(5, 10**9 + 1, 10**8), (9, 10**9 + 2, 10**8)],), ([],)]
    frame = spark.createDataFrame(rows, f"runs {P.RUNS}").select(P.greatest().alias("b"))
    assert [tuple(r["b"]) if r["b"] else None for r in frame.collect()] == [(50, 31, 10), (9, 10**9 + 2, 10**8), None]


def test_suspicion_misses_nothing():
    r = random.Random(2)
    texts = [[x.encode() for x in repetitive(r)] for _ in range(200)] + [[], [b"a"] * 15, [b"a"] * 17]
    twice = lambda w: len({tuple(w[i : i + 16]) for i in range(len(w) - 15)}) < max(0, len(w) - 15)
    assert P.suspects(texts, 16) == {k for k, w in enumerate(texts) if twice(w)}
