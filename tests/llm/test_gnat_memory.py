"""A few queries that go to all leaves make many rows, which are given out by parts."""

import numpy as np

from titerloom.llm import gnat


def test_queries_go_out_by_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(gnat, "ASKED", 7)
    monkeypatch.setattr(gnat, "GIVEN", 5)
    monkeypatch.setattr(gnat, "CHUNK", 16)
    rows = [(i, int(rng.integers(0, 4)), [int(v) for v in rng.integers(-20, 20, 6)]) for i in range(300)]
    got = {tuple(r) for r in gnat.hard_negatives(spark.createDataFrame(rows, "id long, label int, vec array<long>"), gnat.F.col("id") % 10 == 0).collect()}
    want = set()
    x, label = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for a in range(0, 300, 10):
        s = x @ x[a]
        order = sorted((i for i in range(300) if i != a), key=lambda i: (-s[i], i))
        for p in [i for i in order if label[i] == label[a]][:5]:
            fits = [i for i in order if label[i] != label[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            want |= {(a, p, n + 1, i, int(s[p]), int(s[i])) for n, i in enumerate(fits)}
    assert got == want and want
