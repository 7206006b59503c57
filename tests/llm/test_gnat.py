"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerloom.llm import gnat, queries

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, pair by pair."""
    clean = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            clean[i, ints, (label + 1) % 10 if i % 7 == 0 else label] = None
    out = []
    for i, a, label in clean:
        if i % 50:
            continue
        score = lambda v, a=a: sum(x * y for x, y in zip(a, v, strict=False))
        others = [(-score(v), j, m == label) for j, v, m in clean if j != i]
        for s, p, _ in sorted(x for x in others if x[2])[:5]:
            fits = sorted((t, j) for t, j, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(fits[:3])]
    return sorted(out)


def found(spark, rows, monkeypatch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(gnat, name, value)
    table = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' as vec", "1 as leaf").repartition(3)
    monkeypatch.setattr(queries, "load", lambda *a: table)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in queries.op11_hard_negatives(spark, "").select(*columns).collect())


def vectors(r, n, d=6, centres=12):
    middle = [[r.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    out = []
    for i in range(n):
        c = r.randrange(centres)
        out.append((i * 5 % (5 * n), [x + r.gauss(0, 0.2) for x in middle[c]], c % 10 if r.random() < 0.6 else r.randrange(10)))
    return out


def test_equals_brute_force(spark, monkeypatch):
    rows = vectors(random.Random(1), 700)
    hot = [(10_000 + i, [0.5, 0.25, -0.5, 1.0, 0.0, 0.125], 3 if i % 3 else 4) for i in range(350)]
    odd = [(20_000, None, 1), (20_050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (20_100, [math.nan] * 6, 2), (20_150, [math.inf] * 6, 2), (20_200, [1.0] * 6, None), (None, [1.0] * 6, 2), (20_250, [0.0] * 6, 2), (20_300, [], 2), (20_350, [3.0, -2.0], 5), (0, rows[0][1], rows[0][2]), (10_050, hot[0][1], 3)]
    every = rows + hot + odd
    want = brute(every)
    assert len(want) > 100
    assert found(spark, every, monkeypatch, CHUNK=40, SAMPLE=150) == want


def test_few_rows(spark, monkeypatch):
    assert found(spark, [], monkeypatch) == []
    assert found(spark, [(1, [1.0], 1)], monkeypatch) == []
    alone = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (53, [0.5, 0.5], 2), (54, [0.25, 0.0], 3)]
    assert found(spark, alone, monkeypatch) == brute(alone) == [(50, 51, 1, 52, 65536, 49152), (50, 51, 2, 53, 65536, 32768)]


def test_the_tree_loses_no_row_and_prunes():
    r = random.Random(4)
    x = np.array([[int(256 * v) for v in row[1]] for row in vectors(r, 3000, d=4, centres=60)])
    square = float((x * x).sum(1).max())
    tree = gnat.Tree(x[:1500], 40 * 3000, square)
    lifted = tree.lift(x)
    leaf = tree.leaf_of(lifted)
    for node in tree.nodes:
        node.low = np.full((len(node.pivots),) * 2, np.inf)
        node.high = -node.low
    for n, rows, of in tree.walk(lifted):
        d = tree.distances(lifted[rows], np.full(len(rows), square), tree.nodes[n])
        for k in np.unique(of):
            tree.nodes[n].low[:, k], tree.nodes[n].high[:, k] = d[of == k].min(0), d[of == k].max(0)
    assert len(tree.nodes) > 1 and tree.leaves > 20
    q = x[:200]
    s = q @ x.T
    best = np.sort(s, axis=1)[:, -5]
    for low, high in ((best, np.full(200, gnat.MOST)), (best // 2, best * 95 // 100), (np.full(200, -10**6), np.full(200, -9 * 10**5))):
        rows, leaves = tree.survivors(q, low[:, None], high[:, None])
        reached = set(zip(rows.tolist(), leaves.tolist(), strict=True))
        for i, j in np.argwhere((s >= low[:, None]) & (s <= high[:, None])):
            assert (i, leaf[j]) in reached
    rows, _ = tree.survivors(q, best[:, None], np.full((200, 1), gnat.MOST))
    assert len(rows) < 0.5 * 200 * tree.leaves


def test_too_large_numbers_are_refused(spark):
    rows = spark.createDataFrame([(50, 1, [2**40]), (51, 1, [2**40])], "id long, label int, vec array<long>")
    with pytest.raises(ValueError):
        gnat.hard_negatives(rows, F.col("id") % 50 == 0)
