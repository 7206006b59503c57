"""Hard negatives by a multiway hyperplane tree (GNAT) over integer vectors: exact inner products.

Inner products become distances: with one more coordinate, which lifts every vector x to the
length R of the longest (0 for a query), |q - x|^2 = |q|^2 + R^2 - 2 q.x, so a window of scores is
an annulus around the query. A node of the tree has several split points; each row belongs to the
nearest, and for each pair (split point, child) the node keeps the least and greatest distance from
the one to all rows below the other. A child is eliminated if for some split point no distance in
its range can occur in the annulus. Rows of the leaves left are scored exactly, as integers.

* The tree is built from at most SAMPLE distinct vectors, those of the least hashes; every row goes
  into it, and the ranges are of all rows. Its size is bounded, so tasks carry it.
* Rows of one vector and label are one point, which keeps its few smallest ids: of equal scores the
  smallest ids come first, so no other can be among the first. Thus copies, however many, are no
  hot group. Leaves are dealt in chunks of at most about CHUNK points and queries, which meet in
  tasks of bounded size; large leaves and many queries make more tasks, not larger ones.
* Each search has two rounds: a query's own leaf gives a bound, which the tree is then searched with.
  In vectors without any structure few children can be eliminated, and most leaves are scored.

Rows without an id, label or vector, or with a component that is null, take no part (the caller
decides on others before it makes integers). A shorter vector counts as filled up with zeros. Rows
that agree in id, label and vector count once; other rows of an anchor's id are the anchor itself.
Ties go to the smaller id. Without anchors, or without rows, there is no result. Scores are exact;
where they could exceed 2^56, ValueError is raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.llm.common import materialize

#: Distinct vectors that the tree is built from; split points of a node; points of a leaf, a chunk, and queries of a chunk.
SAMPLE, WAYS, CHUNK = 4096, 16, 2048
#: Queries that go through the tree at once, and rows (a query and a leaf) that they are given out by.
ASKED, GIVEN = 256, 4096
#: Relative tolerance of squared distances, and of distances, whose roots near zero round worse: far above the rounding of doubles.
SLACK, ROUNDING = 1e-9, 1e-5
KEY = ("k1", "k2")
#: Beyond all scores.
LEAST, MOST = -(2**56), 2**56


@dataclass
class Node:
    pivots: np.ndarray  # with the lifting coordinate
    children: list[int]  # a node's number, or ~ a leaf's
    low: np.ndarray = field(default_factory=lambda: np.empty(0))
    high: np.ndarray = field(default_factory=lambda: np.empty(0))


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d numbers."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


class Tree:
    """nodes: the first is the root; without any, all rows are in leaf 0. chunks: by leaf."""

    def __init__(self, sample: np.ndarray, rows: int, square: float) -> None:
        self.d, self.square, self.nodes, self.leaves = sample.shape[1], square, [], 0
        self.chunks: list[int] = []
        per_leaf = max(8, int(CHUNK * len(sample) / max(rows, 1)))
        self.build(self.lift(sample), per_leaf)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(0, self.square - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def build(self, x: np.ndarray, per_leaf: int) -> int:
        """The number of a node over the sample x, or ~ that of a leaf."""
        pivots = self.far_apart(x, min(WAYS, -(-len(x) // per_leaf))) if len(x) > per_leaf else x[:0]
        if len(pivots) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        me = len(self.nodes)
        self.nodes.append(Node(pivots, []))
        of = (x @ pivots.T).argmax(1)
        self.nodes[me].children = [self.build(x[of == k], per_leaf) for k in range(len(pivots))]
        return me

    @staticmethod
    def far_apart(x: np.ndarray, k: int) -> np.ndarray:
        """Up to k rows, each as far as can be from those before it; fewer if the rest are copies."""
        distance, chosen = ((x - x.mean(0)) ** 2).sum(1), []
        while len(chosen) < k and (not chosen or distance.max() > 0.5):
            at = int(distance.argmax())
            chosen.append(at)
            to = ((x - x[at]) ** 2).sum(1)
            distance = to if len(chosen) == 1 else np.minimum(distance, to)
        return x[chosen]

    def walk(self, lifted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each node that rows come to: its number, the rows, and the child each goes on to."""
        todo = [(0, np.arange(len(lifted)))] if self.nodes else []
        while todo:
            n, rows = todo.pop()
            node = self.nodes[n]
            of = (lifted[rows] @ node.pivots.T).argmax(1)
            yield n, rows, of
            for k, child in enumerate(node.children):
                if child >= 0 and (of == k).any():
                    todo.append((child, rows[of == k]))

    def leaf_of(self, lifted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lifted), np.int32)
        for n, rows, of in self.walk(lifted):
            out[rows] = ~np.array(self.nodes[n].children, np.int32)[of]  # corrected below a further node
        return out

    def distances(self, a: np.ndarray, squares: np.ndarray, node: Node) -> np.ndarray:
        """From rows with these squared lengths to the split points, which have the length R."""
        return np.sqrt(np.maximum(0, squares[:, None] + self.square - 2 * (a @ node.pivots.T)))

    def survivors(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) that the windows of scores low to high, some for each query, may reach."""
        q, low, high = q.astype(np.float64), low.astype(np.float64), high.astype(np.float64)
        own = np.einsum("ij,ij->i", q, q)
        lifted = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        base, slack = own[:, None] + self.square, SLACK * (own[:, None] + self.square + 1)
        near = np.sqrt(np.maximum(0, base - 2 * high - slack))
        far = np.sqrt(np.maximum(0, base - 2 * low + slack))
        none = high < low
        near[none], far[none] = np.inf, -np.inf
        if not self.nodes:
            alive = np.flatnonzero((~none).any(1))
            return alive, np.zeros(len(alive), np.int64)
        todo, found = [(0, np.flatnonzero((~none).any(1)))], []
        while todo:
            n, rows = todo.pop()
            node = self.nodes[n]
            d = self.distances(lifted[rows], own[rows], node)[:, :, None]  # query, split point, child
            tolerance = ROUNDING * np.sqrt(base[rows] + 1)
            least = np.maximum(0, np.maximum(d - node.high, node.low - d)).max(1) - tolerance
            most = (d + node.high).min(1) + tolerance
            reached = ((least[:, :, None] <= far[rows][:, None, :]) & (most[:, :, None] >= near[rows][:, None, :])).any(2)
            for k, child in enumerate(node.children):
                left = rows[reached[:, k]]
                if not len(left):
                    continue
                if child < 0:
                    found.append((left, np.full(len(left), ~child)))
                else:
                    todo.append((child, left))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def first_of(score: np.ndarray, points: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int]]:
    """The first k of (score, id), higher scores and smaller ids first; ids holds several for each point."""
    least = np.partition(score, len(score) - k)[-k] if len(score) > k else None
    some = np.arange(len(score)) if least is None else np.flatnonzero(score >= least)
    return sorted(((int(score[i]), v) for i in some for v in ids[points[i]]), key=lambda x: (-x[0], x[1]))[:k]


def products(a: np.ndarray, x: np.ndarray, exact_in_doubles: bool) -> np.ndarray:
    """Inner products as integers; the quick way where doubles hold them exactly."""
    return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact_in_doubles else a @ x.T


@dataclass
class Search:
    """A tree over written points, and how to score."""

    tree: Tree
    points: DataFrame  # k1, k2, label, vec, ids, leaf, chunk
    exact_in_doubles: bool
    same_label: bool
    first: int

    def best(self, queries: DataFrame, own_leaf: bool) -> DataFrame:
        """queries: k1, k2, label, vec, low, high (arrays: windows of scores). Of each query and window
        that has any: n (the window's number), rank, score and id of the first rows in it. own_leaf: of
        the query's own leaf alone."""
        d, tree = self.tree.d, self.tree

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from (batch.slice(at, ASKED) for at in range(0, len(batch), ASKED))

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A query may go to all leaves, so that a few queries make many rows.
            for batch in slices(batches):
                q = matrix(batch.column("vec"), d)
                low, high = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)).reshape(len(q), -1) if len(q) else np.empty((0, 1)) for c in ("low", "high"))
                if own_leaf:
                    rows, leaf = np.arange(len(q)), tree.leaf_of(np.concatenate([q, np.zeros((len(q), 1))], axis=1))
                else:
                    rows, leaf = tree.survivors(q, low, high)
                chunks = np.array(tree.chunks)[leaf]
                again = np.repeat(np.arange(len(rows)), chunks)
                chunk = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                for at in range(0, len(again), GIVEN):
                    some = again[at : at + GIVEN]
                    arrays = [*batch.take(pa.array(rows[some])).columns, pa.array(leaf[some].astype(np.int32)), pa.array(chunk[at : at + GIVEN].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "leaf", "chunk"])

        shape = "k1 long, k2 long, label int, vec array<long>, low array<long>, high array<long>"
        total = queries.count()
        parts = -(-total // CHUNK) or 1
        asked = queries.select(*KEY, "label", "vec", "low", "high").mapInArrow(leaves, shape + ", leaf int, chunk int").withColumn("part", F.pmod("k2", F.lit(parts)).cast("int"))
        rows = self.points.select("label", "vec", "ids", "leaf", "chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        group = ("leaf", "chunk", "part")
        scored = asked.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(self.scorer(), "k1 long, k2 long, n int, score long, id long")
        order = Window.partitionBy(*KEY, "n").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.first)

    def scorer(self) -> Callable[[pa.Table, pa.Table], pa.Table]:
        d, same, first, quick = self.tree.d, self.same_label, self.first, self.exact_in_doubles

        def score(asked: pa.Table, rows: pa.Table) -> pa.Table:
            out: list[tuple[int, int, int, int, int]] = []
            if len(asked) and len(rows):
                asked, rows = asked.combine_chunks(), rows.combine_chunks()
                x, ids, of = matrix(rows["vec"].combine_chunks(), d), rows["ids"].to_pylist(), rows["label"].to_numpy()
                label = asked["label"].to_numpy()
                low, high = (np.stack(asked[c].to_numpy()) for c in ("low", "high"))
                keys = list(zip(asked["k1"].to_pylist(), asked["k2"].to_pylist(), strict=True))
                a = matrix(asked["vec"].combine_chunks(), d)
                for wanted in np.unique(label):
                    mine, theirs = np.flatnonzero(label == wanted), np.flatnonzero((of == wanted) == same)
                    if not len(theirs):
                        continue
                    s = products(a[mine], x[theirs], quick)
                    for r, i in enumerate(mine):
                        for n in range(low.shape[1]):
                            if low[i, n] <= high[i, n]:
                                fits = np.flatnonzero((s[r] >= low[i, n]) & (s[r] <= high[i, n]))
                                if len(fits):
                                    out += [(*keys[i], n, *x) for x in first_of(s[r][fits], theirs[fits], ids, first)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["k1", "k2", "n", "score", "id"])

        return score




def built(points: DataFrame) -> tuple[Tree, DataFrame, bool]:
    """The tree over points (k1, k2, label, vec, ids), the points with leaf and chunk, written, and
    whether doubles hold all inner products."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    greatest = F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double"))))
    size = points.agg(F.count(F.lit(1)), F.max(square), F.max(greatest), F.max(F.size("vec"))).first()
    rows, most, component, d = size[0], size[1] or 0.0, size[2] or 0.0, size[3] or 0
    if component * component * max(d, 1) >= MOST:
        raise ValueError("inner products beyond 56 bits")
    sample = points.select("vec", *KEY).orderBy(*KEY).limit(SAMPLE).toArrow()
    tree = Tree(matrix(sample["vec"].combine_chunks(), d) if len(sample) else np.zeros((0, d), np.int64), rows, most)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaf_of(tree.lift(matrix(batch.column("vec"), d)))))

    routed = materialize(points.mapInArrow(route, "k1 long, k2 long, label int, vec array<long>, ids array<long>, leaf int"), "gnat")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges of a task's rows, as rows of node, split point, child, least, greatest."""
        low = [np.full((len(n.pivots),) * 2, np.inf) for n in tree.nodes]
        high = [-x for x in low]
        for batch in batches:
            lifted = tree.lift(matrix(batch.column(0), d))
            squares = np.full(len(lifted), tree.square)
            for n, rows, of in tree.walk(lifted):
                distance = tree.distances(lifted[rows], squares[rows], tree.nodes[n])
                for k in np.unique(of):
                    low[n][:, k] = np.minimum(low[n][:, k], distance[of == k].min(0))
                    high[n][:, k] = np.maximum(high[n][:, k], distance[of == k].max(0))
        for n, (a, b) in enumerate(zip(low, high, strict=True)):
            p, c = np.nonzero(np.isfinite(a))
            yield pa.record_batch([pa.array(np.full(len(p), n, np.int32)), pa.array(p.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(a[p, c]), pa.array(b[p, c])], names=["node", "point", "child", "low", "high"])

    found = routed.select("vec").mapInArrow(ranges, "node int, point int, child int, low double, high double")
    for node in tree.nodes:
        # A child without rows has an empty range, which nothing meets.
        node.low = np.full((len(node.pivots),) * 2, np.inf)
        node.high = -node.low
    for r in found.groupBy("node", "point", "child").agg(F.min("low"), F.max("high")).collect():  # of the tree's size
        tree.nodes[r[0]].low[r[1], r[2]], tree.nodes[r[0]].high[r[1], r[2]] = r[3], r[4]
    held = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}  # a number a leaf
    tree.chunks = [-(-held.get(k, 0) // CHUNK) for k in range(max(tree.leaves, 1))]
    chunks = F.element_at(F.array(*[F.lit(max(c, 1)) for c in tree.chunks]), F.col("leaf") + 1)
    return tree, routed.withColumn("chunk", F.pmod("k1", chunks).cast("int")), component * component * max(d, 1) < 2**52


def gathered(best: DataFrame, item: Column, name: str) -> DataFrame:
    """Of each query the rows of best(), few, as an array in their order, written."""
    items = F.sort_array(F.collect_list(F.struct("n", "rank", item.alias("item"))))
    return materialize(best.groupBy(*KEY).agg(F.transform(items, lambda x: x["item"]).alias(name)), name)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """rows: id long, label int, vec array<long>. anchors: which rows are, a condition on id and label.
    For each anchor and each of its positives (the first rows of its label) the first rows of other
    labels whose score lies between least and most per cent of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    whole = rows.where("id is not null and label is not null and vec is not null and not exists(vec, v -> v is null)").select("id", F.col("label").cast("int").alias("label"), "vec")
    keyed = whole.withColumns({"k1": F.xxhash64("vec", "label"), "k2": F.xxhash64(F.lit(1), "label", "vec"), "anchor": F.coalesce(anchors, F.lit(False))})
    once = materialize(keyed.groupBy(*KEY, "label", "vec", "id").agg(F.max("anchor").alias("anchor")), "vectors")
    ids = positives + 1  # an anchor may be among them
    nth = F.row_number().over(Window.partitionBy(*KEY, "label", "vec").orderBy("id"))
    kept = once.drop("anchor").withColumn("nth", nth).where(F.col("nth") <= ids)
    points = materialize(kept.groupBy(*KEY, "label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    queries = materialize(once.where("anchor").select(*KEY, "label", "vec").distinct(), "queries")
    tree, placed, quick = built(points)

    friendly = Search(tree, placed, quick, True, ids)
    free = queries.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    bound = friendly.best(free, own_leaf=True).where(F.col("rank") == ids).select(*KEY, F.array("score").alias("bound"))
    bounded = free.join(bound, [*KEY], "left").withColumn("low", F.coalesce("bound", "low"))
    friends = gathered(friendly.best(bounded, own_leaf=False), F.struct("score", "id"), "friends")

    # A window for each positive; one without any has its ends the wrong way round.
    score = F.when(F.col("f.score") >= 0, F.col("f.score"))
    low, high = F.expr(f"({least} * f.score + 99) div 100"), F.expr(f"{most} * f.score div 100")
    of_each = friends.select(*KEY, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(ids - 1)), lambda k: F.get("friends", k))).alias("n", "f"))
    ends = of_each.select(*KEY, F.struct("n", F.when(score.isNotNull(), low).otherwise(MOST).alias("low"), F.when(score.isNotNull(), high).otherwise(LEAST).alias("high")).alias("w"))
    windows = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list("w")).alias("w")).select(*KEY, F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asked = materialize(queries.join(windows, [*KEY]), "windows")
    hostile = Search(tree, placed, quick, False, negatives)
    bound = hostile.best(asked, own_leaf=True).where(F.col("rank") == negatives).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("n", "score"))).alias("bound"))
    raised = F.transform("low", lambda x, n: F.greatest(x, F.element_at("bound", n)))
    bounded = asked.join(bound, [*KEY], "left").withColumn("low", F.when(F.col("bound").isNull(), F.col("low")).otherwise(raised))
    enemies = gathered(hostile.best(bounded, own_leaf=False), F.struct("n", "rank", "score", "id"), "enemies")

    found = friends.join(enemies, [*KEY])
    others = F.slice(F.filter(F.transform("friends", lambda x, n: F.struct(n.alias("n"), x["score"].alias("score"), x["id"].alias("id"))), lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    pairs = once.where("anchor").select(F.col("id").alias("anchor_id"), *KEY).distinct().join(found, [*KEY]).select("anchor_id", "enemies", F.explode(others).alias("p"))
    theirs = pairs.select("anchor_id", "p", F.explode(F.filter("enemies", lambda x: x["n"] == F.col("p.n"))).alias("e"))
    return theirs.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("e.rank").alias("rank"), F.col("e.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("e.score").alias("negative_score"),
    )
