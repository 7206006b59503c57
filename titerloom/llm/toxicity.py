"""Op 6: toxicity by weak supervision.

Voters: words and word beginnings (lexicon) that labelled training rows show more
often in one class, and a few fixed patterns. A voter fires on a text or not.
Label model: two latent classes; EM estimates how often each voter fires in each
class (its accuracy), starting from the labels of the training rows. Correlations
between voters given the class are then estimated, and each voter's evidence is
divided by how many others it moves with, so that one family of words is not
counted many times. Classifier: logistic regression on the voters' firings and
counts, fitted to the label model's posteriors, scores whole texts.

Training reads a bounded sample: at most MAX_TRAIN labelled rows, chosen by a hash
of id and text, and at most VOTERS voters; the driver gets the voters that fire on each row
and how often, never whole vectors. Scoring reads every text in one pass over
the table without a shuffle.

Defined cases: null or empty text fires no voter and is scored like any text
without one; without labelled rows of both classes every score is 0; null toxic
or doc_id in labels is ignored; several labels of one id train with each, equal ones once; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import give_back, id_crc, materialize, releasing, small_batches, text_hash

MAX_TRAIN = 20_000
VOTERS = 200
#: The sample is drawn this much too large, as its table's size is estimated, and then cut; it is read in so many parts.
MARGIN, PARTS = 1.3, 32
#: Lengths of the word beginnings that stand as voters, marked by a star.
STEMS = (4, 5)
MIN_SUPPORT = 8
#: Rows at once in the sums over training rows, to hold no copies of them all.
STEP = 2048
WORD = re.compile(r"[^\W\d_]+")
#: Fixed pattern voters.
PATTERNS = {"!many": re.compile(r"!{2,}"), "!shout": re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b"), "!symbols": re.compile(r"[#*$%&|<>]{3,}")}


def _tokens(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for k in STEMS for w in words if len(w) > k}


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's counts by feature: rows with it, by class."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            for f in _tokens(text or ""):
                counts.setdefault(f, [0, 0])[int(toxic)] += 1
    if counts:
        yield pd.DataFrame({"feature": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int) -> DataFrame:
    """text, toxic of the labelled rows that aren't held out, equal rows once; of more than max_rows
    those of the least hash of id and text, so that rows of one id are chosen each on its own."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    rows = docs.where("doc_id is not null").select("doc_id", text_hash().alias("thash"), "text")
    keys = rows.select("doc_id", "thash", F.xxhash64("doc_id", "thash").alias("at")).join(known, "doc_id")
    n = keys.agg(F.approx_count_distinct(F.struct("at", "toxic"))).first()[0]
    share = int(min(1.0, (MARGIN * max_rows + 100) / max(n, 1)) * 1_000_000)
    near = keys.where(F.pmod(F.xxhash64("at"), F.lit(1_000_000)) < share).distinct()
    # At most max_rows narrow rows: bounded whatever the table's size or its most frequent id.
    chosen = materialize(near.orderBy("at", "doc_id", "thash", "toxic").limit(max_rows).select("doc_id", "thash", "toxic"), "chosen")
    train = rows.join(F.broadcast(chosen), ["doc_id", "thash"]).dropDuplicates(["doc_id", "thash", "toxic"])
    return materialize(train.repartition(PARTS, "doc_id", "thash").select("text", "toxic"), "training")


def choose_voters(train: DataFrame, voters: int) -> list[str]:
    total = train.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in total}
    if len(n) < 2:
        return []
    counts = train.mapInPandas(releasing(_features), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log(((F.col("toxic") + 0.5) / (n[1] + 1.0)) / ((F.col("clean") + 0.5) / (n[0] + 1.0)))
    strong = counts.where(F.col("toxic") + F.col("clean") >= MIN_SUPPORT).withColumn("odds", odds).where("odds > 1.5")
    # Support and strength together; ties by name.
    return [r["feature"] for r in strong.orderBy(F.desc(F.col("toxic") * F.col("odds")), "feature").limit(voters).collect()]


class Voters:
    """What fires on a text."""

    def __init__(self, names: list[str]):
        self.names = [*names, *PATTERNS]
        self.at = {n: i for i, n in enumerate(self.names)}
        self.words = {n: i for n, i in self.at.items() if n[-1] != "*" and n[0] != "!"}
        self.stems = {n[:-1]: i for n, i in self.at.items() if n[-1] == "*"}

    def count(self, text: str | None) -> tuple[np.ndarray, int]:
        out = np.zeros(len(self.names), np.float32)
        if not text:
            return out, 0
        words = WORD.findall(text.lower())
        distinct: dict[str, int] = {}
        for w in words:
            distinct[w] = distinct.get(w, 0) + 1
        for w in self.words.keys() & distinct.keys():
            out[self.words[w]] += distinct[w]
        stems = self.stems
        for k in STEMS:
            for w, n in distinct.items():
                if (i := stems.get(w[:k])) is not None and len(w) > k:
                    out[i] += n
        for name, pattern in PATTERNS.items():
            out[self.at[name]] = pattern.search(text) is not None
        return out, len(words)

    def vector(self, text: str | None) -> np.ndarray:
        count, n = self.count(text)
        return vectors_of(count, np.float32(n))

    def row(self, text: str | None) -> tuple[int, bytes, bytes]:
        """What vector() is made of: the number of words, and which voters fire how often."""
        count, n = self.count(text)
        at = np.flatnonzero(count)
        return n, at.astype(np.uint32).tobytes(), count[at].tobytes()


def vectors_of(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Along the last axis: firings, then counts on a log scale, then the share of words that lexicon voters hit."""
    lexicon = count[..., : count.shape[-1] - len(PATTERNS)].sum(-1, keepdims=True)
    return np.concatenate((count > 0, np.log1p(count), np.log1p(lexicon), lexicon / np.maximum(n, np.float32(1))), axis=-1).astype(np.float32)


class TrainingRows:
    """Vectors kept as the counts that Voters.row() gives, of which a text has few; a slice is made when asked for."""

    def __init__(self, rows: pd.DataFrame, voters: int):
        self.n = rows["n"].to_numpy(np.float32)
        self.ends = np.concatenate(([0], np.cumsum(rows["at"].map(len).to_numpy() // 4)))
        self.at = np.frombuffer(b"".join(rows["at"]), np.uint32)
        self.times = np.frombuffer(b"".join(rows["times"]), np.float32)
        self.shape = len(rows), 2 * voters + 2

    def __len__(self) -> int:
        return self.shape[0]

    def counts(self, part: slice) -> np.ndarray:
        ends = self.ends[part.start : min(part.stop, len(self)) + 1]
        out = np.zeros((len(ends) - 1, self.shape[1] // 2 - 1), np.float32)
        out[np.repeat(np.arange(len(out)), np.diff(ends)), self.at[ends[0] : ends[-1]]] = self.times[ends[0] : ends[-1]]
        return out

    def __getitem__(self, part: slice) -> np.ndarray:
        return vectors_of(self.counts(part), self.n[part, None])

    def fired(self) -> np.ndarray:
        return np.concatenate([self.counts(part) > 0 for part in slices(self)])


def slices(rows: np.ndarray | TrainingRows) -> list[slice]:
    return [slice(at, at + STEP) for at in range(0, len(rows), STEP)]


def label_model(fired: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of firings. start: first guess at it (the labels)."""
    post = 0.9 * start + 0.05
    weight, part_of = np.ones(fired.shape[1]), lambda part: fired[part].astype(np.float64)
    for k in range(rounds):
        m1, m0 = post.sum(), (1 - post).sum()
        p1, p0 = ((sum(p[part] @ part_of(part) for part in slices(fired)) + 0.5) / (m + 1) for p, m in ((post, m1), (1 - post, m0)))
        prior = m1 / len(fired)
        if k == 2:  # correlations given the class, once accuracies are about right
            together = np.zeros((len(weight), len(weight)))
            for part in slices(fired):
                p = post[part]
                mean = np.outer(p, p1) + np.outer(1 - p, p0)
                r = (part_of(part) - mean) / np.sqrt(np.maximum(mean * (1 - mean), 1e-6))
                together += r.T @ r
            weight = 1 / np.maximum((np.clip(together / len(fired), 0, 1) * (1 - np.eye(len(weight)))).sum(0) + 1, 1)
        yes, no = np.log(p1 / p0) * weight, np.log((1 - p1) / (1 - p0)) * weight
        says = np.concatenate([(x := part_of(part)) @ yes + (1 - x) @ no for part in slices(fired)])
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + says, -30, 30)))
    return post, {"fires_toxic": p1, "fires_clean": p0, "weight": weight, "prior": prior}


def fit_linear(x: np.ndarray | TrainingRows, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the bias."""
    k = x.shape[1] + 1
    w, keep = np.zeros(k), np.full(k, ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        bend, slope = np.diag(keep), -keep * w
        for at in slices(x):
            part = np.hstack((x[at].astype(np.float64), np.ones((len(y[at]), 1))))
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            bend += (part * (p * (1 - p))[:, None]).T @ part
            slope += part.T @ (y[at] - p)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_model(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = MAX_TRAIN, voters: int = VOTERS) -> tuple[list[str], np.ndarray] | None:
    train = training_rows(docs, labels, held_out, max_rows)
    names = choose_voters(train, voters)
    if not names:
        return None

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Voters(names)
        for batch in batches:
            yield pd.DataFrame([v.row(t) for t in batch["text"]], columns=["n", "at", "times"]).assign(toxic=batch["toxic"].to_numpy())

    rows = train.mapInPandas(releasing(counted), "n long, at binary, times binary, toxic int").toPandas()
    # Rows come in no fixed order: sorted, sums round alike each time.
    rows = rows.sort_values(["at", "times", "n", "toxic"], ignore_index=True)
    x, y = TrainingRows(rows, len(names) + len(PATTERNS)), rows["toxic"].to_numpy(np.float64)
    posterior, _ = label_model(x.fired(), y)
    weights = fit_linear(x, posterior)
    del rows, x
    give_back()
    return names, weights


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """All columns of docs with toxicity (0 to 1) and toxic (0, 1) in place of any of those names."""
    small_batches(docs.sparkSession)
    model = train_model(docs, labels, held_out, max_rows)
    kept = [c for c in docs.columns if c.lower() not in ("toxicity", "toxic")]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("toxicity"), F.lit(0).alias("toxic"))
    names, weights = model

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Voters(names)
        yield from releasing(lambda batches: (pd.Series([float(1 / (1 + np.exp(-np.clip(v.vector(t) @ weights[:-1] + weights[-1], -30, 30)))) for t in batch], dtype="float64") for batch in batches))(texts)

    scored = docs.select(*kept, score("text").alias("toxicity"))
    return scored.withColumn("toxic", (F.col("toxicity") >= threshold).cast("int"))


def held_out_rows(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 5 == 0
