"""Op 8: language identification by a byte convolutional network.

Texts are cut into windows of WINDOW bytes. Filters of several widths run over a
window's bytes, each filter's greatest response is taken, and a softmax layer
turns these into language probabilities; a text's are the mean over its windows.
On one-hot bytes a filter is a sum of table look-ups, one for each of its taps.

Trained in numpy on labelled text: up to PER_LANG rows a language, chosen by a hash of
id and text, and up to PER_TEXT windows of each, spread over the whole text, so the sample
is bounded. Scoring is one pass over the table, whole texts, without a shuffle.

Defined cases: null text, or one without a letter, is ``und`` with score 0; so is
every text where no row is labelled; a short window is padded with zero bytes;
null lang is not learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titerloom.llm.common import bounded_broadcast, id_crc, join_rows, materialize, text_hash

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_LANG = 500
PER_TEXT = 4
#: The sample is drawn this much too large, as the languages' sizes are estimated, and then cut; it is read in so many parts.
MARGIN, PARTS = 1.3, 32
MAX_BROADCAST = 200_000
SLAB = 256  # windows scored at once
LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> np.ndarray:
    """The text's UTF-8 bytes by rows of WINDOW, zero-padded."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.ravel()[: len(raw)] = raw
    return out


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest response of each filter in each window, and where."""
        best, places = [], []
        for taps in self.taps:
            n = x.shape[1] - len(taps) + 1
            r = np.take(taps[0], x[:, :n], axis=0)
            for k in range(1, len(taps)):
                r += np.take(taps[k], x[:, k : k + n], axis=0)
            at = r.argmax(axis=1)
            best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
            places.append(at)
        return np.hstack(best), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        best = []
        for taps in self.taps:
            n = x.shape[1] - len(taps) + 1
            r = np.take(taps[0], x[:, :n], axis=0)
            for k in range(1, len(taps)):
                r += np.take(taps[k], x[:, k : k + n], axis=0)
            best.append(r.max(axis=1))
        z = np.tanh(np.hstack(best)) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross-entropy, languages weighted alike."""
        rng = np.random.default_rng(seed)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.langs)), 1) / len(self.langs)).astype(np.float32)
        params = [*self.taps, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                best, places = self.pooled(xb)
                h = np.tanh(best)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= weight[yb][:, None] / len(yb)
                back = (p @ self.out.T) * (1 - h * h)
                grads = [np.zeros_like(q) for q in self.taps] + [h.T @ p, p.sum(0)]
                for i, taps in enumerate(self.taps):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(len(taps)):
                        byte = xb[np.arange(len(yb))[:, None], places[i] + k]
                        np.add.at(grads[i][k], (byte, np.arange(FILTERS)[None, :]), g)
                t += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text):
            return "und", 0.0
        x = windows(text)
        total = np.zeros(len(self.langs))
        for at in range(0, len(x), SLAB):
            part = x[at : at + SLAB]
            size = (part != 0).sum(axis=1)
            total += size @ self.probabilities(part)
        total /= max(total.sum(), 1e-12)
        best = int(total.argmax())
        return self.langs[best], float(total[best])


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            if text and LETTER.search(text):
                x = windows(text)
                for i in np.unique(np.linspace(0, len(x) - 1, PER_TEXT).astype(int)):
                    rows.append((x[i].tobytes(), lang))
        yield pd.DataFrame(rows, columns=["x", "lang"])


def training_rows(docs: DataFrame, held_out: Column, per_lang: int) -> DataFrame | None:
    """text, lang of rows that aren't held out, equal rows once; of more than per_lang of a
    language those of the least hash of id and text, so that rows of one id, or without, are
    chosen each on its own."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out).select("doc_id", text_hash().alias("thash"), "text", "lang")
    keys = rows.select("doc_id", "thash", "lang", F.xxhash64("doc_id", "thash", F.lit(8)).alias("at"))
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(min(1.0, (MARGIN * per_lang + 100) / max(n, 1)) * 1_000_000) + 1)])
    near = keys.where(F.pmod(F.xxhash64("at"), F.lit(1_000_000)) < share[F.col("lang")]).distinct()
    first = Window.partitionBy("lang").orderBy("at", F.col("doc_id").asc_nulls_first(), "thash")
    chosen = near.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_lang)
    chosen = materialize(chosen.select("thash", "doc_id", F.col("lang").alias("__lang")), "chosen")
    train = join_rows(rows, bounded_broadcast(chosen, MAX_BROADCAST)).where("lang = __lang")
    return train.dropDuplicates(["doc_id", "thash", "lang"]).repartition(PARTS, "doc_id", "thash").select("text", "lang")


def train_network(docs: DataFrame, held_out: Column, per_lang: int = PER_LANG) -> Network | None:
    chosen = training_rows(docs, held_out, per_lang)
    if chosen is None:
        return None
    rows = chosen.mapInPandas(_sampled, "x binary, lang string").toPandas().sort_values(["lang", "x"], ignore_index=True)
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    net = Network(langs)
    net.train(np.stack([np.frombuffer(b, np.uint8) for b in rows["x"]]), np.searchsorted(np.array(langs), rows["lang"].to_numpy()))
    return net


def identify(docs: DataFrame, held_out: Column, per_lang: int = PER_LANG) -> DataFrame:
    """All columns of docs with lang_pred and score in place of any of those names."""
    net = train_network(docs, held_out, per_lang)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "__r")]

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([net.predict(t) if net else ("und", 0.0) for t in batch], columns=["lang_pred", "score"])

    return docs.select(*kept, run("text").alias("__r")).select(*kept, "__r.lang_pred", "__r.score")


def held_out_rows(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 4 == 2
