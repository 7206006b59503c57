"""The language model's scores where its counts are too large to broadcast."""

import numpy as np
import pytest

from titerloom.llm import ngram_bloom as N


def test_values_packed():
    c = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert (N.unpacked_values(N.packed_values(c)) == c).all() and len(N.unpacked_values(N.packed_values(c[:0]))) == 0


def test_no_row_for_each_token(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(400))) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[3][1]), (None, None), ((1 << 60) + 1, "A b"), ((1 << 60) + 1, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where(~N.held_out_rows())
    written = []
    plain = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: (out := plain(df, name), written.append((name, out.count())))[0])
    monkeypatch.setattr(N, "CHUNK_TEXT", 16_000)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
    whole, joined = (sorted(N.score_language_model(docs, train, max_broadcast=m).collect(), key=key) for m in (N.MAX_BROADCAST, 0))
    assert len(joined) == len(rows)
    for a, b in zip(whole, joined, strict=True):
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["doc_id"], b["n_tokens"], b["n_known"], b["train_tokens"])
        assert b["base_score"] == pytest.approx(a["base_score"]) and b["score"] == pytest.approx(a["score"])
    # At most a block for each chunk, kind and range; there are 17,205 tokens.
    assert max(n for _, n in written) < 2000, written
