"""What training holds in the driver: little beside the counts that aren't zero."""

import tracemalloc

import numpy as np
import pandas as pd

from titerloom.llm import toxicity


def _most(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_training_rows_come_as_counts_and_give_the_same_vectors():
    v = toxicity.Voters(["bad", "vile*", "awful"])
    texts = ["bad bad VILENESS here!!", "", None, "nothing of that kind", "AWFUL THINGS awful", *(f"word {i} bad" for i in range(3000))]
    x = toxicity.TrainingRows(pd.DataFrame([v.row(t) for t in texts], columns=["n", "at", "times"]), len(v.names))
    whole = np.stack([v.vector(t) for t in texts])
    assert x.shape == whole.shape and len(toxicity.slices(x)) == 2
    assert all(np.array_equal(x[part], whole[part]) for part in toxicity.slices(x))
    assert np.array_equal(x.fired(), whole[:, : len(v.names)] > 0)
    y = np.arange(len(texts)) % 2 * 1.0
    assert np.allclose(toxicity.fit_linear(x, y), toxicity.fit_linear(whole, y))
    assert len(v.row("nothing of that kind")[1]) == 0


def test_training_takes_slices_of_rows_only():
    rng = np.random.default_rng(5)
    n, voters = 20_000, 203
    y = rng.random(n) < 0.5
    fired = rng.random((n, voters)) < np.where(y, 0.3, 0.1)[:, None]
    assert _most(lambda: toxicity.label_model(fired, y * 1.0, rounds=4)) < 30  # all rows as numbers: 16 or 32 MB each time
