"""The pipeline's near-duplicates against all pairs."""

import random

import numpy as np

import corpus_pipeline
from titerloom.llm import shingle_sets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "ke", "li", "mo") for b in ("dan", "fel", "gor") for c in "aeiou"]


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    r, rows = random.Random(5), []
    common = " ".join(r.choice(WORDS) for _ in range(40))
    for base in range(12):
        words = [r.choice(WORDS) for _ in range(r.choice((7, 30, 90, 300)))]
        for edits in (0, 0, 1, 2, 3, 4, 6):
            copy = list(words)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            rows.append(" ".join(copy) + (" " + common if base % 3 == 0 else ""))
    return [*rows, None, "", " \t", "a b", "A  B", "a c"]


def brute_components(texts):
    sets, root = [brute(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= len(a | b) * 4 and root[i] != root[j]:
                keep, gone = min(root[i], root[j]), max(root[i], root[j])
                root = [keep if x == gone else x for x in root]
    return root


def check(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want = set(brute_components(texts))
    left = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {r["doc_id"] for r in left} == want and len(left) == len(want)
    return want


def test_stage_finds_every_similar_pair(spark):
    texts = corpus()
    want = check(spark, texts)
    # Some of them are beyond SimHash's radius.
    fps = [simhash.fingerprint(t) for t in texts]
    far = [i for i in range(1, len(texts)) if i not in want and all((fps[i] ^ f).bit_count() > simhash.RADIUS for j, f in enumerate(fps) if j != i)]
    assert far and 20 < len(want) < len(texts) - 20


def test_leaders_then_pairs(spark, monkeypatch):
    """With shuffled sets, and with one turn of leaders before all pairs that are left."""
    monkeypatch.setattr(shingle_sets, "SET_BYTES", 0)
    monkeypatch.setattr(shingle_sets, "MAX_BROADCAST", 0)
    monkeypatch.setattr(shingle_sets, "TURNS", 1)
    check(spark, corpus())


def test_bands_find_similar_sets():
    r, missed = random.Random(3), 0
    for _ in range(400):
        both = {r.getrandbits(63) for _ in range(80)}
        a, b = (np.array(sorted(both | {r.getrandbits(63) for _ in range(10)}), np.int64) for _ in "ab")
        missed += not (shingle_sets.band_keys(a) == shingle_sets.band_keys(b)).any()
        far = (simhash.bit_majority([a.view(np.uint64)]) ^ simhash.bit_majority([b.view(np.uint64)])).bit_count()
        assert far <= shingle_sets.FAR
    assert missed <= 2
    strange = [shingle_sets.band_keys(np.array(sorted(r.getrandbits(63) for _ in range(50)), np.int64)) for _ in range(300)]
    assert len(set(np.concatenate(strange).tolist())) == 300 * shingle_sets.BANDS
    assert not len(shingle_sets.band_keys(np.zeros(0, np.int64)))


def test_sets_are_of_whole_texts():
    r = random.Random(1)
    for n in (0, 1, 4, 5, 6, 500):
        text = " ".join(r.choice(WORDS) for _ in range(n))
        assert len(shingle_sets.shingles(text)) == len(brute(text))


def test_sketches_differ_in_no_more_bits_than_sets():
    r = random.Random(7)
    for n in (1, 20, 300, 4000):
        both = {r.getrandbits(63) for _ in range(n)}
        for more in (0, 1, 9, n // 5):
            a, b = (np.array(sorted(both | {r.getrandbits(63) for _ in range(k)}), np.int64) for k in (0, more))
            differ = sum((int(x) ^ int(y)).bit_count() for x, y in zip(shingle_sets.sketch(a).view(np.uint64), shingle_sets.sketch(b).view(np.uint64), strict=True))
            assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_large_group_of_near_copies_is_not_paired_off(spark, monkeypatch):
    """Neither a table of pairs nor one of posted rows grows with the group's square."""
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(60)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(r.choice((1, 1, 2, 3))):
            copy[r.randrange(len(copy))] = r.choice(WORDS) + r.choice(WORDS)
        texts.append(" ".join(copy))
    written, plain = {}, shingle_sets.materialize

    def seen(df, name):
        out = plain(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(shingle_sets, "materialize", seen)
    want = check(spark, texts)
    assert len(want) < 300
    assert written["pairs"] < 4 * len(texts) and "met" not in written and "open" not in written
