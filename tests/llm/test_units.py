"""The parts of the operators that run inside tasks, against plain references."""

import random

import numpy as np
import pytest

from titerloom.llm import bpe, langid, ngram_bloom, simhash, surrogates, toxicity


@pytest.fixture(scope="module")
def encoder():
    from titerloom.llm.queries import tokenizer_path

    return bpe.Encoder(tokenizer_path())


def awkward_texts():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = ["", " ", "a" * 3000, "the" * 700, "İstanbul ΑΣ ΣΑΣ\x1c\x1d y\x85z <|startoftext|>Hi<|endoftext|> '<|endoftext|'ll don't 1234 ½²  日本語 🎉🎉 é ̀", "!!!!####$$$$---......" * 30]
    out += ["".join(r.choice(letters[: r.choice((2, 5, 26))]) for _ in range(r.randint(1, 400))) for _ in range(150)]
    out += ["".join(chr(r.choice((r.randint(32, 0x2FF), r.randint(0x370, 0x52F), r.randint(0x4E00, 0x4EFF), r.randint(0x1F300, 0x1F5FF)))) for _ in range(200)) for _ in range(60)]
    return out


def test_encoding_is_the_librarys(encoder):
    from tokenizers import Tokenizer

    from titerloom.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    for text in awkward_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == want
        assert bpe.digests(encoder, text)[0] == len(want)


def test_every_character_is_encoded_as_the_library_does(encoder):
    """Each code point once between others, rows of them at a time, and runs of marks."""
    from tokenizers import Tokenizer

    from titerloom.llm.queries import tokenizer_path

    library, r = Tokenizer.from_file(tokenizer_path()), random.Random(9)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)}" for c in points[i : i + 512]) for i in range(0, len(points), 512)]
    marks = [c for c in range(0x300, 0x11000) if __import__("unicodedata").combining(chr(c))]
    texts += ["".join(chr(r.choice(marks)) if r.random() < 0.6 else chr(r.choice((97, 0x391, 0x915, 0xAC00, 0x0D46, 0x1100, 0x0B47))) for _ in range(60)) for _ in range(300)] + ["a\u0d3c\u0301\u0316"]
    for text in texts:
        assert encoder.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_digests_are_of_ids_and_decoded_text(encoder):
    import hashlib

    from tokenizers import Tokenizer

    from titerloom.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    for text in [*awkward_texts()[:20], "word " + "ab" * 5000 + " end"]:
        ids = library.encode(text, add_special_tokens=False).ids
        n, a, b = bpe.digests(encoder, text)
        assert a == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert b == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(encoder, None) == bpe.digests(encoder, "")


def test_lookahead_bounds_what_is_held(encoder):
    t = encoder.transducer
    list(t.encode("".join(random.Random(1).choice("etaoin") for _ in range(20_000))))
    assert t.held <= bpe.CHECK + t.lookahead
    # (x, a) loses its a to (a, b), done before it: two links of tokens of two symbols.
    assert bpe.sufficient_lookahead([("a", "b"), ("x", "a")]) == 4
    assert bpe.sufficient_lookahead([("a", "b"), ("c", "ab")]) == 3


def test_decoding_state_machine(encoder):
    for text in ("hello world 12", "größe 日本 🎉", "x" * 200):
        d = bpe.Decoder(encoder.tokens, encoder.added)
        out = "".join(map(d.feed, encoder.ids(text))) + d.finish()
        assert out.replace(" ", "") == text.replace(" ", "")
    d = bpe.Decoder({0: encoder.letters[0xE2], 1: encoder.letters[0x41]}, {})
    assert d.feed(0) == "" and d.feed(1) == "�A"


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    r = random.Random(2)
    texts = [None, "", "  ", "A", "a B", "É a\x0bb", *(" ".join(r.choice(["x", "Yy", "zé"]) for _ in range(n)) for n in (3, 4, 50, 300, 1000))]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    f = base[rng.integers(0, 20, 260)]
    for k in range(len(f)):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            f[k] ^= np.uint64(1) << np.uint64(b)
    key = np.sort(rng.integers(0, 4, len(f)))
    row, root = simhash.links(key, f, radius)
    got = np.arange(len(f))
    got[row] = root
    want = list(range(len(f)))

    def top(a):
        while want[a] != a:
            a = want[a]
        return a

    for i in range(len(f)):
        for j in range(i):
            if key[i] == key[j] and bin(int(f[i]) ^ int(f[j])).count("1") <= radius:
                a, b = top(i), top(j)
                want[max(a, b)] = min(a, b)
    assert got.tolist() == [top(i) for i in range(len(f))]


def test_token_hashes_follow_words():
    texts = [None, "", "a b\x0ba", "É é", "  x "]
    rows = {i: [] for i in range(len(texts))}
    for first, _, row, tok, _ in ngram_bloom.tokens(texts):
        for i, t in zip(row, tok, strict=True):
            rows[first + i].append(int(t))
    assert [len(rows[i]) for i in range(5)] == [1, 1, 4, 3, 2]
    assert rows[2][0] == rows[2][2] != rows[2][1] and rows[3][0] != rows[3][1] and rows[0] == rows[1] == [int(ngram_bloom.END)]


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    c = rng.integers(1, 1000, len(h))
    a, b = ngram_bloom.unpacked(ngram_bloom.packed(h, c))
    assert (a == h).all() and (b == c).all()


def test_filter_never_loses_a_level():
    import pandas as pd

    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 58, 5000, dtype=np.uint64))  # range 0 of 32
    c = rng.integers(1, 300, len(h))
    block = ngram_bloom._merge_range((2, 0), pd.DataFrame({"blob": [ngram_bloom.packed(h, c)]}))
    model = ngram_bloom.Model(ngram_bloom.gathered([(2, 0, len(h), block["blob"][0])]), 5, 1, 1, 1)
    assert (model.levels(h) >= ngram_bloom.level(c)).all()
    assert (model.levels(h) == ngram_bloom.level(c)).mean() > 0.9
    strange = np.unique(rng.integers(0, 1 << 58, 5000, dtype=np.uint64))
    assert (model.levels(strange) > 0).mean() < 0.1


def test_probabilities_add_up_to_one_at_most():
    """Over all words and one unknown, after words with many and few followers."""
    import pandas as pd

    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghijklmnopqrst") * r.choice((1, 2)) for _ in range(300)) for _ in range(40)] + ["v " + "abcdefghijklmnopqrst"[i % 20] for i in range(40)]
    toks, befores = (np.concatenate(x) for x in zip(*[(t, b) for _, _, _, t, b in ngram_bloom.tokens(texts)], strict=True))
    one, two = (np.unique(x, return_counts=True) for x in (toks, ngram_bloom.pair_hash(befores, toks)))
    blocks = [(k, 0, *ngram_bloom._merge_range((k, 0), pd.DataFrame({"blob": [ngram_bloom.packed(*x)]})).loc[0, ["n", "blob"]]) for k, x in ((1, one), (2, two))]
    model = ngram_bloom.Model(ngram_bloom.gathered(blocks), 0, len(toks), len(one[0]), len(texts))
    words = np.concatenate((one[0], np.array([12345], np.uint64)))
    count = model.counts(words)
    assert (count[:-1] == one[1]).all()
    for v, c in zip(words, count, strict=True):
        pair = ngram_bloom.level_count(model.levels(ngram_bloom.pair_hash(np.full_like(words, v), words)))
        flat, full = model.log10(count, np.full_like(count, c), pair)
        assert (10.0**flat).sum() <= 1 + 1e-9 and 0.5 < (10.0**full).sum() <= 1 + 1e-9


def test_long_texts_are_hashed_alike_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice(("a", "bc", "def" * 40, "x" * 900)) for _ in range(2000)) + "  "
    whole = [x.copy() for x in ngram_bloom._hashed(text.encode())]
    monkeypatch.setattr(ngram_bloom, "SLAB", 512)
    ngram_bloom._tables.clear()
    for a, b in zip(whole, ngram_bloom._hashed(text.encode()), strict=True):
        assert (a == b).all()


def test_surrogates_keep_format_and_distinctness():
    key = b"k"
    text = "Mail Ann.Lee42@mail8.example.com, +1 (988) 555-2485 or 988-555-2485, 10.2.3.4. Mrs Anna SMITH-Lee met Dr. Smith, SMITH and Anna. г-жа Иванова. 4111 1111 1111 1111; password=e3b3ed3cc8548923d6"
    out, n = surrogates.rewritten(text, key, {})
    assert n == len(surrogates.find(text)) == 12
    for start, end, _ in surrogates.find(text):
        assert text[start:end] not in out
    assert out == surrogates.rewritten(text, key, {})[0] != surrogates.rewritten(text, b"other", {})[0]
    assert len(out) >= len(text) - 8 and "Mrs " in out and "г-жа " in out and "password=" in out
    card = "".join(c for c in out.split("; pass")[0][-19:] if c.isdigit())
    assert int(card[-1]) == surrogates._luhn(card[:-1])
    assert len({surrogates.surrogate("ssn", f"{i:09d}", key) for i in range(3000)}) == 3000
    assert len({surrogates.surrogate("name", a + b + "a", key) for a in "bcdfgh" for b in "aeiou"}) == 30
    assert all(surrogates.surrogate("name", w, key)[-1] == w[-1] for w in ("anna", "marko", "иванова"))
    assert surrogates.surrogate("ip", "10.1.2.3", key).startswith("10.")
    assert surrogates.rewritten(None, key, {}) == (None, 0) and surrogates.rewritten("clean text.", key, {}) == ("clean text.", 0)


def test_label_model_finds_the_class():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.2
    fired = np.stack([(rng.random(2000) < np.where(y, 0.7, 0.02)) for _ in range(5)] + [(rng.random(2000) < 0.3)], axis=1)
    fired = np.hstack((fired, fired[:, :1]))  # a copy of a voter
    noisy = y ^ (rng.random(2000) < 0.1)
    post, model = toxicity.label_model(fired, noisy.astype(float))
    assert ((post > 0.5) == y).mean() > 0.97
    assert model["weight"][0] < model["weight"][1]  # correlated voters count less


def test_windows_cover_the_whole_text():
    text = "ä" * 1000
    assert langid.windows(text).size >= 2000 and bytes(langid.windows(text).ravel()[:2000]) == text.encode()
    assert langid.windows("").shape == (1, langid.WINDOW)
