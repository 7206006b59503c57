"""Chunks between white space are looked up whole; short pieces go through the transducer in one go."""

import random

from titerloom.llm import bpe
from titerloom.llm.queries import tokenizer_path


def test_short_pieces_are_as_streamed(monkeypatch):
    enc, r = bpe.Encoder(tokenizer_path()), random.Random(4)
    pieces = ["".join(r.choice("etaoinshrdlu'é.,") for _ in range(r.randrange(1, 40))) for _ in range(400)]
    short = [enc.transducer.encode_short(enc.symbols(p)) for p in pieces]
    monkeypatch.setattr(bpe, "CHECK", 4)
    assert short == [list(enc.transducer.encode(enc.symbols(p))) for p in pieces]


def test_a_chunk_met_before_is_looked_up(monkeypatch):
    from tokenizers import Tokenizer

    enc, library = bpe.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["It's the end, of the end. of", "a\x1cb \x85 c\xa0d e \x1f", "é'll go\x0bto 　x" + "y" * 300 + ".z", " " + "w" * 255 + "! ok", " \t\n", "5,000 can't 12"]
    for memo in (bpe.MEMO, 2):
        monkeypatch.setattr(bpe, "MEMO", memo)
        for text in texts * 2:
            assert enc.ids(text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "MEMO", 100)
    assert "end," in enc.known or "end," in enc.older or enc.ids("end,") and "end," in enc.known
    cut = []
    monkeypatch.setattr(enc, "ascii_pieces", type("P", (), {"findall": lambda _, c: cut.append(c), "finditer": lambda _, c: cut.append(c)})())
    assert enc.ids("end, end,") == library.encode("end, end,", add_special_tokens=False).ids and not cut
