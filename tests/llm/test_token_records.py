"""Records written and read back, against the tokenizers library."""

import os
import random
import sys
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerloom.llm import token_records as R
from titerloom.llm.queries import BYTE_TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-") + "/records"


def texts():
    r = random.Random(7)
    odd = [chr(c) for c in (*range(0x00, 0x30), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x1F600, 0x301, 0x660)]
    out = ["", " ", "\n", "  a  b\n\n c ", "don't 's  'll x'\n've", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", " <|endo ftext|>", "a" * 700 + " " + "b" * 300]
    out += ["".join(r.choice([*odd, "a", "B", "é", "7", "'s", " ", " ", "\n", "漢", "."]) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    return out


def test_ids_equal_the_library(library, monkeypatch):
    enc = R.Encoder(tokenizer_path(BYTE_TOKENIZER))
    for at_once, memo in ((1 << 16, 400_000), (7, 50)):
        monkeypatch.setattr(R, "AT_ONCE", at_once)
        monkeypatch.setattr(R, "MEMO", memo)
        for t in texts()[:: 1 if at_once > 7 else 7]:
            assert np.frombuffer(enc.encode(t), enc.type).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    every = " ".join(chr(c) for c in range(sys.maxunicode) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(enc.encode(every), enc.type).tolist() == library.encode(every, add_special_tokens=False).ids


def rows_of(library, docs):
    """Brute force: rows in order of doc_id, nulls first."""
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path, **options):
    return R.read_records(spark, path, **options).select("doc_id", "start", "n_tokens", F.crc32("ids"))


def test_round_trip(spark, library):
    docs = [(i * 7 % 1000 - 300, t) for i, t in enumerate(texts()[:1000])] + [(None, "no id"), (2000, None), (2001, "x " * 60_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as ids", "'s' as source", "3 as width").repartition(5)
    path = folder()
    R.write_records(frame, path, tokenizer_path(BYTE_TOKENIZER), 0)
    want = rows_of(library, docs)
    assert [tuple(r) for r in read(spark, path).collect()] == want
    shuffled = [tuple(r) for r in read(spark, path, seed=5).collect()]
    assert shuffled != want and sorted(shuffled, key=lambda r: r[1]) == want
    assert shuffled == [tuple(r) for r in read(spark, path, seed=5).collect()]
    one = R.read_records(spark, path).where("doc_id = 2000 or doc_id = 1").select(R.ids_of().alias("ids")).collect()
    assert sorted(r["ids"] for r in one) == sorted([[0], [*library.encode(dict(docs)[1], add_special_tokens=False).ids, 0]])
    with pytest.raises(Exception, match="already"):
        R.write_records(frame, path, tokenizer_path(BYTE_TOKENIZER), 0)


def test_repeats_and_nothing(spark, library):
    docs = [(5, "same text")] * 40 + [(5, "other")] * 3
    path = folder()
    R.write_records(spark.createDataFrame(docs, "doc_id long, text string"), path, tokenizer_path(BYTE_TOKENIZER), 0)
    got = [tuple(r) for r in read(spark, path).collect()]
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got[:-1]]])) and sorted(r[3] for r in got) == sorted(r[3] for r in rows_of(library, docs))
    path = folder()
    R.write_records(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path(BYTE_TOKENIZER), 0)
    assert read(spark, path).count() == 0


def test_small_ranges(spark, library, monkeypatch):
    docs = [(i, f"word{i} " * (i % 9)) for i in range(200)]
    path = folder()
    R.write_records(spark.createDataFrame(docs, "doc_id long, text string"), path, tokenizer_path(BYTE_TOKENIZER), 0)
    monkeypatch.setattr(R, "PER_TASK", 500)
    monkeypatch.setattr(R, "PER_BATCH", 90)
    for seed in (None, 3):
        reader = R.Reader(path, seed)
        parts = reader.partitions()
        assert len(parts) > 10
        rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(d, s, n, zlib.crc32(i)) for d, s, n, i in sorted(rows, key=lambda r: r[1])] == rows_of(library, docs)


def test_damage_is_found(spark):
    path = folder()
    R.write_records(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), path, tokenizer_path(BYTE_TOKENIZER), 0)
    local = path.removeprefix("file://")
    name = next(f for f in os.listdir(local) if f.endswith(".rec"))
    whole = open(f"{local}/{name}", "rb").read()
    for at in (0, 9, 14, len(whole) - 1):
        with open(f"{local}/{name}", "wb") as f:
            f.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception, match="damaged"):
            read(spark, path).collect()
