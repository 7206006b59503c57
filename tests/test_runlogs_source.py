"""A log read in ranges equals the log read line by line."""

import random
import re
import tempfile

from titerloom.operators import loggrammar as G
from titerloom.sources import runlogs as L

HEAD = "2024-01-01 10:00:0{} INFO app.x "


def serial(data):
    text = data.decode("utf-8", "replace").removeprefix("\ufeff")
    out, at = [], len(data) - len(text.encode("utf-8", "replace")) if data.startswith(b"\xef\xbb\xbf") else 0
    at = 0
    for k, raw in enumerate(data.split(b"\n")):
        line = raw.decode("utf-8", "replace").removesuffix("\r")
        line = line.removeprefix("\ufeff") if k == 0 else line
        if re.match(G.HEADER, line, re.ASCII):
            out.append((at, line, []))
        elif out and not (at == len(data) and line == ""):
            out[-1][2].append(line)
        at += len(raw) + 1
    return out


def log(r, n):
    lines = []
    for k in range(n):
        lines.append(r.choice([HEAD.format(k % 10) + "x" * r.randrange(40) + "é", "  continued " + "y" * r.randrange(60), "", "漢字", HEAD.format(1)]))
    return r.choice([b"", b"\xef\xbb\xbf"]) + r.choice(["\n", "\r\n"]).join(lines).encode() + r.choice([b"", b"\n"])


def test_ranges_equal_one_read(monkeypatch):
    r = random.Random(1)
    for _ in range(60):
        data = log(r, r.randrange(0, 30))
        monkeypatch.setattr(L, "BLOCK", r.choice([1, 7, 50, 1 << 20]))
        for split in (1, 3, 17, 64, 10_000):
            got = [e for lo in range(0, len(data), split) for e in L.entries(lambda n, at: data[at : at + n], len(data), lo, min(lo + split, len(data)))]
            assert got == serial(data)


def test_source(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    r = random.Random(2)
    whole = {}
    for name in ("a.log", "b.log"):
        whole[name] = log(r, 400)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(whole[name])
    got = L.read_run_logs(spark, "file://" + folder, split=900)
    assert got.rdd.getNumPartitions() > 10
    rows = sorted((x["log"].rsplit("/", 1)[1], x["entry"], x["message"], x["continuation"]) for x in got.collect())
    want = sorted((n, at, re.match(G.HEADER, line, re.ASCII)[4], more) for n, d in whole.items() for at, line, more in serial(d))
    assert rows == want
    ev = L.read_run_logs(spark, "file://" + folder)
    assert G.events(ev).count() == 0
