"""Whole operators on small tables with nulls, empty and repeated rows and clashing columns."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from titerloom.llm import bpe, decontaminate, graph, langid, line_dedup, ngram_bloom, outliers, sharding, simhash, surrogates, toxicity
from titerloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i), "en", f"s{i % 4}", 1) for i in range(12)]
    rows += [(12, None, None, None, None), (13, "", "en", "s1", 0), (None, prose(99), "en", "s2", 1), (3, prose(3), "en", "s3", 1), (3, prose(3), "en", "s3", 1), (14, "x " * 9000, "de", "s0", 1), (15, " \t\x0b", "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit("own")).withColumn("score", F.lit(1)).withColumn("fp", F.lit(1)).withColumn("words", F.lit(2)).withColumn("size", F.lit(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shards(spark, docs, empty):
    got = sharding.rendezvous_shards(docs, [1.0, 2.0, 1.0]).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    of = {r["doc_id"]: r for r in got}
    assert of[12]["size"] == 1 and of[12]["text_crc32"] == 0 and of[0]["text_crc32"] == zlib.crc32(prose(0).encode())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert sharding.rendezvous_shards(empty, [1.0, 1.0]).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.rendezvous_shards(many, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 2.6 < n[1] / n[0] < 3.4
    same = spark.range(25_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("text"))
    r = sharding.rendezvous_shards(same, [1.0] * 4).agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()
    assert tuple(r) == (0, 24_999, 25_000)


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_statistics(spark):
    texts = [None, "", "a\na\n\n \n \nb a", prose(1) + " " + prose(2) + " " + prose(1), "the " * 40, "é#*|<> ß\x0b\x0c$", prose(5, 8) + " " + prose(5, 8), prose(7, 300)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in outliers.count_statistics(df).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_quality_rejects_junk_only(spark, docs, empty):
    rows = [(i, prose(i, 40 + i % 60), "en" if i % 3 else None, "big", 1) for i in range(240)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(i, 60).split()), "en", "big", 1) for i in range(6)]
    got = {r["doc_id"]: r for r in outliers.quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 246 and not any(got[1000 + i]["kept"] for i in range(6))
    assert sum(got[i]["kept"] for i in range(240)) >= 238
    assert outliers.quality_verdicts(docs).count() == docs.count()
    assert outliers.quality_verdicts(empty).count() == 0


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(low))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[s : s + width])].add(i)
    out = {}
    for d, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[x]
        out[d] = (len(w), len(hit), sorted(str(i) for i in found if i is not None))
    return out


def test_decontamination(spark, docs, empty):
    items = [(1, prose(500, 25)), (2, "Größe über É"), (3, None), (4, "--"), (5, prose(500, 12)), (None, prose(501, 10)), (6, "kappa kappa kappa kappa kappa kappa kappa kappa kappa kappa kappa")]
    texts = [prose(1) + " " + prose(500, 25).upper() + "! x", "so größe, ÜBER É da", "größe über É!", prose(500, 11), " ".join(prose(500, 25).split()[3:13]), "kappa " * 14, prose(501, 10), "größe über", None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(df, bench).collect()}
    assert got == brute_contamination(list(enumerate(texts)), items)
    limit, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(df, bench).collect()} == got
    finally:
        decontaminate.BROADCAST_ROWS = limit
    assert decontaminate.contamination(docs, bench).count() == docs.count()
    assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def brute_near(docs, items, width, slop):
    """Items with a window whose distinct words all lie in some span of its length and slop words more."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w, found = cut(t), set()
        for i, text in items:
            x = cut(text)
            for s in range(max(1, len(x) - width + 1) if x else 0):
                need = set(x[s : s + width])
                span = len(x[s : s + width]) + slop
                if any(need <= set(w[k : k + span]) for k in range(max(1, len(w) - span + 1))):
                    found.add(i)
        out[d] = len(found - {None})
    return out


def test_proximity(spark):
    bench = [(1, "one two three four"), (2, prose(500, 14)), (3, "gone gone gone"), (None, "one two three four"), (4, "solo")]
    texts = ["a four b three c two d one e", "one two three", "one " + "x " * 30 + "two three four", None, "", "gone solo", "one one two one three x x x four " + "y " * 40, "one two x x x x three four"]
    texts += [" ".join(sorted(prose(500, 14).split()[k : k + 6], reverse=bool(k % 2))) + " " + prose(k) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(df, spark.createDataFrame(bench, "item_id long, text string"), width=4, slop=4).collect()}
    assert got == brute_near(enumerate(texts), bench, 4, 4) and got[0] == 1 and got[1] == 0 and got[5] == 2


def test_postings_of_repeated_and_long_rows(spark):
    phrase = prose(500, 10)
    rows = [(7, "x " * 3000 + phrase + " y" * 3000), (7, "x " * 3000 + phrase + " y" * 3000), (None, phrase), (None, phrase), (8, phrase)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("id", F.lit("a"))
    got = decontaminate.contamination(df, spark.createDataFrame([(1, phrase), (2, phrase)], "item_id long, text string"), slop=5).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["n_near"]) for r in got) == [("7", 6010, 10, 2, 2)] * 2 + [("8", 10, 10, 2, 2)] + [("None", 10, 10, 2, 2)] * 2


def test_lines(spark, docs, empty):
    shared, near = "Shared footer line", "Near line"
    rows = [(i, f"own {i}\n {shared} \n{near if i < 9 else 'other ' + str(i)}", "en", f"s{i}", 1) for i in range(12)] + [(50, None, "en", None, 1), (51, shared, "en", "s1", 1), (51, shared, "en", "s1", 1)]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS), min_sites=10)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert out.count() == len(rows) and got[0] == (rows[0][1], 3, 0) and got[1] == (f"own 1\n{near}", 3, 1) and got[51] == ("", 1, 1) and got[50] == (None, 0, 0)
    nine = {r["doc_id"]: r["n_removed"] for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS), min_sites=9).collect()}
    assert nine[8] == 2 and nine[11] == 1
    assert line_dedup.remove_boilerplate(docs).count() == docs.count() and line_dedup.remove_boilerplate(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_near_duplicates(spark, docs, empty):
    base = prose(1, 400).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (10, 200)]
    rows = [(5, " ".join(base)), (9, near[0]), (2, near[1]), (7, prose(4, 400)), (None, prose(4, 400)), (8, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    fps = {d: simhash.fingerprint(t) for d, t in rows}
    want = {}
    for d in fps:
        group, grown = {d}, True
        while grown:
            more = {e for e in fps for x in group if bin(fps[e] ^ fps[x]).count("1") <= 3} - group
            grown = bool(more)
            group |= more
        want[d] = min(x for x in group if x is not None)
    assert got == want and got[8] == got[6] == 6 and got[None] == 7
    keys = df.select("doc_id", F.xxhash64("text").alias("fp")).distinct()
    assert simhash.fingerprint_links(keys.select("fp").distinct(), hot=2).count() == 0
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(empty).count() == 0


def test_hot_groups_are_cut_and_whole(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    f = {0}
    while len(f) < 300:
        f.add(int(rng.choice(sorted(f)[-40:])) ^ 1 << int(rng.integers(0, 40)))
    df = spark.createDataFrame([(x,) for x in f], "fp long")
    one, cut = (graph.components(simhash.fingerprint_links(df, 3, hot)).count() for hot in (8192, 16))
    assert one == cut == 299


def test_language_model(spark, docs, empty):
    train = docs.where(~ngram_bloom.held_out_rows())
    got = ngram_bloom.score_language_model(docs, train).collect()
    word = re.compile(rb"[^\x20\x09-\x0d]+")
    cut = lambda t: [*word.findall((t or "").encode().lower()), b" end"]
    rows = docs.select("doc_id", "text").collect()
    count = collections.Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            count.update(cut(t))
    n, v = sum(count.values()), len(count)
    want = {d: (len(cut(t)), sum(count[w] > 0 for w in cut(t)), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t))) for d, t in rows}
    assert len(got) == len(rows)
    for r in got:
        a, b, c = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, b, n) and r["base_score"] == pytest.approx(c)
    pairs, contexts = collections.Counter(), collections.Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            both = list(zip([None, *cut(t)], cut(t), strict=False))
            pairs.update(both)
            contexts.update(v for v, _ in both)

    def brute_score(t):
        total = 0.0
        for v, w in zip([None, *cut(t)], cut(t), strict=False):
            least = 2 ** (pairs[v, w].bit_length() - 1) if pairs[v, w] else 0
            m = contexts[v] / (contexts[v] + ngram_bloom.BACKOFF)
            total += math.log10(m * least / max(contexts[v], 1) + (1 - m) * (count[w] + 1) / (N + V + 1))
        return total

    N, V = n, len(count)
    text = {d: t for d, t in rows}
    # A pair never seen may pass for seen, which raises the score; hardly any does.
    off = [r["score"] - brute_score(text[r["doc_id"]]) for r in got]
    assert min(off) > -1e-6 and sum(x > 1e-6 for x in off) <= 2
    joined = ngram_bloom.score_language_model(docs, train, max_broadcast=0).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    for a, b in zip(sorted(got, key=key), sorted(joined, key=key), strict=True):
        assert (a["doc_id"], a["n_tokens"], a["n_known"]) == (b["doc_id"], b["n_tokens"], b["n_known"])
        assert a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])
    assert ngram_bloom.score_language_model(empty, empty).count() == 0
    assert ngram_bloom.score_language_model(docs, empty).count() == len(rows)


def test_toxicity(spark, docs, empty):
    bad = ["scum", "idiot", "moron"]
    rows = [(i, prose(i) + (f" you {bad[i % 3]} and {bad[(i + 1) % 3]}" if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), labels, toxicity.held_out_rows()).select("doc_id", "toxic", "toxicity").collect()
    assert all(r["toxic"] == int(r["doc_id"] % 4 == 0) and 0 <= r["toxicity"] <= 1 for r in out) and len(out) == 400
    assert toxicity.score_toxicity(docs, labels.limit(0), toxicity.held_out_rows()).where("toxic = 0").count() == docs.count()
    assert toxicity.score_toxicity(empty, labels, toxicity.held_out_rows()).count() == 0
    scored = toxicity.score_toxicity(spark.createDataFrame(rows, DOCS).union(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None)], DOCS)), labels, toxicity.held_out_rows())
    assert scored.where("doc_id < 0 and toxic = 0").count() == 2


def test_language(spark, docs, empty):
    sound = {"xx": "bak dol fir gus".split(), "yy": "nee soa tii wuu".split()}
    import random

    r = random.Random(0)
    rows = [(i, " ".join(r.choice(sound["xx" if i % 2 else "yy"]) for _ in range(80)), "xx" if i % 2 else "yy", "s", 1) for i in range(160)]
    rows += [(500, None, "xx", "s", 0), (501, "123 !!", "xx", "s", 0), (502, "bak dol " * 5000, None, "s", 0)]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, DOCS), langid.held_out_rows()).collect()}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(160))
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "xx" and got[500]["score"] == 0
    assert langid.identify(docs, langid.held_out_rows()).count() == docs.count() and langid.identify(empty, langid.held_out_rows()).count() == 0


def test_surrogates_of_a_table(spark, docs, empty):
    rows = [(1, "write a.b12@x.example.com or call +1 (988) 555-2485"), (2, "A.B12@X.example.com again"), (3, None), (4, ""), (5, "clean"), (5, "clean"), (None, "ip 10.1.2.3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_entities", F.lit("x"))
    got = [(r["doc_id"], r["text"], r["n_entities"]) for r in surrogates.replace_entities(df, b"key").collect()]
    by = {d: t for d, t, _ in got}
    assert len(got) == 7 and by[5] == "clean" and by[3] is None and by[4] == ""
    mail = by[1].split()[1]
    assert mail != "a.b12@x.example.com" and by[2].split()[0].lower() == mail and "555-2485" not in by[1]
    entities, redrawn = surrogates.assign(df, b"key")
    assert {r["value"] for r in entities.where("kind = 'email'").collect()} == {"a.b12@x.example.com"}
    assert surrogates.replace_entities(docs, b"key").count() == docs.count() and surrogates.replace_entities(empty, b"key").count() == 0


def test_clashing_surrogates_are_drawn_again(spark):
    value = "192.168.77.5"
    other = surrogates.surrogate("ip", value, b"key")
    df = spark.createDataFrame([(1, f"from {value} to {other}."), (2, f"{value}")], "doc_id long, text string")
    _, redrawn = surrogates.assign(df, b"key")
    assert redrawn.where(F.col("value") == value).count() == 1
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(df, b"key").collect()}
    assert other not in got[1] and value not in got[1] and got[1].split()[1] == got[2]


def test_encoding_of_a_table(spark, docs, empty):
    got = bpe.encode_digests(docs, tokenizer_path()).collect()
    assert len(got) == docs.count() and {r["doc_id"]: r["n_tokens"] for r in got}[12] == 0
    ids = {r["doc_id"]: (r["token_ids"], r["decoded_text"]) for r in bpe.token_ids(docs, tokenizer_path()).collect()}
    assert ids[12] == ([], "") and ids[0][1].strip() == prose(0)
    assert bpe.encode_digests(empty, tokenizer_path()).count() == 0
