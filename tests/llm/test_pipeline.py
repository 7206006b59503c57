"""Stages of the pipeline, and the whole of it, on a small corpus."""

import random

import corpus_pipeline
from titerloom.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti") for b in ("dan", "fel", "gor", "hin", "jup")]


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("aeiou") for _ in range(n))


def write(spark, path):
    rows = [(i, prose(i) + (" you scum and you idiot" if i % 5 == 0 else ""), "en", f"s{i % 20}", 1) for i in range(300)]
    bench = [(1, prose(900, 30)), (2, prose(901, 8))]
    rows += [(400, prose(1), "en", "s1", 1), (401, prose(1) + " end", "en", "s2", 1), (402, prose(3) + " " + prose(900, 30), "en", "s1", 1), (403, None, "en", "s1", 0)]
    rows += [(500 + i, prose(700 + i) + "\nAll rights of this page are reserved", "en", f"s{i}", 1) for i in range(14)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = write(spark, str(tmp_path))
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left["toxicity"]) == {r[0] for r in rows if r[0] >= 300 or r[0] % 5}
    assert set(left["line dedup"]) == set(left["toxicity"]) and "reserved" in left["line dedup"][500] and "reserved" not in left["line dedup"][501]
    assert {1, 400, 401} & set(left["near duplicates"]) == {1}
    gone = set(left["near duplicates"]) - set(left["decontamination"])
    assert gone == {402}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == set(left["decontamination"])
    assert len(corpus_pipeline.STAGES) == 5 and toxicity.MAX_TRAIN >= 1000
