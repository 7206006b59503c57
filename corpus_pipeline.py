"""A corpus through five stages: toxic documents go, boilerplate lines go, one document of
each near-duplicate group stays, documents with benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Rows whose doc_id is null or repeated are kept or dropped each
on its own, except near-duplicates, where the least doc_id of a group names the row kept
and equal rows of that id count as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from titerloom.llm.common import bounded_broadcast, load, materialize, shared_dir, text_hash
from titerloom.llm.queries import tokenizer_path


#: Keys of rows, of 16 bytes, that are broadcast.
MAX_BROADCAST = 200_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose key (doc_id, hash of the text) is in gone, a written table of
    keys; while few, they are broadcast and no text is shuffled."""
    kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_hash().alias("hash"))
    gone = bounded_broadcast(gone.select(F.col("doc_id").alias("id_gone"), F.col("thash").alias("hash_gone")), MAX_BROADCAST)
    return kept.join(gone, F.expr("id <=> id_gone and hash = hash_gone"), "left_anti").select("row.*")


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns an operator works on, the others in a struct named row, where no name of the operator's own can clash."""
    return docs.select(*keep, F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns if c not in keep]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], *keep: str, **new: Column) -> DataFrame:
    """The columns of docs again, some of them anew."""
    return rows.select(*[(new[c] if c in new else F.col(c) if c in keep else F.col(f"row.`_{c}`")).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on every labelled row that isn't held out; rows predicted toxic go."""
    scored = toxicity.score_toxicity(packed(docs, "doc_id", "text"), load(spark, sf_dir, "labels"), toxicity.held_out_rows())
    return unpacked(scored.where("toxic = 0"), docs.columns, "doc_id", "text")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their cross-site lines, with n_chars to match; a document left without any line goes."""
    cut = line_dedup.remove_boilerplate(packed(docs, "doc_id", "text", "source"))
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long"))
    new = {"n_chars": n_chars.otherwise(F.col("row._n_chars"))} if "n_chars" in docs.columns else {}
    return unpacked(kept, docs.columns, "doc_id", "text", "source", **new)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word Jaccard similarity of 0.8 or more, the one with the least doc_id stays."""
    groups = materialize(simhash.similar_documents(docs.select("doc_id", "text")), "groups")
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "thash")).alias("first"))
    first = materialize(least.select("first.doc_id", "first.thash"), "first-of-groups")
    keys = groups.groupBy("doc_id", "thash").agg(F.count(F.lit(1)).alias("n"))
    gone = keys.alias("x").join(first.alias("y"), F.expr("x.doc_id <=> y.doc_id and x.thash = y.thash"), "left_anti").select("doc_id", "thash")
    left = without(docs, materialize(gone, "copies"))
    if keys.where("n > 1").limit(1).count():
        # Rows of one id and text, of which the table has several, are one document.
        left = left.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("hash")).dropDuplicates(["doc_id", "hash"]).select("row.*")
    return left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), load(spark, sf_dir, "benchmark")).where("n_hit > 0")
    return without(docs, materialize(found.select("doc_id", "thash").distinct(), "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its tokens' number and digests, as op3 returns them."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("near duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]
#: Training, sketches, fingerprints and encoding are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/titerloom/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
