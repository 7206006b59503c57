"""Search, assembled texts and search documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions import keys as K
from titerloom.operators import coverage, fulltext, search
from titerloom.plans.registry import query
from titerloom.sources.shared import shared_dir

WEIGHTS = {"text": 3, "lang": 2, "source": 4}
ASKED = "the en"


@query("""WITH d AS (SELECT *, lower(text) AS t, lower(lang) AS g, lower(source) AS s FROM documents)
SELECT doc_id, (contains(t, 'the')::INT + contains(t, 'en')::INT) * 3 + (contains(g, 'the')::INT + contains(g, 'en')::INT) * 2 + (contains(s, 'the')::INT + contains(s, 'en')::INT) * 4 AS score
FROM d WHERE (contains(t, 'the') OR contains(g, 'the') OR contains(s, 'the')) AND (contains(t, 'en') OR contains(g, 'en') OR contains(s, 'en'))""")
def offline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.offline(spark.read.parquet(f"{sf_dir}/documents.parquet"), ASKED, WEIGHTS).select("doc_id", "score")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w, regexp_extract_all(strip_accents(lower(source)), '[\\p{L}\\p{N}]+') AS s FROM documents),
c AS (SELECT doc_id, len(w) + len(s) AS dl, len(list_filter(w, lambda x: starts_with(x, 'license'))) * 1.2 + len(list_filter(s, lambda x: starts_with(x, 'license'))) * 2.2 AS f0,
  len(list_filter(w, lambda x: starts_with(x, 'th'))) * 1.2 + len(list_filter(s, lambda x: starts_with(x, 'th'))) * 2.2 AS f1 FROM d),
t AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM c)
SELECT doc_id, round(-(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score
FROM c, t WHERE f0 > 0 AND f1 > 0 ORDER BY score, doc_id LIMIT 100""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25(spark.read.parquet(f"{sf_dir}/documents.parquet"), "license th", {"text": 1.2, "source": 2.2})
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(100)


#: Words that only folded letters meet.
FOLDED = "ea an"


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS w, regexp_extract_all(strip_accents(lower(coalesce(source, ''))), '[\\p{L}\\p{N}]+') AS s FROM documents),
c AS (SELECT doc_id, len(w) + len(s) AS dl, len(list_filter(w, lambda x: starts_with(x, 'ea'))) * 1.2 + len(list_filter(s, lambda x: starts_with(x, 'ea'))) * 2.2 AS f0,
  len(list_filter(w, lambda x: starts_with(x, 'an'))) * 1.2 + len(list_filter(s, lambda x: starts_with(x, 'an'))) * 2.2 AS f1 FROM d),
t AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM c)
SELECT doc_id, round(-(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score
FROM c, t WHERE f0 > 0 AND f1 > 0""")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits, by an index that is built from one half of the documents and then brought up to date with the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    index = fulltext.Index(spark, f"{shared_dir(spark)}/titerloom/index-{uuid.uuid4().hex}", ["text", "source"])
    index.build(docs.where("doc_id % 2 = 0"))
    index.refresh(docs.where("doc_id % 2 = 1"))
    return index.search(FOLDED, {"text": 1.2, "source": 2.2}).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS raw, concat(lang, ' ', source) AS tags FROM documents""")
def search_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tags = docs.select(F.col("doc_id").alias("file_id"), F.explode(F.array("lang", "source")).alias("tag"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.lit("complete").alias("status"), F.lit("").alias("filename"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("raw"), F.lit(None).cast("string").alias("translated"))
    none = spark.createDataFrame([], "file_id long, id long, status string, name string, value_text string")
    return search.build_documents(files, tags, none).select("doc_id", "raw", "tags")


@query("""WITH h AS (SELECT doc_id, text, strpos(lower(text), 'licensed') AS p FROM documents WHERE contains(lower(text), 'licensed')),
b AS (SELECT doc_id, text, greatest(p - 61, 0) AS a, least(p - 1 + 140, length(text)) AS z FROM h)
SELECT doc_id, concat(CASE WHEN a > 0 THEN '… ' ELSE '' END, regexp_replace(substr(text, a + 1, z - a), '^\\s+|\\s+$', '', 'g'), CASE WHEN z < length(text) THEN ' …' ELSE '' END) AS snippet FROM b""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", K.snippet(F.col("text"), ["licensed"]).alias("snippet")).where("snippet is not null")


@query("""SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn, t) AS text FROM (SELECT conv_id, turn, nullif(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '') AS t FROM conversations) WHERE t IS NOT NULL GROUP BY conv_id""")
def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.assembled_text(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", ["turn"], "text")


@query("""SELECT doc_id, list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')) IS NOT NULL AS ok, len(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')) AS n FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)""")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("line"))
    return docs.select("doc_id", F.lit(True).alias("ok"), F.size(K.text_tokens(F.col("line"))).cast("long").alias("n"))


@query("""SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents""")
def text_tokens_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of whole texts; text_tokens is held to the first line by its SQL."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", K.text_tokens(F.col("text")).alias("tokens"))
    return docs.select("doc_id", "tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")).cast("long").alias("n"))


@query("""SELECT p_partkey AS id, substr(sha256(concat('v8:', p_name, ':', p_brand, p_size)), 1, 24) AS key FROM part""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), K.cache_key(F.lit("v8"), F.col("p_name"), F.concat("p_brand", F.col("p_size").cast("string"))).alias("key"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 IN (0, 1) AND props IS NOT NULL THEN len(json_keys(props)) ELSE 0 END AS n, CASE WHEN event_id % 5 IN (0, 1) THEN json_extract_string(props, '$.k') END AS k FROM events""")
def payload_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of events as maps; some are made lists, broken or empty, which count as no object."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 5
    text = F.when(n < 2, F.col("props")).when(n == 2, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(n == 3, F.concat(F.lit("{"), F.col("props"))).otherwise(F.lit(""))
    m = K.json_object_map(text)
    return e.select(F.col("event_id").alias("id"), F.size(m).cast("long").alias("n"), F.try_element_at(m, F.lit("k")).alias("k"))
