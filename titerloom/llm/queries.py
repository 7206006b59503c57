"""The queries of this subpackage, each over its whole tables, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.llm import bpe, decontaminate, gnat, langid, line_dedup, ngram_bloom, outliers, periodic_runs, sharding, simhash, surrogates, token_records, toxicity
from titerloom.llm.common import load, shared_dir

#: A parameter: where the tokenizer file lies when the package that holds it can't be asked.
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, END_ID = "byte_bpe_50k.json", 0
SHARDS = [1.0] * 8
#: Words that may stand between those of a benchmark window for it to count as near.
SLOP = 5
#: Of the demonstration query; a real run passes its own secret.
SURROGATE_KEY = b"titerloom demonstration key"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(load(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(load(spark, sf_dir, "documents"), tokenizer_path())


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return outliers.quality_verdicts(load(spark, sf_dir, "documents")).select(*columns)


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rendezvous_shards(load(spark, sf_dir, "documents"), SHARDS)


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = load(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.held_out_rows()
    scored = toxicity.score_toxicity(docs, load(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), slop=SLOP)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.held_out_rows()
    out = langid.identify(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = load(spark, sf_dir, "documents").select("doc_id", "text"), ngram_bloom.held_out_rows()
    out = ngram_bloom.score_language_model(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    # A label or vector that is null or not finite keeps its row out.
    usable = table.where("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    return gnat.hard_negatives(rows, F.col("id") % 50 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(load(spark, sf_dir, "documents"), change=periodic_runs.repeated_from))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/titerloom/records-{uuid.uuid4().hex}"
    token_records.write_records(load(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path(BYTE_TOKENIZER), END_ID)
    return token_records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_surrogates,
        op2_line_dedup,
        op3_bpe,
        op4_robust_outliers,
        op5_rendezvous_shards,
        op6_weak_toxicity,
        op7_decontaminate,
        op8_byte_cnn_language,
        op9_log_frequency_bloom,
        op10_simhash,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_token_records,
    )
}

_LINES = """
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
full_lines AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, pos, raw,
         regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line
  FROM lines WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]'))
"""
OP2_SQL = f"""
WITH {_LINES},
boilerplate AS (SELECT line FROM full_lines GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth
  FROM full_lines SEMI JOIN boilerplate USING (line)),
cut AS (SELECT doc_id, pos FROM placed WHERE nth > 1),
left_over AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN cut ON l.doc_id = cut.doc_id AND l.pos = cut.pos GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM full_lines GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_removed FROM cut GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _score(shard: int) -> str:
    return f"-ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#{shard}'), 1, {sharding.HEX}) AS BIGINT) + 0.5) / {float(16**sharding.HEX)!r})"


def _winner(shards: int) -> str:
    return f"list_position([{', '.join(_score(s) for s in range(shards))}], list_min([{', '.join(_score(s) for s in range(shards))}])) - 1"


def _crc_table() -> str:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]::BIGINT[]"


OP5_SQL = f"""
WITH table_of AS (SELECT {_crc_table()} AS t),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
coded AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
         list_transform(generate_series(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b
  FROM bytes),
summed AS (
  SELECT doc_id, size,
         xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM coded, table_of),
placed AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law,
         CAST({_winner(len(SHARDS))} AS INTEGER) AS shard, CAST({_winner(len(SHARDS) + 1)} AS INTEGER) AS grown_shard,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), text_crc32, size)) AS digest
  FROM summed)
SELECT doc_id, size, text_crc32, law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
window_of AS (
  SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS size
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM item WHERE len(w) > 0)),
size_of AS (SELECT DISTINCT size FROM window_of),
placed AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM doc, size_of WHERE len(w) >= size)),
hit AS (SELECT doc_id, item, s, placed.size FROM placed JOIN window_of USING (phrase, size)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
kinds AS (SELECT phrase, size, list_distinct(string_split(phrase, ' ')) AS words FROM (SELECT DISTINCT phrase, size FROM window_of)),
token AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
freq AS (SELECT word, count(*) AS n FROM token GROUP BY word),
anchor AS (
  SELECT phrase, any_value(size) AS size, any_value(words) AS words, arg_min(word, (n, word)) AS word
  FROM (SELECT phrase, size, words, unnest(words) AS word FROM kinds) JOIN freq USING (word)
  GROUP BY phrase HAVING count(*) = any_value(len(words))),
span AS (
  SELECT doc_id, phrase, words, w[s:s + size + {SLOP} - 1] AS around
  FROM (SELECT t.doc_id, phrase, words, size, w, unnest(generate_series(greatest(1, p - size - {SLOP} + 1), p)) AS s
        FROM token t JOIN anchor USING (word) JOIN doc ON doc.doc_id = t.doc_id)),
near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near
  FROM (SELECT DISTINCT doc_id, phrase FROM span WHERE list_has_all(around, words)) JOIN window_of USING (phrase) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score
  FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLES = {"op11_hard_negatives": OP11_SQL, "op2_line_dedup": OP2_SQL, "op5_rendezvous_shards": OP5_SQL, "op7_decontaminate": OP7_SQL}
