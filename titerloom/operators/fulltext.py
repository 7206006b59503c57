"""A full-text index in files: positional postings by column, updated by freshness, searched by prefix.

Postings (bucket, token, doc_id, field, at) lie in folders by bucket, which the first two letters
of a token decide: a prefix of two letters or more reads one folder, and statistics prune within it.
Lengths (doc_id, n, since) are a small table beside them. An index is a folder of versions; a version is
complete once its mark is written, and readers take the last complete one: its lengths say in which
version each document's postings lie, so that bringing it up to date writes what changed.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titerloom.functions.keys import query_tokens

#: Folders that postings are dealt to.
BUCKETS = 64
#: Files of a bucket, by document; versions that postings lie in at most.
SPLITS, MAX_VERSIONS = 4, 8
K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}\p{Co}\x{300}-\x{36f}]+"
#: The same where only ASCII stands, character by character: Java looks such a class up in a bit table.
ASCII_WORD = "[0123456789abcdefghijklmnopqrstuvwxyz]+"
COUNTED = r"[\x{300}-\x{36f}]*[\p{L}\p{N}\p{Co}]" + WORD[:-1] + "*"
#: Words of a snippet by field, eight for short ones.
SNIPPET_WORDS = {"filename": 8, "tags": 8}


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    marked, bare = [], []
    for code in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(map(unicodedata.combining, parts[1:])):
            marked.append(chr(code))
            bare.append(parts[0].lower())
    return "".join(marked), "".join(bare)


def fold(x: Column) -> Column:
    """Lowered; marks off Latin letters, other alphabets as they are."""
    return F.regexp_replace(F.translate(F.lower(x), *_accents()), r"[\x{300}-\x{36f}]", "")


def _ascii(x: Column) -> Column:
    return F.char_length(x) == F.octet_length(x)


def tokens(x: Column) -> Column:
    """Letters and digits in a row, folded. Folding leaves words words, so a text is folded whole and then cut;
    only where lowering looks at what stands around a letter, the final sigma, words are folded one by one."""
    cut = lambda t, word=WORD: F.regexp_extract_all(t, F.lit(word), F.lit(0))
    one_by_one = F.filter(F.transform(cut(x), fold), lambda t: t != "")
    return F.when(_ascii(x), cut(F.lower(x), ASCII_WORD)).when(F.contains(x, F.lit("\u03a3")), one_by_one).otherwise(cut(fold(x)))


def n_tokens(x: Column) -> Column:
    """The number of tokens(); a word of marks alone is none."""
    return F.when(_ascii(x), F.regexp_count(F.lower(x), F.lit(ASCII_WORD))).otherwise(F.regexp_count(x, F.lit(COUNTED)))


def fold_text(text: str) -> str:
    """fold() of a text at hand."""
    table = str.maketrans(*_accents())
    return "".join(c for c in text.lower().translate(table) if not "\u0300" <= c <= "\u036f")


def asked(query: str) -> list[str]:
    """The query's words as the index has them; a word with _ is several."""
    words = [w for t in query_tokens(query) for w in fold_text(t).split("_") if w]
    return list(dict.fromkeys(words))


def bucket(token: Column) -> Column:
    return F.pmod(F.crc32(F.substring(token, 1, 2).cast("binary")), F.lit(BUCKETS)).cast("int")


def postings(documents: DataFrame, fields: list[str]) -> DataFrame:
    """documents: doc_id and the fields. One row for each document, field and place, with its token."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in fields])
    words = documents.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.field", F.posexplode("f.words").alias("at", "token"))
    return words.select(bucket(F.col("token")).alias("bucket"), "token", "doc_id", "field", "at")


def lengths(documents: DataFrame, fields: list[str]) -> DataFrame:
    return documents.select("doc_id", sum((n_tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields), F.lit(0)).cast("long").alias("n"))


class Index:
    """The index in a folder. fields: its columns, in their order."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str]) -> None:
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields

    def version(self) -> int:
        """The last complete one; 0 without any."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return 0
        found = [s.getPath() for s in files.listStatus(root)]
        done = [int(p.getName()) for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "lengths/_SUCCESS"))]
        return max(done, default=0)

    def _write(self, at: int, posted: DataFrame, sizes: DataFrame) -> None:
        """Version at; lengths are written last, and their mark completes it."""
        # A bucket of frequent words is several tasks' work.
        dealt = posted.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS)))
        dealt.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{at}/postings")
        sizes.write.mode("overwrite").parquet(f"{self.path}/{at}/lengths")

    def build(self, documents: DataFrame) -> None:
        at = self.version() + 1
        self._write(at, postings(documents, self.fields), lengths(documents, self.fields).withColumn("since", F.lit(at)))

    def _sizes(self) -> DataFrame:
        """doc_id, n and since: the version that holds the document's postings."""
        return self.spark.read.schema("doc_id long, n long, since int").parquet(f"{self.path}/{self.version()}/lengths")

    def postings(self, some: Column | None = None) -> DataFrame:
        """some: which of them."""
        sizes, out = self._sizes(), None
        for at in sorted(r["since"] for r in sizes.select("since").distinct().collect()) or [self.version()]:
            part = self.spark.read.schema("token string, doc_id long, field string, at int, bucket int").parquet(f"{self.path}/{at}/postings").withColumn("since", F.lit(at))
            out = part if out is None else out.unionByName(part)
        # Of documents that changed, earlier versions' postings don't count.
        return (out if some is None else out.where(some)).join(sizes.select("doc_id", "since"), ["doc_id", "since"], "left_semi").drop("since")

    def lengths(self) -> DataFrame:
        return self._sizes().drop("since")

    def refresh(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """changed: documents that are new or newer; gone: doc_ids to leave out. Other rows stay where they are, until
        they lie in MAX_VERSIONS versions: then all are written anew."""
        out = changed.select("doc_id") if gone is None else changed.select("doc_id").unionByName(gone.select("doc_id"))
        out = out.distinct()
        at, sizes, posted = self.version() + 1, self._sizes().join(out, "doc_id", "left_anti"), postings(changed, self.fields)
        if sizes.select("since").distinct().count() >= MAX_VERSIONS:
            posted, sizes = posted.unionByName(self.postings().join(out, "doc_id", "left_anti")), sizes.withColumn("since", F.lit(at))
        self._write(at, posted, sizes.unionByName(lengths(changed, self.fields).withColumn("since", F.lit(at))))

    def matches(self, words: list[str]) -> DataFrame:
        """word (its number), doc_id, field, hits and positions of tokens that begin with a word; a word of one letter is met whole."""
        cases = F.array(*[F.when(F.startswith("token", F.lit(w)) if len(w) > 1 else F.col("token") == w, F.lit(k)) for k, w in enumerate(words)])
        wanted = None
        for w in words:
            this = F.startswith("token", F.lit(w)) if len(w) > 1 else F.col("token") == w
            wanted = this if wanted is None else wanted | this
        some = self.postings(F.col("bucket").isin(*{_bucket(w) for w in words}) & wanted)
        hit = some.select("doc_id", "field", "at", F.explode(F.array_compact(cases)).alias("word"))
        return hit.groupBy("doc_id", "field", "word").agg(F.count("at").alias("hits"), F.sort_array(F.collect_list("at")).alias("positions"))

    def search(self, query: str, weights: dict[str, float], allowed: DataFrame | None = None) -> DataFrame:
        """doc_id, score (the smaller the better) and places (of the hits, by field) of documents with every
        word of the query; allowed: the doc_ids that may be found."""
        words = asked(query)
        if not words:
            return self.lengths().where("false").select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<field string, word int, positions array<int>>>").alias("places"))
        m = self.matches(words)
        weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
        tf = lambda k: F.sum(F.when(F.col("word") == k, F.col("hits") * F.coalesce(F.try_element_at(weight, F.col("field")), F.lit(1.0)))).alias(f"tf{k}")
        found = m.groupBy("doc_id").agg(*[tf(k) for k in range(len(words))], F.collect_list(F.struct("field", "word", "positions")).alias("places"))
        sizes = self.lengths()
        whole = sizes.agg(F.count(F.lit(1)).alias("all"), F.avg("n").alias("avg")).withColumn("one", F.lit(1))
        frequent = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(words))]).withColumn("one", F.lit(1))
        # One row of totals meets every hit.
        every = found.where(" and ".join(f"tf{k} > 0" for k in range(len(words)))).withColumn("one", F.lit(1))
        both = every.join(sizes, "doc_id").join(F.broadcast(whole.join(frequent, "one")), "one")
        score = F.lit(0.0)
        for k in range(len(words)):
            idf = F.greatest(F.ln((F.col("all") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)), F.lit(1e-6))
            score = score - idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("n") / F.col("avg")))
        out = both.select("doc_id", score.alias("score"), "places")
        return out if allowed is None else out.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")


def _bucket(word: str) -> int:
    import zlib

    return zlib.crc32(word[:2].encode()) % BUCKETS


def snippet(text: Column, places: Column, field: str, words: int | None = None) -> Column:
    """Of a found document's text the window of words with most of the query's words, then most hits, then
    first; the hits lie in its middle, and marks show where the text goes on. Without a hit it begins the text."""
    size = words or SNIPPET_WORDS.get(field, 20)
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\p{L}\p{N}\p{Co}\x{300}-\x{36f}]*" + WORD), F.lit(0))
    mine = F.filter(places, lambda p: p["field"] == field)
    hits = F.array_sort(F.flatten(F.transform(mine, lambda p: F.transform(p["positions"], lambda at: F.struct(at.alias("at"), p["word"].alias("word"))))))

    def window(h: Column) -> Column:
        inside = F.filter(hits, lambda x: (x["at"] >= h["at"]) & (x["at"] < h["at"] + size))
        kinds = F.size(F.array_distinct(F.transform(inside, lambda x: x["word"])))
        return F.struct((-kinds).alias("kinds"), (-F.size(inside)).alias("hits"), h["at"].alias("first"), F.array_max(F.transform(inside, lambda x: x["at"])).alias("last"))

    best = F.array_min(F.transform(hits, window))
    n = F.size(pieces)
    middle = best["first"] - F.floor((size - 1 - (best["last"] - best["first"])) / 2)
    start = F.coalesce(F.greatest(F.lit(0), F.least(middle, n - size)), F.lit(0)).cast("int")
    body = F.regexp_replace(F.array_join(F.slice(pieces, start + 1, F.lit(size)), ""), r"^[^\p{L}\p{N}\p{Co}]+", "")
    return F.concat(F.when(start > 0, F.lit(" … ")).otherwise(""), body, F.when(start + size < n, F.lit(" … ")).otherwise(""))


def decorated(hits: DataFrame, files: DataFrame, tags: DataFrame, measurements: DataFrame, fields: list[str], limit: int = 25) -> DataFrame:
    """The best hits, at most 100, with their file's columns, a snippet of each field, tags and marker names.
    files: doc_id, uploaded_at and the fields; tags: doc_id, tag; measurements: doc_id, status, name."""
    best = hits.join(files, "doc_id").orderBy("score", F.desc("uploaded_at"), "doc_id").limit(max(1, min(100, limit)))
    shown = best.select("*", *[snippet(F.col(f), F.col("places"), f).alias(f"{f}_snippet") for f in fields]).drop("places", *[f for f in fields if f != "filename"])
    t = tags.groupBy("doc_id").agg(F.sort_array(F.collect_list("tag")).alias("tag_list"))
    m = measurements.where("status = 'resolved' and name is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("marker_names"))
    none = F.array().cast("array<string>")
    out = shown.join(t, "doc_id", "left").join(m, "doc_id", "left")
    return out.withColumns({"tag_list": F.coalesce("tag_list", none), "marker_names": F.coalesce("marker_names", none)})
