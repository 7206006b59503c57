"""Files as tables: uploads, their kinds and sidecars, text documents, log lines."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titerloom.functions.keys import blank_to_null, document_text, strip

#: Kinds of file by suffix, other names of a kind, and the suffix of a sidecar.
SUFFIXES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "txt": "text/plain", "md": "text/markdown"}
ALIASES = {"text/x-markdown": "text/markdown"}
SIDECAR = ".originalName"
TEXT_KINDS = ("text/plain", "text/markdown")
#: Further suffixes of these kinds, by the standard library's table, and suffixes of packed files, which hide the kind's.
GUESSED = {s.lstrip("."): t for s, t in mimetypes.MimeTypes().types_map[True].items() if t in {*SUFFIXES.values(), *ALIASES}}
PACKED = r"\.(?:gz|Z|bz2|xz|br)$"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def content_type(text: Column) -> Column:
    return blank_to_null(F.lower(strip(F.split_part(text, F.lit(";"), F.lit(1)))))


def upload_kind(name: Column, declared: Column) -> Column:
    """By suffix; an unknown suffix is refused (null); without one, what was declared."""
    known = F.try_element_at(_map(SUFFIXES), suffix(name))
    type_ = content_type(declared)
    alias = F.coalesce(F.try_element_at(_map(ALIASES), type_), type_)
    return F.when(suffix(name) != "", known).otherwise(F.when(alias.isin(sorted(set(SUFFIXES.values()))), alias))


def preload_kind(name: Column) -> Column:
    """By suffix, else as the standard library guesses; null for any other kind."""
    guess = F.try_element_at(_map(GUESSED), suffix(F.regexp_replace(name, PACKED, "")))
    return F.coalesce(F.try_element_at(_map(SUFFIXES), suffix(name)), F.try_element_at(_map(ALIASES), guess), guess)


def is_text(kind: Column) -> Column:
    return kind.isin(*TEXT_KINDS)


def scan_uploads(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """path, kind, length, original_name of files not yet known; sidecars give the original names.
    File contents are read for sidecars only."""
    all_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    side = F.endswith("path", F.lit(SIDECAR))
    names = all_.where(side).select(F.expr(f"substring(path, 1, length(path) - {len(SIDECAR)})").alias("path"), strip(F.decode("content", "UTF-8")).alias("original_name"))
    files = all_.where(~side).select("path", "length", "modificationTime").join(known.select("path"), "path", "left_anti")
    named = files.join(names, "path", "left")
    kind = upload_kind(F.coalesce("original_name", "path"), F.lit(None).cast("string"))
    return named.select("path", "original_name", "length", "modificationTime", kind.alias("kind")).where("kind is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files, less a byte-order mark; line ends made alike."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return raw.select("path", document_text(F.regexp_replace("value", "^﻿", "")).alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of log files. Lines are numbered within a file by their place in it."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("at"))).drop("at")


def parse_raw_measurements(batches: DataFrame) -> DataFrame:
    """Raw measurement rows of extraction results: rows without a name or key are dropped."""
    from titerloom.functions import keys as K
    from titerloom.functions import numbers as N

    m = batches.select("file_id", "batch_key", F.posexplode("measurements").alias("pos", "m"))
    v = N.parse_value(F.col("m.value"))
    rows = m.select(
        "file_id",
        "batch_key",
        "pos",
        strip(F.col("m.marker_name")).alias("raw_name"),
        K.alias_key(F.col("m.marker_name")).alias("alias_key"),
        v["number"].alias("original_value"),
        v["text"].alias("original_text"),
        K.optional_text(F.col("m.unit")).alias("original_unit"),
        N.parse_number(F.col("m.reference_low")).alias("original_low"),
        N.parse_number(F.col("m.reference_high")).alias("original_high"),
        F.try_to_timestamp("m.measured_at").alias("measured_at"),
        N.parse_positive_int(F.col("m.page_number")).alias("page_number"),
    )
    return rows.where("raw_name != '' and alias_key != ''")


def replace_batches(old: DataFrame, new: DataFrame, key: str = "batch_key") -> DataFrame:
    """old with the batches that new brings put in place of their former rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
