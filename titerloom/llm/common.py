"""What the operators share: reading, shared storage, row keys and word splitting.

Row identity: ``doc_id`` need not be unique or present, so a row is addressed by
(doc_id, 64-bit text hash), compared null-safely. Rows that agree in both have
the same text and get the same result, which a join on that key keeps whole.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="titerloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one of
    our own; a cluster's executors wouldn't see that, so there ValueError is raised."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (given or _own_dir()).rstrip("/")


#: Written tables after which finished shuffles are given up.
RELEASE_EVERY = 2
_tables = itertools.count(1)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing reads any more: their files go now, which else
    stay until it happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table read back, and the folder it lies in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/titerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_tables) % RELEASE_EVERY == 0:
        release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return write_table(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of write_table() that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of rows sent to a Python worker at once. By default that is a whole task's texts (10,000 rows or
#: 64 MB), which executor and worker hold several times over.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers BATCH_BYTES at once from now on, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return a process's free memory to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Functions whose results a worker keeps from task to task.
_kept: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """make, whose last results the worker keeps until a task of another operator comes to it."""
    _kept.append(lru_cache(maxsize=2)(make))
    return _kept[-1]


def let_go(*own: Callable) -> None:
    """Drop what this worker keeps but for its own, those of the operator it now serves."""
    for cached in _kept:
        if cached not in own:
            cached.cache_clear()


def releasing(run: Callable[[Iterator], Iterator], *own: Callable) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches, before which the worker, which stays for the next
    task, drops what others than its own have kept there, and after which it gives its free memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        let_go(*own)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a materialized table of narrow rows for broadcast if it has max_rows or fewer;
    otherwise leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the row key (doc_id null-safe, thash); the key's columns are kept once, from left."""
    renamed = right.withColumnRenamed("doc_id", "__id").withColumnRenamed("thash", "__hash")
    on = left["doc_id"].eqNullSafe(renamed["__id"]) & (left["thash"] == renamed["__hash"])
    return left.join(renamed, on, how).drop("__id", "__hash")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; an absent id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def is_ascii(text: Column) -> Column:
    return F.char_length(text) == F.octet_length(text)


def ascii_lower(word: Column) -> Column:
    """A-Z lowered, all else as it is. lower() has a quick path for ASCII alone; translate(),
    slow a character, is left to words with both a capital and another alphabet's letter."""
    return F.when(is_ascii(word), F.lower(word)).when(F.rlike(word, F.lit("[A-Z]")), F.translate(word, UPPER, LOWER)).otherwise(word)


def one_of(characters: str) -> str:
    """A regular expression's class, character by character: Java looks such a class up in
    a bit table, where a class of ranges is a chain of tests."""
    return "[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]"


def space_words(text: Column) -> Column:
    """Maximal runs without ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), one_of(SPACES) + "+"), "")
