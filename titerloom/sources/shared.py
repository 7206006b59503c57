"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it isn't set, a local session gets a folder of our own, and a cluster
    an error, as its executors wouldn't see such a folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (given or _own_dir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: a step that several others use is done once, and a lost executor
    costs its own tasks only."""
    path = f"{shared_dir(df.sparkSession)}/titerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
