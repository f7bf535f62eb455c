"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files are; every operator that needs them takes the folder as a parameter.
TOKENIZERS = "/opt/tokenizers"

#: Rows in an Arrow batch, so that a batch of very long texts stays small beside a worker's memory.
BATCH_ROWS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset and the master is local (tests, a laptop), a temporary folder is taken and kept in the session's
    setting; on a cluster, whose executors couldn't see it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracelex.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tracelex-", dir="/tmp")
        spark.conf.set("tracelex.shared.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts lineage, and a lost executor costs only
    its own tasks. The rows (monotonic ids included) are then the same in every later read."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes for df to have no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (lower() also changes accented letters)."""
    return F.translate(text, UPPER, LOWER)
