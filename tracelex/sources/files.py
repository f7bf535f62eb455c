"""Files in and out: predictions as CSV, metric documents as JSON, reports, N-Triples, Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelex.operators import graph

PREDICTION = "id string, split string, y_true int, y_pred int, model string, condition string, seed int"


def scratch(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared folder; where none is set and the master is local, below a temporary
    one. On a cluster, whose executors couldn't see that, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracelex.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tracelex-", dir="/tmp")
        spark.conf.set("tracelex.shared.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    w = df.write.option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)
    return path


def read_predictions(spark: SparkSession, path: str, runs: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """All prediction rows below path. runs: every (model, condition, seed) that must be there, else ValueError."""
    out = spark.read.schema(PREDICTION).option("recursiveFileLookup", True).csv(path, header=True)
    if runs is not None:
        found = {tuple(r) for r in out.select("model", "condition", "seed").distinct().collect()}  # one row for each run
        missing = sorted(set(runs) - found)
        if missing:
            raise ValueError(f"no predictions of {missing}")
    return out


METRICS = (
    "model string, condition string, seed int, accuracy double, macro_f1 double, support array<long>, confusion_matrix array<array<long>>, "
    "report map<string, struct<precision: double, recall: double, f1: double>>, provenance map<string, string>, feature_order array<string>"
)


def read_metric_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each metric document below path, with its file."""
    return spark.read.schema(METRICS).option("recursiveFileLookup", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_frozen_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, weight of a document with one map for each side; ValueError if a side is empty."""
    doc = spark.read.text(path).select(F.from_json("value", "positive map<string,double>, negative map<string,double>").alias("j"))
    size = doc.agg(F.sum(F.coalesce(F.size("j.positive"), F.lit(0))), F.sum(F.coalesce(F.size("j.negative"), F.lit(0)))).first()
    if not size[0] or size[0] < 1 or not size[1] or size[1] < 1:
        raise ValueError(f"a side of the lexicon is empty: {size[0]} positive, {size[1]} negative terms")
    return doc.select(F.explode(F.map_concat("j.positive", "j.negative")).alias("term", "weight"))


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows whose columns may differ: the columns in the order in which they first appear."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_report(df: DataFrame, path: str) -> str:
    """Each row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


def write_lines(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


def through_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The statements of all N-Triples files below path, with their datatypes and languages."""
    return graph.parsed(spark.read.option("recursiveFileLookup", True).text(path), strict)
