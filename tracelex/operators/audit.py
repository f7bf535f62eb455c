"""Audits of model inputs: cells against their trace, hashes, manifests, reconciliation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cell_trace(cells: DataFrame, trace: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Every cell (id, feature, value) against its trace row; a zero cell expects none."""
    t = trace.where("feature is not null").select("id", "feature", F.col("value").alias("trace_value"))
    out = cells.join(t, ["id", "feature"], "left").withColumn("trace_expected", F.col("value") != 0)
    match = F.when(F.col("trace_expected"), F.coalesce(F.abs(F.col("value") - F.col("trace_value")) <= tolerance, F.lit(False))).otherwise(F.col("trace_value").isNull())
    return out.withColumn("cell_match", match)


def trace_counts(traced: DataFrame) -> DataFrame:
    return traced.agg(
        F.count("*").alias("cells"), F.count_if("trace_expected").alias("nonzero"), F.count("trace_value").alias("traced"), F.count_if(~F.col("cell_match")).alias("mismatches"),
    )


def sequence_sha256(rows: DataFrame, by: str, value: str, pos: str = "pos", block: int = 100_000) -> DataFrame:
    """by, sha256 of a sequence of any length: values are joined by newlines in order of pos in blocks of positions, and
    the blocks' hashes are joined by newlines and hashed. Always so, whatever the length; no row holds a sequence."""
    joined = lambda at, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, v))), lambda x: x[v]), "\n")
    blocks = rows.groupBy(by, F.floor(F.col(pos) / block).alias("_block")).agg(F.sha2(joined(pos, value), 256).alias("_sha"))
    return blocks.groupBy(by).agg(F.sha2(joined("_block", "_sha"), 256).alias("sha256"))


def model_inputs(selected: DataFrame, coverage: DataFrame, trace: DataFrame, scope: DataFrame) -> DataFrame:
    """For each selected feature: exists (in coverage: feature, nonzero), nonzero, traced (rows of the trace), complete (all
    non-zero cells are traced), in_train (its values in scope, the splits it was selected on: feature, split, are of the
    training split alone)."""
    traced = trace.groupBy("feature").agg(F.count("*").alias("traced"))
    only = scope.groupBy("feature").agg(F.bool_and(F.col("split") == "train").alias("in_train"))
    out = selected.select("feature").join(coverage.select("feature", "nonzero"), "feature", "left").join(traced, "feature", "left").join(only, "feature", "left")
    n, t = F.coalesce("nonzero", F.lit(0)), F.coalesce("traced", F.lit(0))
    return out.select("feature", F.col("nonzero").isNotNull().alias("exists"), n.alias("nonzero"), t.alias("traced"), (n == t).alias("complete"), F.coalesce("in_train", F.lit(False)).alias("in_train"))


def link_runs(metrics: DataFrame, predictions: DataFrame, positions: DataFrame, fingerprints: DataFrame, features: list[str], part: str = "test") -> DataFrame:
    """condition, seed, and for each run's metric document whether its dataset hash is the fingerprint of the part, its
    feature order is the given one, its predictions name the part's ids in order, and its support counts its predictions.

    metrics: read_metric_docs; predictions: condition, seed, id, y_true, pos (place in its file); positions: id, split, pos;
    fingerprints: split, sha256."""
    keys = ["condition", "seed"]
    ids = positions.where(F.col("split") == part)
    total = ids.agg(F.count("*").alias("_total"))
    at = predictions.join(ids.select("id", F.col("pos").alias("_want")), "id", "left").groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count_if(F.col("_want").eqNullSafe(F.col("pos"))).alias("_right"),
        F.array(*[F.count_if(F.col("y_true") == k) for k in range(3)]).alias("_support"),
    )
    split = fingerprints.where(F.col("split") == part).agg(F.max("sha256").alias("_sha"))
    out = metrics.join(at, keys, "left").join(F.broadcast(total), F.lit(True)).join(F.broadcast(split), F.lit(True))
    return out.select(
        *keys, F.coalesce("_rows", F.lit(0)).alias("rows"), F.col("provenance")["dataset_sha256"].eqNullSafe(F.col("_sha")).alias("dataset_match"),
        F.col("feature_order").eqNullSafe(F.array(*[F.lit(f) for f in features])).alias("features_match"),
        F.coalesce((F.col("_rows") == F.col("_total")) & (F.col("_right") == F.col("_total")), F.lit(False)).alias("order_match"), F.col("support").eqNullSafe(F.col("_support")).alias("support_match"),
    )


def traceability(posts: DataFrame, trace: DataFrame) -> DataFrame:
    """Posts without a trace row, trace rows without a post, traced cells, and the rate of posts covered."""
    missing = posts.select("id").join(trace.select("id"), "id", "left_anti").agg(F.count("*").alias("posts_untraced"))
    extra = trace.select("id").join(posts.select("id"), "id", "left_anti").agg(F.count("*").alias("rows_without_post"))
    counts = trace.agg(F.count("feature").alias("traced_cells"), F.count_distinct("id").alias("posts_traced"))
    total = posts.agg(F.count("*").alias("posts"))
    out = missing.join(extra, F.lit(True)).join(counts, F.lit(True)).join(total, F.lit(True))
    return out.withColumn("percent", 100.0 * F.col("posts_traced") / F.col("posts"))


def expectations(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """check, expected, observed, passed, message for columns of a one-row table."""
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("expected"), F.col(k).cast("long").alias("observed")) for k, v in expected.items()])
    out = observed.select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.col("expected") == F.col("observed"))
    wrong = F.concat("check", F.lit(": "), F.col("observed").cast("string"), F.lit(" instead of "), F.col("expected").cast("string"))
    return out.withColumn("message", F.when(F.col("passed"), F.concat("check", F.lit(": as expected"))).otherwise(wrong))


#: Bytes of a file that a task holds at once.
CHUNK = 8 << 20


def opened(path: str):
    """A stream of a file on any file system that its path names."""
    from pyarrow import fs

    if re.match(r"file:|/", path):
        return fs.LocalFileSystem().open_input_stream(re.sub(r"^file:/*", "/", path), buffer_size=0)
    system, own = fs.FileSystem.from_uri(path)
    return system.open_input_stream(own)


def file_digests(listed: DataFrame, kind: str = "sha256") -> DataFrame:
    """path, bytes and the hash of each file (listed: path): read in ranges of CHUNK bytes that stream through the hash, so
    that a file of any size needs no more memory than that. A hash is sequential, so a file is one task's work; files are
    spread over tasks by their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.new(kind), 0
                with opened(path) as stream:
                    while part := stream.read(CHUNK):
                        digest.update(part)
                        size += len(part)
                sizes.append(size)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(out, pa.string())], ["path", "bytes", kind])

    return listed.select("path").repartition("path").mapInArrow(run, f"path string, bytes long, {kind} string")


def scan_files(spark: SparkSession, folder: str, suffix: str = "", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below the folder), name, bytes, sha256 of the files below a folder whose path no pattern of exclude finds,
    empty ones included. The driver holds the list of names, as it does for any read; files are read by tasks alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).inputFiles()
    listed = spark.createDataFrame([(unquote(p),) for p in found], "path string")
    own = F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    for pattern in exclude:
        listed = listed.where(~own.rlike(pattern))
    return file_digests(listed).select(own.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def manifest_verify(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """name, status of each file. declared: line ("hash  name")."""
    d = declared.select(F.regexp_extract("line", r"^([0-9a-f]{64}) [ *](.+)$", 1).alias("want"), F.regexp_extract("line", r"^([0-9a-f]{64}) [ *](.+)$", 2).alias("name"), "line")
    bad = d.where("want = ''").select(F.col("line").alias("name"), F.lit("malformed").alias("status"))
    both = d.where("want <> ''").join(actual, "name", "full_outer")
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "undeclared").when(F.col("want") != F.col("sha256"), "mismatch").otherwise("ok")
    return both.select("name", status.alias("status")).union(bad)


def reconcile_predictions(predictions: DataFrame, split: DataFrame, labels: DataFrame, part: str = "test") -> DataFrame:
    """Per run: rows, duplicate ids, ids out of the part, missing ids, labels that differ."""
    want = split.where(F.col("split") == part).select("id", F.lit(1).alias("in_part"))
    p = predictions.join(want, "id", "left").join(labels, "id", "left")
    out = p.groupBy("condition", "seed").agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("id")).alias("duplicates"), F.count_if(F.col("in_part").isNull()).alias("outside"),
        F.count_if(~F.col("label").eqNullSafe(F.col("y_true"))).alias("label_differs"), F.count_distinct(F.when(F.col("in_part") == 1, F.col("id"))).alias("inside"),
    )
    total = want.join(labels, "id").agg(F.count("*").alias("total"))
    return out.join(F.broadcast(total), F.lit(True)).withColumn("missing", F.col("total") - F.col("inside")).drop("inside", "total")


def reconcile_chain(posts: DataFrame, trace: DataFrame, cells: DataFrame, selected: DataFrame, conformance: DataFrame, predictions: DataFrame, test: DataFrame) -> DataFrame:
    """relation, expected, verified, exceptions, status of the five links of the chain: posts to addresses, selected
    activations to the rows that trace them, input cells to traced values, the graph to its constraints, test posts to
    the predictions of every run.

    posts: id, iri; trace: id, post_iri, feature, module, value; cells: id, feature, value; selected: feature; conformance:
    one row of `shapes.summary`; predictions: condition, seed, id, split, y_true; test: id, label. Every link is an
    aggregate of one row; status is passed if nothing is excepted and all that is expected was found."""
    mine = lambda df: df.join(F.broadcast(selected.select("feature")), "feature", "left_semi")
    seen = trace.groupBy("id").agg(F.max("post_iri").alias("_iri"))
    link = lambda df, name, *numbers: df.agg(*[n.cast("long").alias(c) for n, c in zip(numbers, ("expected", "verified", "exceptions"), strict=True)]).select(F.lit(name).alias("relation"), "*")
    out = [link(posts.join(seen, "id", "left"), "posts", F.count("*"), F.count("_iri"), F.count_if(~F.col("_iri").eqNullSafe(F.col("iri"))))]

    active = mine(trace).where("value <> 0")
    wanted = mine(cells).where("value <> 0").agg(F.count("*").alias("_n"))
    lacks = sum((F.col(c).isNull().cast("int") for c in ("id", "module", "post_iri")), F.lit(0))
    found = active.agg(F.count("*").alias("_found"), F.coalesce(F.sum(lacks), F.lit(0)).alias("_x"))
    out.append(link(wanted.join(found, F.lit(True)), "activations", F.max("_n"), F.max("_found"), F.max("_x")))

    keys = mine(trace).groupBy("id", "feature").agg(F.count("*").alias("_rows"), F.max("value").alias("_v"))
    both = mine(cells).join(keys, ["id", "feature"], "full_outer")
    own = F.col("value").isNotNull()
    ok = own & F.when(F.col("value") != 0, F.coalesce(F.abs(F.col("value") - F.col("_v")) <= 1e-12, F.lit(False))).otherwise(F.col("_v").isNull())
    out.append(link(both, "cells", F.count("value"), F.count_if(ok), F.count_if(own & ~ok) + F.count_if(F.col("_rows") > 1)))

    out.append(link(conformance, "constraints", F.count("*"), F.count_if("conforms"), F.sum((~F.col("conforms")).cast("int")) + F.sum("results")))

    marked = predictions.join(test.select("id", "label", F.lit(1).alias("_in")), "id", "left")
    runs = marked.groupBy("condition", "seed").agg(
        F.count("*").alias("_rows"), (F.count("*") - F.count_distinct("id") + F.count_if(F.col("split") != "test") + F.count_distinct(F.when(F.col("_in").isNull(), F.col("id"))) + F.count_if(~F.col("label").eqNullSafe(F.col("y_true")))).alias("_x"),
        F.count_distinct(F.when(F.col("_in") == 1, F.col("id"))).alias("_hit"),
    )
    total = test.agg(F.count("*").alias("_n"))
    out.append(link(runs.join(F.broadcast(total), F.lit(True)), "predictions", F.count("*") * F.max("_n"), F.sum("_rows"), F.sum(F.col("_x") + F.col("_n") - F.col("_hit"))))

    every = out[0]
    for one in out[1:]:
        every = every.union(one)
    every = every.select("relation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "verified", "exceptions")])
    return every.withColumn("status", F.when((F.col("exceptions") == 0) & (F.col("expected") == F.col("verified")), "passed").otherwise("attention required"))
