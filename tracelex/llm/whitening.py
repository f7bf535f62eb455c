"""Operator 13: embedding whitening with weighted multiplicities.

Equal vectors are one: a distinct vector carries the number of its rows, and takes part in the fit with that weight (with
weight one where `weighted` is off). Sums are exact integers; the covariance is a weighted product of centred matrices, a
partial one for each task, added in two steps. Its eigenvectors (a matrix of the dimensions only) are found on the driver,
every distinct vector is whitened once, and the results are joined back to the rows. The vectors that more than one row in
HOT shares, HOT at most, join by broadcast, so that no join key holds more than that share of the rows.

Cases: vectors that are null or hold null, infinite or NaN entries are dropped; vectors of another length are a fit list
of their own, with as many components as they have dimensions; empty vectors have none; a component without variance
(a single vector, equal columns) has null in whitened and counts neither in explained nor in identity_error; rows with a
null or repeated id are rows of their own; a deviation beyond 64 bits is null; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelex.llm.common import staged, table
from tracelex.llm.topk import floored, usable

#: Components, the share of rows from which on a vector is joined by broadcast, groups of partial matrices in the first step.
COMPONENTS, HOT, GROUPS = 8, 1024, 64

SCALE, SHIFT = 1024, 100000

#: Rows of a product at once.
ROWS = 8192


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def totals(distinct: DataFrame, size: int, weighted: bool) -> tuple[int, list[int]]:
    """Number of fit vectors and the exact sum of every dimension: a partial sum for each task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(size, object), 0
        for batch in batches:
            x, w = matrix(batch.column(0), size), batch.column(1).to_numpy() if weighted else np.ones(batch.num_rows, np.int64)
            n += int(w.sum())
            fits = float(np.abs(x).max(initial=0)) * float(w.sum()) < 2**62
            sums += (w @ x if fits else w.astype(object) @ x.astype(object)).astype(object)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "s": pa.array([str(s) for s in sums]), "n": pa.array([n] * size, pa.int64())})

    each = distinct.select("x", "n").mapInArrow(run, "i int, s string, n long")
    rows = sorted(each.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect())
    return int(rows[0]["n"]), [int(r["s"]) for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole parts are taken off as integers first, so that only the fraction is rounded."""
    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - n * a) / n for s, a in zip(sums, whole, strict=True)])


def added(df: DataFrame) -> DataFrame:
    """Sums of the arrays v by row i, in the order of `part`."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(np.stack(rows.sort_values("part")["v"].tolist()), axis=0)
        return pd.DataFrame({"i": [rows["i"].iat[0]], "part": [int(rows["part"].min())], "v": [v]})

    first = df.groupBy("i", F.pmod("part", F.lit(GROUPS))).applyInPandas(lambda rows: one(rows), "i int, part int, v array<double>")
    return first.groupBy("i").applyInPandas(one, "i int, part int, v array<double>")


def covariance(distinct: DataFrame, size: int, n: int, sums: list[int], weighted: bool) -> np.ndarray:
    """Weighted centred product of all vectors, divided by n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                x = centred(matrix(b.column(0), size), n, sums)
                w = b.column(1).to_numpy()[:, None] if weighted else 1
                total += (x * w).T @ x
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part", "v"])

    rows = added(distinct.select("x", "n").mapInArrow(run, "i int, part int, v array<double>")).collect()
    v = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / n
    return (v + v.T) / 2


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest eigenvalues, falling, and their unit vectors as columns, each with its largest entry positive."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, u = e[order], u[:, order]
    return e, u * np.sign(u[np.abs(u).argmax(0), range(len(order))])


def projected(distinct: DataFrame, n: int, sums: list[int], e: np.ndarray, u: np.ndarray, least: float) -> DataFrame:
    """x, n, deviation and z, the whitened components (null where an eigenvalue is not above `least`)."""
    good = e > least
    scaled = u[:, good] / np.sqrt(e[good])
    size, place = len(sums), np.flatnonzero(good)
    total = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), size)
            z = np.full((len(x), len(e)), np.nan)
            z[:, place] = centred(x, n, sums) @ scaled
            # (n*x - S)^2 may need more than 64 bits before it is known to fit: split off what fits in floats' reach first.
            bound = float(n) * np.abs(x).max(initial=0) + max(map(abs, sums), default=0)
            off = x * n - np.array(sums, np.int64) if bound < 2**62 else x.astype(object) * n - total
            exact = off.astype(object) if size * float(np.abs(off).max(initial=0)) ** 2 >= 2**62 else off
            deviation = pa.array([v if v < 2**63 else None for v in (exact**2).sum(1).tolist()], pa.int64())
            flat = z.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(e)), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), deviation, lists], ["x", "n", "deviation", "z"])

    return distinct.select("x", "n").mapInArrow(run, "x array<long>, n long, deviation long, z array<double>")


def identity_error(done: DataFrame, good: list[int], n: int, weighted: bool) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, by two passes over the distinct ones."""
    if not good:
        return None
    w = F.col("n") if weighted else F.lit(1)
    means = done.select(*[(F.sum(w * F.col("z")[i]) / n).alias(f"m{i}") for i in good]).first()
    off = done.select(w.alias("w"), *[(F.col("z")[i] - F.lit(means[f"m{i}"])).alias(f"c{i}") for i in good])
    pairs = [(i, j) for i in good for j in good if i <= j]
    row = off.select(*[(F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")) / n).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"v{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, most: int = COMPONENTS, weighted: bool = True, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error. The fit runs while this
    is built."""
    spark = vectors.sparkSession
    some = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0))
    rows = some.select(F.col(id).cast("long").alias("vec_id"), F.size(vector).alias("dims"), floored(F.col(vector), SCALE, SHIFT).alias("x"))
    distinct = staged(rows.groupBy("dims", "x").agg(F.count("*").alias("n")))
    sizes = [r[0] for r in distinct.select("dims").distinct().limit(101).collect()]
    if len(sizes) > 100:
        raise ValueError("vectors of more than a hundred lengths")
    done = []
    for size in sorted(sizes):
        own = distinct.where(F.col("dims") == size)
        n, sums = totals(own, size, weighted)
        v = covariance(own, size, n, sums, weighted)
        e, u = components(v, most)
        least = max(float(np.trace(v)), 0.0) * size * np.finfo(float).eps
        white = staged(projected(own, n, sums, e, u, least))
        good = np.flatnonzero(e > least).tolist()
        error = identity_error(white, good, n, weighted)
        share = [float(x / np.trace(v)) if x > least else None for x in e]
        count = white.agg(F.sum("n")).first()[0]
        hot = white.where(F.col("n") * HOT > count)
        mine, columns = rows.where(F.col("dims") == size), ["vec_id", "deviation", "z"]
        joined = mine.join(F.broadcast(hot), "x").select(*columns)
        joined = joined.union(mine.join(F.broadcast(hot.select("x")), "x", "left_anti").join(white.where(F.col("n") * HOT <= count), "x").select(*columns))
        each = joined.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
        shares = F.get(F.array(*[F.lit(x).cast("double") for x in share]), F.col("at"))
        done.append(each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error")))
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return reduce(DataFrame.union, done, none)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
