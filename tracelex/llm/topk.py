"""Operator 11: exact top-k search by inner product, with multi-resolution segment statistics.

A vector of integers is cut into 1, 4, 16, ... segments. With a segment's mean and standard deviation on both sides, the
squared distance of two vectors is at least the sum over segments of length * ((difference of means)^2 + (difference of
deviations)^2), and with the norms known, that is the same as a greatest inner product: sum of length * (mean * mean +
deviation * deviation). Coarse to fine, candidates whose greatest score is below the query's k-th best so far are left
out; survivors get their exact score.

Vectors are packed some thousand to a row. Queries are dealt to blocks by hash, and a block's queries meet all candidates
in `lanes` tasks: each holds one block of queries, lets its share of the candidates stream by, keeps k hits a query, and
the lanes' hits are merged. A block is bounded in bytes, so memory doesn't depend on the tables; candidates are sent once for
each block of queries. Bounds are of floats and are widened by more than their rounding; scores are exact.

Cases: vectors that are null or hold null, infinite or NaN components take no part; a query meets the vectors of its own
length; no row with a query's id is its candidate; rows that repeat an id are vectors of their own; a null id is no query and
loses ties; empty vectors score 0; fewer than k candidates give as many rows; an empty table gives an empty one; other
columns are not looked at. Scores that could leave 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelex.llm.common import table

#: Bytes and rows of a packed row of vectors, bytes of the queries of a block, queries that meet a packed row at once.
PACK_BYTES, PACK_ROWS, BLOCK_BYTES, TILE = 1 << 18, 1024, 16 << 20, 1024

#: Numbers of segments, coarse to fine.
SEGMENTS = (1, 4, 16)

NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or NaN component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def floored(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * x) + shift of every component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))


class Level:
    """Means and deviations of all segments of a matrix of vectors, each times the root of the segment's length."""

    def __init__(self, x: np.ndarray, n: int):
        edges = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
        size = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / size
        spread = np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1))
        self.values = np.hstack([mean * np.sqrt(size), spread])


class Vectors:
    """A matrix of vectors of one length, their ids, norms and levels."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        self.norm = np.sqrt((self.x**2).sum(1))
        self.levels = [Level(self.x, n).values for n in SEGMENTS] if x.shape[1] else []


class Search:
    """A block's queries of one length and their best hits so far."""

    def __init__(self, rows: np.ndarray, queries: Vectors, k: int):
        self.rows, self.q, self.k = rows, queries, k
        self.score = np.full((len(rows), k), -np.inf)
        self.hit = np.full((len(rows), k), NO_ID)
        self.found = np.zeros((len(rows), k), bool)

    def meet(self, c: Vectors) -> None:
        if self.q.x.shape[1] * np.abs(self.q.x).max(initial=0) * np.abs(c.x).max(initial=0) >= 2**53:
            raise ValueError("inner products of these vectors aren't exact in a double")
        for start in range(0, len(self.rows), TILE):
            self.tile(slice(start, start + TILE), c)

    def tile(self, part: slice, c: Vectors) -> None:
        q, least, slack = self.q, self.score[part, -1], 1e-9 * np.outer(self.q.norm[part], c.norm) + 1e-6
        alive = q.ids[part][:, None] != c.ids
        rows, cols = np.arange(alive.shape[0]), np.arange(len(c.ids))
        for mine, theirs in zip(q.levels, c.levels, strict=True):
            greatest = mine[part][rows] @ theirs[cols].T + slack[np.ix_(rows, cols)]
            alive = alive & (greatest >= least[rows][:, None])
            some, which = alive.any(1), alive.any(0)
            rows, cols, alive = rows[some], cols[which], alive[np.ix_(some, which)]
            if not len(rows):
                return
        score = q.x[part][rows] @ c.x[cols].T
        alive &= score >= least[rows][:, None]
        r, at = np.nonzero(alive)
        if not len(r):
            return
        # The new hits beside the old ones: by query, then score, then id; the first k stay.
        some, place = np.unique(r, return_inverse=True)
        mine = rows[some] + part.start
        owner = np.concatenate([place, np.repeat(np.arange(len(some)), self.k)])
        scores = np.concatenate([score[r, at], self.score[mine].ravel()])
        ids = np.concatenate([c.ids[cols[at]], self.hit[mine].ravel()])
        found = np.concatenate([np.ones(len(r), bool), self.found[mine].ravel()])
        order = np.lexsort((ids, -scores, owner))
        first = np.searchsorted(owner[order], np.arange(len(some)))
        order = order[first[:, None] + np.arange(self.k)]
        self.score[mine], self.hit[mine], self.found[mine] = scores[order], ids[order], found[order]

    def batch(self) -> pa.RecordBatch:
        at = np.nonzero(self.found)
        ids = self.hit[at]
        return pa.RecordBatch.from_arrays([
            pa.array(self.rows[at[0]]), pa.array(self.q.ids[at[0]]), pa.array(ids, mask=ids == NO_ID), pa.array(self.score[at].astype(np.int64)),
        ], ["row", "query_id", "vec_id", "score"])


PACKED = "size int, row array<long>, id array<long>, x binary"


def packed(df: DataFrame) -> DataFrame:
    """(row, id, x) some thousand vectors of one length to a row; x as 64-bit integers, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def row(size: int) -> pa.RecordBatch:
            rows, ids, x = zip(*waiting.pop(size), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(x)])], ["size", "row", "id", "x"]
            )

        for batch in batches:
            x = batch.column("x")
            flat, at = x.flatten().to_numpy(), np.cumsum(np.append(0, x.value_lengths().to_numpy()))
            for i, (r, d) in enumerate(zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                size = int(at[i + 1] - at[i])
                some = waiting.setdefault(size, [])
                some.append((r, d, flat[at[i] : at[i + 1]].astype("<i8").tobytes()))
                if len(some) >= PACK_ROWS or len(some) * size * 8 >= PACK_BYTES:
                    yield row(size)
        for size in list(waiting):
            yield row(size)

    return df.select("row", "id", "x").mapInArrow(run, PACKED)


def unpacked(size: int, ids: list, x: bytes) -> Vectors:
    return Vectors(np.array([NO_ID if i is None else i for i in ids], np.int64), np.frombuffer(x, "<i8").reshape(len(ids), size))


def streamed(k: int):
    """Packed rows sorted by (block, lane, kind), a block's queries (0) before its candidates (1): hits of each lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, searches = None, {}, None

        def hits() -> Iterator[pa.RecordBatch]:
            for s in (searches or {}).values():
                yield s.batch()

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["lane"]) != key:
                    yield from hits()
                    key, waiting, searches = (r["block"], r["lane"]), {}, None
                if r["kind"] == 0:
                    waiting.setdefault(r["size"], []).append((r["row"], r["id"], r["x"]))
                    continue
                if searches is None:
                    searches = {n: Search(np.concatenate([x[0] for x in w]), unpacked(n, sum((x[1] for x in w), []), b"".join(x[2] for x in w)), k) for n, w in waiting.items()}
                if r["size"] in searches:
                    searches[r["size"]].meet(unpacked(r["size"], r["id"], r["x"]))
        yield from hits()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best of `vectors` for every row of `queries` by inner product of floor(scale * x): query_id, rank, vec_id,
    score. Two counts run while this is built, of rows and of the longest query; they only set the number of blocks and lanes."""
    spark = vectors.sparkSession
    n_vectors, cores = vectors.count(), spark.sparkContext.defaultParallelism
    n_queries, longest = queries.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()

    def made(df: DataFrame, rows: int) -> DataFrame:
        made = df.where(usable(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), floored(F.col(vector), scale).alias("x"))
        return packed(made.coalesce(max(1, -(-rows // PACK_ROWS))))

    few, many = made(queries.where(F.col(id).isNotNull()), n_queries), made(vectors, n_vectors)
    blocks = max(1, -(-n_queries * max(longest, 1) * 8 // BLOCK_BYTES))
    lanes = max(1, min(-(-4 * cores // blocks), -(-n_vectors // PACK_ROWS)))
    few = few.select(F.lit(0).alias("kind"), F.pmod(F.xxhash64("x", "row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "size", "row", "id", "x")
    many = many.select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("x", "row"), F.lit(lanes)).cast("int").alias("lane"), "size", "row", "id", "x")
    met = few.union(many).repartition("block", "lane").sortWithinPartitions("block", "lane", "kind")
    hits = met.mapInArrow(streamed(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = """WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM x q JOIN x v ON v.vec_id IS DISTINCT FROM q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5"""
