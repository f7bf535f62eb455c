"""Operator 8: sharding by a hypergeometric communication matrix.

A uniform shuffle of all rows into shards whose row counts are fixed beforehand (at most one apart):

1. a narrow table (row number inside its part, size, checksum) is written to the shared folder, so that every later
   step, and every repeated task, sees the same rows in the same parts;
2. the driver draws how many rows each part sends to each shard: a multivariate hypergeometric draw per part from
   what the shards have left. It holds one count for each part and shard, never a row;
3. each part deals its rows by a permutation of its own (rank by keyed hash) cut at its row of the matrix;
4. rows are exchanged by (shard, block), where a block is a class of a second keyed hash, and ranked in their block;
   adding the sizes of the blocks before gives gapless slots. No task holds more than a block.

`assign` returns the places; `write` moves the whole rows there.

Cases: null texts have 0 bytes and checksum 0; null and repeated ids are rows like others; an empty table gives an
empty result; columns named like the new ones are ignored by `assign`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelex.llm.common import staged, unused

BLOCK_ROWS = 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact draw; numpy's own takes at most 10**9 items, beyond which the ratio of uniforms is used."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    spread = math.sqrt(max(n * good * bad * (total - n) / (total * total * (total - 1)), 0.0) + 0.5)
    low, high = max(0, n - bad), min(n, good)

    def log_p(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, n - k, bad - n + k))

    mode = min(max(int((n + 1) * (good + 1) / (total + 2)), low), high)
    top, scale = log_p(mode), 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + scale * (v - 0.5) / u) if u > 0 else low - 1
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts of each part's rows for each shard: row sums are `rows`, column sums at most one apart."""
    rng, total = np.random.default_rng(seed), sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for s in range(shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, n)
            out[i, s], n, left[s] = k, n - k, left[s] - k
    return out


def _narrow(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, size, text_crc32, row, part (of the row)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), row.alias("row"))
    return narrow.withColumn("part", F.shiftrightunsigned("row", 33).cast("int"))


def _placed(rows: DataFrame, shards: int, seed: int, block_rows: int) -> DataFrame:
    """Staged narrow rows with shard, block and slot."""
    counts = rows.groupBy("part").count().orderBy("part").toPandas()
    sent = matrix(counts["count"].tolist(), shards, seed)
    ends = pd.DataFrame({"part": counts["part"], "ends": np.cumsum(sent, axis=1).tolist()})
    ends = rows.sparkSession.createDataFrame(ends, "part int, ends array<bigint>")
    key = lambda k: F.xxhash64(F.lit(seed), F.lit(k), F.col("row"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(key("local"), "row"))
    dealt = rows.withColumn("rank", local).join(ends, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank")))).drop("ends", "rank", "part")
    blocks = max(1, math.ceil(int(counts["count"].sum()) / shards / block_rows))
    order = key("slot")
    dealt = dealt.withColumn("block", F.pmod(F.shiftrightunsigned(order, 33), F.lit(blocks))).withColumn("order", order)
    dealt = staged(dealt.select("doc_id", "size", "text_crc32", "row", "shard", "block", "order"))
    before = dealt.groupBy("shard", "block").count()
    before = before.select(
        "shard", "block",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("order", "row")) - 1
    out = dealt.withColumn("rank", rank).join(before, ["shard", "block"])
    return out.withColumn("slot", (F.col("before") + F.col("rank")).cast("long")).drop("before", "rank", "order")


def assign(docs: DataFrame, shards: int = 24, seed: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each row of docs."""
    rows = staged(_narrow(docs.select("doc_id", "text"), F.monotonically_increasing_id()))
    return _placed(rows, shards, seed, block_rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = 24, seed: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write docs, all columns, as Parquet below path in folders shard=0, shard=1, ..., each shard in files of a block in the
    order of its slots; the column of slots has a name that docs doesn't have. Returns what was written, read again. The
    rows are exchanged by (shard, block) and never gathered by shard."""
    row, shard, slot = (unused(docs, n) for n in ("row", "shard", "slot"))
    own = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = staged(_narrow(own.select("doc_id", "text", F.col(row).alias("row")), F.col("row")))
    places = _placed(rows, shards, seed, block_rows).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot), F.col("block").alias("_b"))
    block = unused(own, "block")
    out = own.join(places.withColumnRenamed("_b", block), row).repartition(shard, block).sortWithinPartitions(shard, slot)
    out.drop(row, block).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)


def op8_shards(spark, sf_dir):
    from tracelex.llm.common import table

    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
