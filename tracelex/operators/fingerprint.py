"""Hashes of ordered sequences and matrices: plain ones of short sequences, and a tree of hashes for any size.

A matrix is hashed as its bytes: little-endian floats in row order, in blocks of positions, each after a header of its own.
Blocks' hashes are hashed FAN at a time, LEVELS times, and a last header names columns, type and shape. So two matrices
have one hash only if every cell has the same bits in the same place, no row holds more than a block, and the blocks in
which two matrices differ are known from their leaves.

Cases: a null is a NaN of its own bits, so that it neither equals a NaN nor changes places unseen; 0.0 and -0.0 differ; a
position that is missing, null or repeated makes shape_ok false, and rows with a repeated one are ordered by their bytes;
an empty matrix has no row in the result; columns beside the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a block, hashes under a node, levels of nodes above the blocks.
BLOCK, FAN, LEVELS = 100_000, 1024, 3

#: The bits of a null, by type.
NULL_BITS = {"<f8": 0x7FF8000000000001, "<f4": 0x7FC00001}


def plain_sequences(rows: DataFrame, by: str, value: str, pos: str = "pos") -> DataFrame:
    """by, n, sha256 of the values joined by newlines in order of pos: for sequences that fit in a row each (feature orders,
    the words of a text)."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]), "\n")
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.sha2(ordered, 256).alias("sha256"))


def row_sequences(rows: DataFrame, by: str, values: str) -> DataFrame:
    """The same for sequences that are arrays in their rows already (the words of a text): nothing is shuffled. Empty and
    null arrays have no row; rows that share `by` are sequences of their own; nulls in an array are left out."""
    return rows.where(F.size(values) > 0).select(by, F.size(F.filter(values, lambda x: x.isNotNull())).cast("long").alias("n"), F.sha2(F.array_join(values, "\n"), 256).alias("sha256"))


def header(**fields) -> bytes:
    return json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()


def cell_bytes(table: pa.Table, names: list[str], dtype: str) -> np.ndarray:
    """Rows of little-endian cells as unsigned integers of the type's width."""
    bits = []
    for name in names:
        column = table.column(name).combine_chunks()
        values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype).view(f"<u{dtype[-1]}").copy()
        values[column.is_null().to_numpy(zero_copy_only=False)] = NULL_BITS[dtype]
        bits.append(values)
    return np.stack(bits, axis=1) if bits else np.zeros((table.num_rows, 0), f"<u{dtype[-1]}")


def matrix_sha256(table: pa.Table, names: list[str], dtype: str = "<f8") -> str:
    """The hash of a small matrix in one piece: a header with shape and type, and all its bytes."""
    bits = cell_bytes(table, names, dtype)
    return hashlib.sha256(header(shape=list(bits.shape), dtype=dtype) + b"\n" + bits.tobytes()).hexdigest()


def leaf(names: list[str], by: str, dtype: str) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits, pos = cell_bytes(table, names, dtype), table.column("_pos").to_numpy(zero_copy_only=False)
        order = np.lexsort((*(bits[:, k] for k in reversed(range(bits.shape[1]))), pos))
        bits, pos = bits[order], pos[order]
        sha = hashlib.sha256(header(block=key[1].as_py(), shape=list(bits.shape), dtype=dtype) + b"\n" + bits.tobytes()).hexdigest()
        whole = bool((np.diff(pos) == 1).all())
        return pa.table({by: [key[0].as_py()], "block": [key[1].as_py()], "n_rows": [len(pos)], "first": [int(pos[0])], "last": [int(pos[-1])], "whole": [whole], "sha256": [sha]})

    return run


def leaves(matrix: DataFrame, names: list[str], by: str, pos: str = "pos", dtype: str = "<f8", block: int = BLOCK) -> DataFrame:
    """by, block, n_rows, first, last, whole (no gap or repeat), sha256 of each block of positions. A null position counts
    in block -1. by is a text."""
    kind = "double" if dtype == "<f8" else "float"
    at = F.coalesce(F.col(pos).cast("long"), F.lit(-1))
    rows = matrix.select(F.col(by).cast("string").alias(by), at.alias("_pos"), F.floor(at / block).cast("long").alias("block"), *[F.col(n).cast(kind).alias(n) for n in names])
    return rows.groupBy(by, "block").applyInArrow(leaf(names, by, dtype), f"`{by}` string, block long, n_rows long, first long, last long, whole boolean, sha256 string")


def root(blocks: DataFrame, names: list[str], by: str, dtype: str = "<f8", block: int = BLOCK) -> DataFrame:
    """by, n_rows, shape_ok, sha256 of each matrix from its leaves."""
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "sha256"))), lambda x: x["sha256"]), "\n")
    node = blocks.select(by, F.col("block").alias("_at"), "sha256")
    for _ in range(LEVELS):
        node = node.groupBy(by, F.floor(F.col("_at") / FAN).alias("_up")).agg(F.sha2(joined("_at"), 256).alias("sha256")).withColumnRenamed("_up", "_at")
    top = node.groupBy(by).agg(joined("_at").alias("_top"))
    n = F.sum("n_rows")
    shape = blocks.groupBy(by).agg(n.alias("n_rows"), (F.bool_and("whole") & (F.min("first") == 0) & (F.max("last") == n - 1)).alias("shape_ok"))
    told = json.dumps({"block": block, "columns": names, "dtype": dtype, "rows": -1}, sort_keys=True, separators=(",", ":"))
    head = F.replace(F.lit(told), F.lit('"rows":-1'), F.concat(F.lit('"rows":'), F.col("n_rows").cast("string")))
    return top.join(shape, by).select(by, "n_rows", "shape_ok", F.sha2(F.concat(head, F.lit("\n"), "_top"), 256).alias("sha256"))


def matrix_fingerprint(matrix: DataFrame, names: list[str], by: str, pos: str = "pos", dtype: str = "<f8", block: int = BLOCK) -> DataFrame:
    """by, n_rows, shape_ok, sha256 of each matrix; `leaves` and `root` give the blocks' hashes too."""
    return root(leaves(matrix, names, by, pos, dtype, block), names, by, dtype, block)


def differing(one: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """by, block, n_rows, other_rows of the blocks in which two matrices differ, from their leaves; 0 rows where one has no
    such block."""
    a = one.select(by, "block", "n_rows", "sha256")
    b = other.select(by, "block", F.col("n_rows").alias("other_rows"), F.col("sha256").alias("_other"))
    both = a.join(b, [by, "block"], "full_outer").where(~F.col("sha256").eqNullSafe(F.col("_other")))
    return both.select(by, "block", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("other_rows", F.lit(0)).alias("other_rows"))
