"""Hashes of sequences and matrices against plain Python."""

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelex.operators import fingerprint as P

NAMES = ["a", "b", "c"]


def matrix(spark, rows, by="m"):
    return spark.createDataFrame([(by, i, *r) for i, r in enumerate(rows)], "m string, pos long, a double, b double, c double").repartition(3)


def print_of(spark, rows, **more):
    return [tuple(r) for r in P.matrix_fingerprint(matrix(spark, rows), NAMES, "m", **more).collect()]


def plain(rows, dtype="<f8", block=P.BLOCK):
    """The tree by hand: numpy bytes, block by block, then 1,024 hashes at a time."""
    def bits(x):
        return P.NULL_BITS[dtype] if x is None else int(np.array([x], dtype).view(f"<u{dtype[-1]}")[0])

    level = []
    for start in range(0, len(rows), block):
        part = np.array([[bits(x) for x in r] for r in rows[start : start + block]], f"<u{dtype[-1]}")
        head = json.dumps({"block": start // block, "shape": list(part.shape), "dtype": dtype}, sort_keys=True, separators=(",", ":"))
        level.append(hashlib.sha256(head.encode() + b"\n" + part.tobytes()).hexdigest())
    for _ in range(P.LEVELS):
        level = [hashlib.sha256("\n".join(level[i : i + P.FAN]).encode()).hexdigest() for i in range(0, len(level), P.FAN)]
    head = json.dumps({"block": block, "columns": NAMES, "dtype": dtype, "rows": len(rows)}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256((head + "\n" + "\n".join(level)).encode()).hexdigest()


ROWS = [(0.1 * i, -float(i), 1e-300 * i) for i in range(57)] + [(None, 1.0, math.nan), (1.0, None, -0.0)]


@pytest.mark.parametrize("dtype,block", [("<f8", P.BLOCK), ("<f8", 10), ("<f8", 1), ("<f4", 10)])
def test_fingerprint_is_the_tree_by_hand(spark, monkeypatch, dtype, block):
    monkeypatch.setattr(P, "FAN", 4)
    rows = ROWS if dtype == "<f8" else [tuple(None if x is None else round(x * 4) / 4 if x == x else x for x in r) for r in ROWS]
    assert print_of(spark, rows, dtype=dtype, block=block) == [("m", len(rows), True, plain(rows, dtype, block))]


@pytest.mark.parametrize("one,other", [((0.1, 0.0, 0.0), (0.1000003, 0.0, 0.0)), ((None, 1.0, 0.0), (1.0, None, 0.0)), ((0.0, 0.0, 0.0), (-0.0, 0.0, 0.0)), ((None, 0.0, 0.0), (math.nan, 0.0, 0.0)), ((0.1, 0.0, 0.0), (0.1 + 2e-17, 1e-320, 0.0))])
def test_small_differences_show(spark, one, other):
    assert print_of(spark, [one]) != print_of(spark, [other])


def test_names_type_and_order_show(spark):
    df = matrix(spark, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)])
    own = lambda df, names=NAMES, **more: P.matrix_fingerprint(df, names, "m", **more).first().sha256
    turned = df.withColumn("pos", 1 - F.col("pos"))
    assert len({own(df), own(df, ["a", "c", "b"]), own(df, ["a", "b"]), own(df, dtype="<f4"), own(df, block=1), own(turned)}) == 6
    assert own(df) == own(df.withColumn("block", F.lit(9)).withColumn("sha256", F.lit("x")))


def test_wrong_positions_show(spark):
    df = matrix(spark, [(1.0, 2.0, 3.0)] * 4)
    for bad in (df.where("pos <> 2"), df.where("pos > 0"), df.withColumn("pos", F.when(F.col("pos") == 3, 2).otherwise(F.col("pos"))), df.withColumn("pos", F.when(F.col("pos") < 3, F.col("pos")))):
        assert not P.matrix_fingerprint(bad, NAMES, "m", block=2).first().shape_ok
    assert P.matrix_fingerprint(df, NAMES, "m", block=2).first().shape_ok and P.matrix_fingerprint(df.limit(0), NAMES, "m").collect() == []


def test_differences_name_their_blocks(spark):
    rows = [(float(i), None if i % 7 == 0 else 1.0, 0.5) for i in range(50)]
    changed = [(x if i != 23 else x + 1e-12, y, z) for i, (x, y, z) in enumerate(rows)][:45]
    a, b = (P.leaves(matrix(spark, r), NAMES, "m", block=10) for r in (rows, changed))
    assert sorted(map(tuple, P.differing(a, b, "m").collect())) == [("m", 2, 10, 10), ("m", 4, 10, 5)] and P.differing(a, a, "m").collect() == []


def test_plain_hashes_of_small_ones(spark):
    df = spark.createDataFrame([("x", 1, "b"), ("x", 0, "a"), ("y", 0, "é")], "k string, pos int, v string")
    assert {r.k: (r.n, r.sha256) for r in P.plain_sequences(df, "k", "v").collect()} == {k: (v.count("\n") + 1, hashlib.sha256(v.encode()).hexdigest()) for k, v in (("x", "a\nb"), ("y", "é"))}
    t = pa.table({"a": [0.1, 0.2], "b": [1.0, 2.0]})
    want = hashlib.sha256(b'{"dtype":"<f8","shape":[2,2]}\n' + np.array([[0.1, 1.0], [0.2, 2.0]], "<f8").tobytes()).hexdigest()
    assert P.matrix_sha256(t, ["a", "b"]) == want


def test_sequences_in_rows_are_the_plain_ones_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["é"])], "k int, w array<string>")
    got = P.row_sequences(rows, "k", "w")
    want = P.plain_sequences(rows.select("k", F.posexplode("w").alias("pos", "v")), "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
