"""Boosted trees against the same rules in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelex.operators import boosting as B


def table(n=120, columns=5, seed=8):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        bins = [rng.choice([0, 0, 0, *range(1, B.BINS + 1)]) for _ in range(columns)]
        y = 0 if bins[0] > 6 else 1 if bins[1] + bins[2] > 9 else 2
        rows.append((bytes(bins), y if rng.random() < 0.9 else rng.randrange(3), rng.choice([0.5, 1.0, 2.0])))
    return rows


def softmax(s):
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


def plain(rows, ids, columns, classes, rounds, depth, rate, seed):
    """One split after the other, by loops over rows, columns and bins."""
    score, trees = [[0.0] * classes for _ in rows], []
    for step in range(rounds):
        used = B.chosen(columns, seed, step, 0.8).tolist()
        take = B.drawn(np.array(ids), seed, step, 0.8)
        grown = []
        for k in range(classes):
            g, h = [], []
            for (_, y, w), s in zip(rows, score, strict=True):
                p = softmax(s)[k]
                g.append(w * (p - (y == k)))
                h.append(w * max(2 * p * (1 - p), 1e-16))
            nodes, tree = {0: [i for i in range(len(rows)) if take[i]]}, {}
            for node in range(2 ** (depth + 1) - 1):
                if node not in nodes:
                    continue
                own = nodes[node]
                total = sum(g[i] for i in own), sum(h[i] for i in own)
                tree[node] = [-1, 0, -total[0] / (total[1] + B.LAMBDA)]
                if 2 * node + 2 >= 2 ** (depth + 1) - 1:
                    continue
                best = (0.0, None)
                for c in used:
                    for b in range(B.BINS):
                        left = [i for i in own if rows[i][0][c] <= b]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = total[0] - gl, total[1] - hl
                        if hl >= B.LEAST and hr >= B.LEAST:
                            gain = round(gl**2 / (hl + B.LAMBDA) + gr**2 / (hr + B.LAMBDA) - total[0] ** 2 / (total[1] + B.LAMBDA), 9)
                            if gain > best[0]:
                                best = (gain, (c, b))
                if best[1]:
                    c, b = best[1]
                    tree[node][:2] = [c, b]
                    nodes[2 * node + 1] = [i for i in own if rows[i][0][c] <= b]
                    nodes[2 * node + 2] = [i for i in own if rows[i][0][c] > b]
            grown.append(tree)
        for i, (bins, _, _) in enumerate(rows):
            for k, tree in enumerate(grown):
                at = 0
                while tree[at][0] >= 0:
                    at = 2 * at + 1 + (bins[tree[at][0]] > tree[at][1])
                score[i][k] += rate * tree[at][2]
        trees.append(grown)
    return trees, score


@pytest.mark.parametrize("stored,block", [(20, 256), (1, 2)])
def test_trees_are_the_loops(spark, monkeypatch, stored, block):
    """Also with columns in blocks, and scores stored after every round."""
    monkeypatch.setattr(B, "STORED", stored)
    monkeypatch.setattr(B, "COLUMNS", block)
    rows = table()
    df = spark.createDataFrame(rows, "bins binary, y int, weight double").coalesce(1)
    ids = [r.i for r in df.select(F.monotonically_increasing_id().alias("i")).collect()]
    want, score = plain(rows, ids, 5, 3, 3, 3, 0.3, 7)
    got = B.fit(df, 5, 3, rounds=3, depth=3, rate=0.3, seed=7)
    for step in range(3):
        for k in range(3):
            tree = got[k][step]
            for node, (column, cut, value) in want[step][k].items():
                assert (tree.column[node], tree.cut[node] if column >= 0 else 0) == (column, cut) and abs(tree.value[node] - value) < 1e-9
            assert (tree.column >= 0).sum() == sum(c >= 0 for c, _, _ in want[step][k].values())
    said = [r.y_pred for r in B.predict(df, got, 0.3, ["y"]).collect()]
    assert said == [int(np.argmax(s)) for s in score] and sum(a == r[1] for a, r in zip(said, rows, strict=True)) > 90


@pytest.mark.parametrize("sparse,direct,pack", [(0, 0, 8), (10**9, 0, 8), (10**9, 1 << 30, 10**6)])
def test_sums_of_packed_blocks(spark, monkeypatch, sparse, direct, pack):
    """The same trees whether cells are held densely or by number, added where they meet or by the driver, in blocks of few
    rows or in one; columns and rows without an entry take up nothing."""
    for name, value in (("SPARSE", sparse), ("DIRECT", direct), ("PACK", pack), ("ROWS", 8), ("STORED", 1), ("COLUMNS", 2)):
        monkeypatch.setattr(B, name, value)
    rows = table(60, 4)
    df = spark.createDataFrame([(b + bytes(3), y, w) for b, y, w in rows], "bins binary, y int, weight double").coalesce(1)
    ids = [r.i for r in df.select(F.monotonically_increasing_id().alias("i")).collect()]
    want, _ = plain([(b + bytes(3), y, w) for b, y, w in rows], ids, 7, 3, 2, 3, 0.3, 5)
    for step, got in enumerate(zip(*B.fit(df, 7, 3, rounds=2, depth=3, rate=0.3, seed=5), strict=True)):
        for k, tree in enumerate(got):
            assert all((tree.column[n], tree.cut[n] if c >= 0 else 0) == (c, b) and abs(tree.value[n] - v) < 1e-9 for n, (c, b, v) in want[step][k].items())
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row": [0, 1], "bins": [bytes(5000), b"\x00\x07" + bytes(4998)], "y": pa.array([0, 1], pa.int32()), "weight": [1.0, 1.0]})
    block = next(B.packed(5000, 3)(iter([batch])))
    assert block.nbytes < 500 and np.frombuffer(block.column("cell")[0].as_py(), np.int32).tolist() == [B.BINS + 1 + 7]


def test_bins_of_values(spark):
    values = [(0, float(x)) for x in range(1, 101)] + [(1, 5.0)] * 20 + [(3, -1.0), (3, 2.0)]
    edges = B.bin_edges(spark.createDataFrame(values, "column int, value double"), 4)
    assert [len(e) for e in edges] == [B.BINS - 1, 1, 0, 2]
    x = np.array([[0, 5, 0, 0], [1, 6, 9, -1], [100, 4, 0, 2], [50, 0, 0, 3]], float)
    bins = B.binned(x, edges)
    assert bins[:, 0].tolist() == [0, 1, B.BINS, 1 + int((edges[0] < 50).sum())] and bins[:, 1].tolist() == [1, 2, 1, 0] and bins[1, 2] == 1 and bins[:, 3].tolist() == [0, 1, 2, 3]


def test_draws_are_seeded_shares():
    rows = np.arange(20_000)
    a = B.drawn(rows, 1, 0, 0.8)
    assert abs(a.mean() - 0.8) < 0.02 and (a == B.drawn(rows, 1, 0, 0.8)).all() and 0.2 < (a != B.drawn(rows, 1, 1, 0.8)).mean() < 0.45
    assert len(B.chosen(10, 1, 0, 0.8)) == 8 and set(B.chosen(1, 1, 0, 0.8)) == {0}


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(b"\x01", 0, 1.0)] * 3, "bins binary, y int, weight double")
    assert [r.y_pred for r in B.predict(df, B.fit(df, 1, 1, 2, 2), 0.1, ["y"]).collect()] == [0, 0, 0]
    with pytest.raises(ValueError, match="no rows"):
        B.fit(df.limit(0), 1, 3)


def test_only_entries_are_gone_through(spark):
    """Sums over the bins that aren't 0 and what is left are those over all; edges are values that rows have, to the bit."""
    rng = np.random.default_rng(6)
    bins = np.where(rng.random((50, 30)) < 0.1, rng.integers(1, B.BINS + 1, (50, 30)), 0).astype(np.uint8)
    used, use = np.array([1, 4, 7, 29]), rng.random(50) < 0.7
    column = np.full(30, -1)
    column[used] = np.arange(4) * (B.BINS + 1)
    row, cell = B.entries(bins, column, use)
    want = [(i, j * (B.BINS + 1) + bins[i, c]) for i in range(50) if use[i] for j, c in enumerate(used) if bins[i, c]]
    assert list(zip(row, cell)) == want and 0 < len(want) < 50
    rows = spark.createDataFrame([([i % 7, (i * 5) % 11, (i * i) % 13], [float(i % 3)]) for i in range(60)], "places array<int>, semantic array<double>").coalesce(1)
    idf = np.linspace(1.0, 2.0, 13)
    edges = B.bin_edges(B.filled(rows, idf), 14)
    import pyarrow as pa

    x = B.linear.dense(pa.RecordBatch.from_pylist(rows.toPandas().to_dict("records"), pa.schema([("places", pa.list_(pa.int32())), ("semantic", pa.list_(pa.float64()))])), idf)
    assert all(set(e) <= set(x[:, c]) for c, e in enumerate(edges)) and [len(e) > 0 for e in edges] == (x != 0).any(0).tolist()
