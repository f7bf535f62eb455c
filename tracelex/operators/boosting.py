"""Multi-class gradient boosting with second-order splits over binned columns.

Every column is cut into at most BINS bins: zero has its own, the others end at quantiles of what isn't zero (a sketch that
Spark merges). A row is then a byte a column, of which those that aren't 0 are packed once in blocks of rows. Each round grows
one tree for each class, level by level; a level is one pass over the blocks: tasks add up gradients and hessians by class, node,
column and bin, the sums of a block of columns are added and give its best splits where they meet, and the driver sees one
candidate for each node and block (few enough sums are added there at once). Scores are stored with the blocks every STORED
rounds, so that a pass only looks at the trees since.

Gradients are those of weighted log loss over a softmax, leaves are -G / (H + 1) times the rate, a child needs a hessian of
at least 1, and a split a gain. Rows and columns are drawn anew in each round, by hash of row and round and by a seeded
permutation; ties go to the lesser column, then bin.

Cases: null columns are 0; rows without a label aren't trained on; a single class gets every row; a column with one value
is never split; no training rows are an error; repeated rows count as often as they stand (row ids are given anew).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelex.operators import linear
from tracelex.sources import files

#: Bins of a column besides that of zero, columns in a block, rounds between stored scores, rows of a batch at once, and of
#: a packed block; bytes of all tasks' sums up to which the driver adds them itself; cells for an entry from which on only
#: those that have some are held.
BINS, COLUMNS, STORED, ROWS, PACK, DIRECT, SPARSE = 15, 1024, 5, 1024, 16384, 4 << 20, 8

#: Added to a node's hessian, and least hessian of a child.
LAMBDA, LEAST = 1.0, 1.0


@dataclass
class Tree:
    """A node i has the children 2i + 1 and 2i + 2; column -1 marks a leaf. Rows with a bin up to `cut` go left."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where each row ends."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(int(np.log2(len(self.column) + 1)) - 1):
            inner = self.column[at] >= 0
            right = bins[rows, np.maximum(self.column[at], 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def bin_edges(values: DataFrame, columns: int) -> list[np.ndarray]:
    """values: column, value of all that isn't 0. The distinct quantiles of each column, by which its bins end."""
    at = F.percentile_approx("value", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), F.lit(10_000))
    found = {r.column: r.q for r in values.groupBy("column").agg(at.alias("q")).collect()}  # BINS numbers a column
    return [np.unique(found.get(c, [])) for c in range(columns)]


def filled(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """column, value of all that isn't 0 in rows with places and semantic, to the bit as `byte_rows` sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, linear.ROWS):
                x = linear.dense(whole.slice(start, linear.ROWS), idf)
                row, column = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int32()), pa.array(x[row, column])], ["column", "value"])

    return rows.select("places", "semantic").mapInArrow(run, "column int, value double")


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """0 for zero, else 1 + the number of edges below the value; a column's order is that of its values only beside zero."""
    out = np.zeros(x.shape, np.uint8)
    for c in np.flatnonzero((x != 0).any(0)):
        out[:, c] = np.where(x[:, c] != 0, 1 + np.searchsorted(edges[c], x[:, c], side="left"), 0)
    return out


def drawn(row: np.ndarray, seed: int, step: int, share: float) -> np.ndarray:
    """Whether each row takes part in a round: a mixed hash of row, seed and round, below the share."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + step) % 2**63)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return z / 2.0**64 < share


def chosen(columns: int, seed: int, step: int, share: float) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, step]).permutation(columns)[: max(1, int(share * columns))])


def slopes(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    h = np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None]
    p[np.arange(len(y)), y] -= 1
    return p * weight[:, None], h


def best_splits(hist: np.ndarray, node: np.ndarray, column: np.ndarray) -> dict[int, tuple[float, int, int, float, float, float, float]]:
    """By node: gain, column, cut, and G and H of both sides, of sums by bin (rows, bins, 2) for rows of node and column, in
    their order; gain 0 without a split."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    total = hist.sum(1, keepdims=True)
    right = total - left
    fits = lambda s: s[..., 0] ** 2 / (s[..., 1] + LAMBDA)
    gain = np.where((left[..., 1] >= LEAST) & (right[..., 1] >= LEAST), fits(left) + fits(right) - fits(total), 0.0)
    gain = np.round(gain, 9)
    cut = np.argmax(gain, axis=1)
    most = gain[np.arange(len(gain)), cut]
    first = np.lexsort((column, -most, node))
    first = first[np.unique(node[first], return_index=True)[1]]
    return {int(node[i]): (float(most[i]), int(column[i]), int(cut[i]), *left[i, cut[i]].tolist(), *right[i, cut[i]].tolist()) for i in first}


#: Columns of a packed block of rows (its rows' values, then its entries by row), and what their bytes are.
PACKED = {"row": np.int64, "y": np.int32, "weight": np.float64, "score": np.float64, "of": np.int32, "cell": np.int32}
FORM = ", ".join(f"`{c}` binary" for c in PACKED)


def packed(columns: int, classes: int) -> Callable:
    """Blocks of PACK rows, a record each: the bins that aren't 0 as row and cell (column * (BINS + 1) + bin). No pass reads
    the others."""
    first = np.arange(columns) * (BINS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
            of, cell = entries(matrix(b), first, np.ones(b.num_rows, bool))
            held.append([b.column("row").to_numpy(), b.column("y").to_numpy(), b.column("weight").to_numpy(), np.zeros(b.num_rows * classes), of + n, cell])
            n += b.num_rows
            if n >= PACK:
                yield record(dict(zip(PACKED, map(np.concatenate, zip(*held, strict=True)), strict=True)))
                held, n = [], 0
        if held:
            yield record(dict(zip(PACKED, map(np.concatenate, zip(*held, strict=True)), strict=True)))

    return run


def record(block: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([block[c].astype(t).tobytes()], pa.binary()) for c, t in PACKED.items()})


def block_of(values) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(v, t) for (c, t), v in zip(PACKED.items(), values, strict=True)}


def split_bins(block: dict[str, np.ndarray], trees: list[Tree], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the columns by which some tree splits, a row each, and from a column to its place there."""
    used = np.unique(np.concatenate([t.column for t in trees] or [np.zeros(0, int)]))
    used = used[used >= 0]
    place = np.full(columns, -1)
    place[used] = np.arange(len(used))
    out = np.zeros((len(block["row"]), max(1, len(used))), np.uint8)
    column = block["cell"] // (BINS + 1)
    mine = np.flatnonzero(place[column] >= 0)
    out[block["of"][mine], place[column[mine]]] = block["cell"][mine] % (BINS + 1)
    return out, place


def moved(tree: Tree, place: np.ndarray) -> Tree:
    """The same tree over the columns of `split_bins`."""
    return Tree(np.where(tree.column >= 0, place[tree.column], -1), tree.cut, tree.value)


def added(block: dict[str, np.ndarray], trees: list[list[Tree]], rate: float, bins: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Scores of a block's rows with the trees' values."""
    score = block["score"].reshape(len(block["row"]), -1)
    return score + rate * np.stack([sum((t.value[moved(t, place).nodes(bins)] for t in own), np.zeros(len(bins))) for own in trees], 1)


def histograms(trees: list[list[Tree]], growing: list[Tree], open_: list[list[int]], columns: np.ndarray, rate: float, seed: int, step: int, share: float, most: int) -> Callable:
    """Sums of a task's blocks: for each class and block of COLUMNS columns ((class, start), (part, turn, cells, g, h,
    totals)), of the cells that have some. Only bins other than 0 are gone through; those of 0 are what is left of a node's total."""
    width = BINS + 1

    def run(part: int, records: Iterator) -> Iterator:
        nodes, blocks = [len(own) for own in open_], -(-len(columns) // COLUMNS)
        first = np.full(most, -1)
        first[columns] = np.arange(len(columns))
        lookup = [np.full(len(t.column), -1) for t in growing]
        for own, at in zip(open_, lookup, strict=True):
            at[own] = np.arange(len(own))
        size = COLUMNS * width
        flat: list = [None] * len(nodes)
        few: list[list] = [[] for _ in nodes]
        total = [np.zeros((2, n)) for n in nodes]
        for block in map(block_of, records):
            bins, place = split_bins(block, [t for own in trees for t in own] + growing, most)
            slope = slopes(added(block, trees, rate, bins, place), block["y"], block["weight"])
            use = drawn(block["row"], seed, step, share)
            column, bin_ = np.divmod(block["cell"], width)
            mine = np.flatnonzero((first[column] >= 0) & use[block["of"]])
            of, start, within = block["of"][mine], *np.divmod(first[column[mine]], COLUMNS)
            within = within * width + bin_[mine]
            for k, tree in enumerate(growing):
                if not nodes[k]:
                    continue
                at = np.where(use, lookup[k][moved(tree, place).nodes(bins)], -1)
                rows, node = np.flatnonzero(at >= 0), at[of]
                here = np.flatnonzero(node >= 0)
                key, by = (start[here] * nodes[k] + node[here]) * size + within[here], of[here]
                cells = nodes[k] * blocks * size
                sparse = len(key) * SPARSE < cells  # then only the cells that have an entry are numbered
                if sparse:
                    found, key = np.unique(key, return_inverse=True)
                    few[k].append([found])
                elif flat[k] is None:
                    flat[k] = np.zeros((2, cells))
                for j, x in enumerate(slope):
                    own = np.ascontiguousarray(x[:, k])
                    total[k][j] += np.bincount(at[rows], own[rows], nodes[k])
                    sums = np.bincount(key, own[by], len(found) if sparse else cells)
                    if sparse:
                        few[k][-1].append(sums)
                    else:
                        flat[k][j] += sums
        for k, n in enumerate(nodes):
            if flat[k] is not None:
                found = np.flatnonzero(flat[k][1])
                few[k].append([found, *flat[k][:, found]])
            for turn, (found, g, h) in enumerate(few[k]):
                ends = np.searchsorted(found, np.arange(blocks + 1) * n * size)
                for i, (a, z) in enumerate(zip(ends, ends[1:])):
                    yield (k, i * COLUMNS), (part, turn, (found[a:z] - i * n * size).astype(np.int32), g[a:z], h[a:z], total[k] * (turn == 0))

    return run


@dataclass
class Candidate:
    """A block's best split of a node, and the node's G and H."""

    gain: float
    column: int
    cut: int
    gl: float
    hl: float
    gr: float
    hr: float
    g: float
    h: float


def candidates(open_: list[list[int]], columns: np.ndarray) -> Callable:
    """From a class and block of columns with all tasks' sums to ((class, node), candidate) for each open node."""

    def run(keyed: tuple) -> Iterator[tuple[tuple[int, int], Candidate]]:
        (k, start), parts = keyed
        own, nodes, width = columns[start : start + COLUMNS], open_[k], BINS + 1
        parts = sorted(parts, key=lambda p: p[:2])  # the same sum whatever the order of arrival
        total = np.sum([p[5] for p in parts], axis=0)
        cells = np.concatenate([p[2] for p in parts])
        pairs, at = np.unique(cells // width, return_inverse=True)  # nodes and columns that have an entry
        key = at * width + cells % width
        hist = np.stack([np.bincount(key, np.concatenate([p[j] for p in parts]), len(pairs) * width).reshape(-1, width) for j in (3, 4)], 2)
        node, column = np.divmod(pairs, COLUMNS)
        hist[:, 0] = total.T[node] - hist[:, 1:].sum(1)  # what has no entry
        splits = best_splits(hist, node, own[column])
        for i, (g, h) in enumerate(total.T.tolist()):
            yield (k, nodes[i]), Candidate(*splits.get(i, (0.0, int(own[0]), 0, 0.0, 0.0, 0.0, 0.0)), g, h)

    return run


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The bins of a batch's rows, without a copy."""
    bins, n = batch.column("bins"), batch.num_rows
    ends = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset : bins.offset + n + 1]
    return np.frombuffer(bins.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(n, -1) if n else np.zeros((0, 1), np.uint8)


def entries(bins: np.ndarray, column: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of each bin that isn't 0, of the rows used and of columns that have a first cell (others: -1)."""
    row, at = np.nonzero(bins)
    keep = np.flatnonzero((column[at] >= 0) & use[row])
    row, at = row[keep], at[keep]
    return row, column[at] + bins[row, at]


def leaf(g: float, h: float) -> float:
    return -g / (h + LAMBDA)


def grow(growing: list[Tree], found: dict[tuple[int, int], list]) -> list[list[int]]:
    """Best of the blocks' candidates into the trees; the nodes that may be split next."""
    nxt: list[list[int]] = [[] for _ in growing]
    for (k, node), rows in sorted(found.items()):
        tree, best = growing[k], min(rows, key=lambda r: (-r.gain, r.column, r.cut))
        tree.value[node] = leaf(best.g, best.h)
        if best.gain > 0 and 2 * node + 2 < len(tree.column):
            tree.column[node], tree.cut[node] = best.column, best.cut
            tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(best.gl, best.hl), leaf(best.gr, best.hr)
            if 2 * (2 * node + 1) + 2 < len(tree.column):
                nxt[k] += [2 * node + 1, 2 * node + 2]
    return nxt


def fit(train: DataFrame, columns: int, classes: int, rounds: int = 300, depth: int = 6, rate: float = 0.1, rows_share: float = 0.8, columns_share: float = 0.8, seed: int = 42) -> list[list[Tree]]:
    """Trees by class and round. train: bins (a byte a column), y, weight. depth jobs run for each round."""
    spark = train.sparkSession
    kept = lambda df: files.through_parquet(df, files.scratch(spark))
    rows = train.select(F.monotonically_increasing_id().alias("row"), "bins", F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"))
    rows = kept(rows.mapInArrow(packed(columns, classes), FORM))
    size = rows.agg(F.sum(F.octet_length("cell"))).first()[0]
    if size is None:
        raise ValueError("no rows to train on")
    # A pass is a job over the stored blocks that needs no new plan; what it looks at is handed to its tasks.
    blocks, parts = rows.rdd, spark.sparkContext.defaultParallelism
    done: list[list[Tree]] = [[] for _ in range(classes)]
    fresh: list[list[Tree]] = [[] for _ in range(classes)]
    for step in range(rounds):
        growing, open_ = [Tree.empty(depth) for _ in range(classes)], [[0] for _ in range(classes)]
        used = chosen(columns, seed, step, columns_share)
        while any(open_):
            sums = blocks.mapPartitionsWithIndex(histograms(fresh, growing, open_, used, rate, seed, step, rows_share, columns))
            best = candidates(open_, used)
            if size * 5 * classes <= DIRECT:  # an entry's cell has 4 bytes of `size`, and 20 in the sums of each class
                by_key: dict[tuple[int, int], list] = {}
                for key, own in sums.collect():
                    by_key.setdefault(key, []).append(own)
                every = [c for item in by_key.items() for c in best(item)]
            else:
                every = sums.groupByKey(parts).flatMap(best).collect()  # one row a node and block
            found: dict[tuple[int, int], list] = {}
            for key, candidate in every:
                found.setdefault(key, []).append(candidate)
            open_ = grow(growing, found)
        for k, tree in enumerate(growing):
            fresh[k].append(tree)
        if len(fresh[0]) >= STORED and step + 1 < rounds:
            rows = kept(rows.mapInArrow(scored(fresh, rate, columns), FORM))
            blocks, done, fresh = rows.rdd, [a + b for a, b in zip(done, fresh, strict=True)], [[] for _ in fresh]
    return [a + b for a, b in zip(done, fresh, strict=True)]


def scored(trees: list[list[Tree]], rate: float, columns: int) -> Callable:
    """The same blocks with the trees' values added to their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = block_of(b.column(c)[i].as_buffer() for c in PACKED)
                bins, place = split_bins(block, [t for own in trees for t in own], columns)
                yield record(block | {"score": added(block, trees, rate, bins, place).ravel()})

    return run


def byte_rows(rows: DataFrame, idf: np.ndarray, edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """keep and bins of rows with places and semantic (as for `linear.dense`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, linear.ROWS):
                b = whole.slice(start, linear.ROWS)
                bins = binned(linear.dense(b, idf), edges)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([r.tobytes() for r in bins], pa.binary())], [*keep, "bins"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "places", "semantic").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", bins binary")


def predict(rows: DataFrame, trees: list[list[Tree]], rate: float, keep: list[str]) -> DataFrame:
    """keep and y_pred, the class with the highest score. rows: keep, bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = matrix(b)
            score = np.stack([rate * sum((t.value[t.nodes(bins)] for t in own), np.zeros(len(bins))) for own in trees], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score.argmax(1), pa.int32())], [*keep, "y_pred"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "bins").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", y_pred int")
