"""Multinomial logistic regressions of many feature sets, trained together.

All of them share the TF-IDF columns and differ in a mask over the semantic ones. Every step of all their searches is one
pass over the rows, which are packed once as blocks of the TF-IDF entries that aren't 0: a task multiplies a block with the
weights of all models at once, and gives back one sum of losses and gradients (beyond MANY tasks these are added in groups first). The searches (L-BFGS, each with its own memory and step) run on the
driver over these sums, whose size is that of the weights alone. A model whose gradient is small takes no further part.

Common terms go together with each other and with the intercept, so that plain searches take some hundred steps, and more
the more rows there are. One pass therefore adds up the weighted products of the columns first, which are the curvature at
weights of 0: the searches begin with its inverse, which all models share but for their few semantic columns. That changes
the way to the optimum, not the optimum, nor where a search ends.

The loss is that of a penalty C = 1: the weighted log losses plus half the squares of the weights, intercepts left out.
Training has no chance in it, so all seeds of a feature set are one model.

Cases: rows with a null label or outside the training split aren't trained on; null features are 0; a text without terms
has zeros; one label alone gives that label everywhere; no training rows are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelex.sources import files

#: Rows of a dense block, remembered steps of a search, the size of a gradient's entries, for each unit of weight, at which
#: it ends, and the tasks from which on their sums are added in groups before they reach the driver.
ROWS, MEMORY, TOLERANCE, MANY = 256, 10, 1e-4, 64

#: Columns of weights (models times classes) up to which a step works on the entries alone.
FEW = 12

#: The commonest terms whose products are added up (of the others only the squares), how many of them make a stripe, and
#: blocks multiplied at once.
CURVED, STRIPE, AT_ONCE = 5000, 64, 4


def dense(batch: pa.RecordBatch, idf: np.ndarray) -> np.ndarray:
    """TF-IDF columns of unit length, then the semantic ones. Columns: places (lists), semantic (lists)."""
    places, semantic = batch.column("places"), batch.column("semantic")
    n, size = batch.num_rows, len(idf)
    row = np.repeat(np.arange(n), places.value_lengths().to_numpy())
    tf = np.bincount(row * size + places.flatten().to_numpy(), minlength=n * size).reshape(n, size) * idf if size else np.zeros((n, 0))
    norm = np.sqrt((tf * tf).sum(1, keepdims=True))
    return np.hstack([tf / np.where(norm > 0, norm, 1), semantic.flatten().to_numpy().reshape(n, -1)])


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(models, rows, classes) of weights (models, columns + 1, classes), the last row of which are intercepts."""
    m, d, k = w.shape
    return (x @ w[:, :-1].transpose(1, 0, 2).reshape(d - 1, m * k)).reshape(len(x), m, k).transpose(1, 0, 2) + w[:, -1][:, None]


def cells(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The TF-IDF columns' entries that aren't 0: row, place, value."""
    lists, size = batch.column("places"), len(idf)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    at, n = np.unique(row * size + lists.flatten().to_numpy(), return_counts=True) if size else (np.zeros(0, np.int64), np.zeros(0))
    row, place = at // max(size, 1), at % max(size, 1)
    value = n * idf[place]
    norm = np.sqrt(np.bincount(row, value * value, batch.num_rows))
    return row, place, value / np.where(norm > 0, norm, 1)[row]


#: Columns of a packed block of rows, and what their bytes are.
PACKED = {"row": np.int32, "place": np.int32, "value": np.float64, "semantic": np.float64, "y": np.int32, "weight": np.float64}


def packed(idf: np.ndarray) -> Callable:
    """Blocks of ROWS rows, a record each: their entries and labels as bytes, so that a step reads numbers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                block = _block(whole.slice(start, ROWS), idf)
                yield pa.RecordBatch.from_pydict({c: pa.array([block[c].astype(t).tobytes()], pa.binary()) for c, t in PACKED.items()})

    return run


def _block(b: pa.RecordBatch, idf: np.ndarray) -> dict[str, np.ndarray]:
    row, place, value = cells(b, idf)
    return {"row": row, "place": place, "value": value, "semantic": b.column("semantic").flatten().to_numpy(), "y": b.column("y").to_numpy(), "weight": b.column("weight").to_numpy()}


def blocks(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of packed batches, or of rows as they are."""
    for whole in batches:
        if "place" in whole.schema.names:
            for i in range(whole.num_rows):
                yield {c: np.frombuffer(whole.column(c)[i].as_buffer(), t) for c, t in PACKED.items()}
        else:
            for start in range(0, whole.num_rows, ROWS):
                yield _block(whole.slice(start, ROWS), idf)


def gradients(w: np.ndarray, idf: np.ndarray) -> Callable:
    """Sums of losses and gradients of a task's blocks. With few columns of weights only the entries are touched; with
    many, a dense block costs less, and one buffer serves all blocks."""
    m, d, k = w.shape
    size, wide = len(idf), m * k
    flat = w.transpose(1, 0, 2).reshape(d, wide)
    few = wide <= FEW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = np.zeros(m), np.zeros((d, wide))
        columns = np.ascontiguousarray(flat[:size].T)
        buffer = None if few else np.zeros((ROWS, size))
        for b in blocks(batches, idf):
            y, weight, row, place, value = b["y"], b["weight"], b["row"], b["place"], b["value"]
            n = len(y)
            own = b["semantic"].reshape(n, -1)
            if few:
                s = np.stack([np.bincount(row, c[place] * value, n) for c in columns], axis=1)
            else:
                buffer[row, place] = value
                s = buffer[:n] @ flat[:size]
            s = (s + own @ flat[size:-1] + flat[-1]).reshape(n, m, k)
            s -= s.max(2, keepdims=True)
            p = np.exp(s)
            z = p.sum(2, keepdims=True)
            at = np.arange(n)
            loss += (weight[:, None] * (np.log(z[..., 0]) - s[at, :, y])).sum(0)
            p /= z
            p[at, :, y] -= 1
            p *= weight[:, None, None]
            p = p.reshape(n, wide)
            if few:
                for j, c in enumerate(np.ascontiguousarray(p.T)):
                    total[:size, j] += np.bincount(place, c[row] * value, size)
            else:
                total[:size] += buffer[:n].T @ p
                buffer[row, place] = 0
            total[size:-1] += own.T @ p
            total[-1] += p.sum(0)
        out = np.concatenate([loss[:, None], total.reshape(d, m, k).transpose(1, 0, 2).reshape(m, -1)], axis=1)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    return pa.table({"part": pa.array([min(table.column("part").to_pylist())], pa.int32()), "v": pa.array([_sum(table.to_pylist()).tobytes()], pa.binary())})


def _sum(parts: list) -> np.ndarray:
    """Sums in the order of the tasks, so that they don't depend on which one ends first."""
    return np.sum([np.frombuffer(r["v"]) for r in sorted(parts, key=lambda r: r["part"])], axis=0)


def products(size: int, semantic: int) -> Callable:
    """Sums of a task's blocks by stripe: of the weighted products of STRIPE terms with themselves and all later ones up to
    CURVED; stripe -1 has those of the semantic columns and the intercept with these terms and each other, then the squares
    of all terms."""
    top, more = min(size, CURVED), semantic + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range(0, top, STRIPE)
        total = [np.zeros((min(STRIPE, top - s), top - s)) for s in starts]
        cross, small, squares = np.zeros((top, more)), np.zeros((more, more)), np.zeros(size)
        buffer, held = np.zeros((AT_ONCE * ROWS, top)), 0

        def add() -> None:
            for s, own in zip(starts, total, strict=True):
                own += buffer[:, s : s + STRIPE].T @ buffer[:, s:]

        for b in blocks(batches, np.zeros(size)):
            weight, row, place, value = b["weight"], b["row"], b["place"], b["value"]
            n = len(weight)
            own = np.hstack([b["semantic"].reshape(n, -1), np.ones((n, 1))])
            squares += np.bincount(place, weight[row] * value * value, size)
            common = place < top
            row, place, value = row[common], place[common], value[common]
            for j in range(more):
                cross[:, j] += np.bincount(place, value * (weight * own[:, j])[row], top)
            small += own.T @ (own * weight[:, None])
            buffer[held * ROWS + row, place] = value * np.sqrt(weight)[row]
            held += 1
            if held == AT_ONCE:
                add()
                buffer[:], held = 0, 0
        add()
        rest = np.concatenate([cross.ravel(), small.ravel(), squares])
        for stripe, v in enumerate([rest, *total], -1):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "stripe": pa.array([stripe], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    return run


def _stripes(table: pa.Table) -> pa.Table:
    return _summed(table.select(["part", "v"])).add_column(1, "stripe", table.column("stripe").slice(0, 1))


class Curvature:
    """The inverse of the curvature at weights of 0, for each model: of the terms up to CURVED and the intercept as a whole,
    with the model's semantic columns by their Schur complement, of other terms by themselves."""

    def __init__(self, rows: DataFrame, size: int, masks: np.ndarray, classes: int, many: bool):
        """rows: packed blocks. CURVED squared numbers reach the driver, whatever the rows."""
        semantic, form = masks.shape[1], "part int, stripe int, v binary"
        parts = rows.mapInArrow(products(size, semantic), form)
        if many:
            parts = parts.groupBy("stripe", F.pmod("part", F.lit(MANY))).applyInArrow(_stripes, form)
        found = {r.stripe: np.frombuffer(r.v) for r in parts.groupBy("stripe").applyInArrow(_stripes, form).collect()}
        top, more = min(size, CURVED), semantic + 1
        cross, small, squares = np.split(found.pop(-1) / classes, [top * more, (top + more) * more])
        cross, small = cross.reshape(top, more), small.reshape(more, more)
        a = np.zeros((top + 1, top + 1))
        for stripe in sorted(found):
            start, end = stripe * STRIPE, min(top, (stripe + 1) * STRIPE)
            v = found.pop(stripe).reshape(end - start, -1) / classes
            a[start:end, start:top] = v
            a[start:top, start:end] = v.T
        a[:top, top] = a[top, :top] = cross[:, -1]
        a[top, top] = small[-1, -1]
        a[np.arange(top), np.arange(top)] += 1  # the penalty
        self.top, self.masks, self.rest, self.inverse = top, masks, 1 / (squares[top:] + 1), np.linalg.inv(a)
        beside = np.vstack([cross[:, :-1], small[-1:, :-1]])
        self.beside = self.inverse @ beside
        self.schur = small[:-1, :-1] + np.eye(semantic) - beside.T @ self.beside

    def __call__(self, model: int, q: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(self.masks[model])
        terms, semantic = np.vstack([q[: self.top], q[-1:]]), len(q) - 1 - self.masks.shape[1] + own
        found = self.inverse @ terms
        z = np.linalg.solve(self.schur[np.ix_(own, own)], q[semantic] - self.beside[:, own].T @ terms)
        found -= self.beside[:, own] @ z
        out = np.zeros_like(q)
        out[: self.top], out[self.top : self.top + len(self.rest)], out[semantic], out[-1] = found[:-1], self.rest[:, None] * q[self.top : self.top + len(self.rest)], z, found[-1]
        return out


class Searcher:
    """One model's L-BFGS with backtracking, which asks for one evaluation after the other. solve: what begins as the inverse
    of the curvature."""

    def __init__(self, start: np.ndarray, solve: Callable):
        self.x, self.trial, self.f, self.g, self.solve, self.solved = start, start, None, None, solve, None
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.step, self.direction, self.steps, self.done = 1.0, None, 0, False

    def told(self, f: float, g: np.ndarray, most: int, small: float) -> None:
        if self.f is not None and f > self.f + 1e-4 * self.step * float(self.direction @ self.g):
            self.step *= 0.5 if self.steps else 0.1
            self.done = self.step < 1e-12
            self.trial = self.x + self.step * self.direction
            return
        solved = self.solve(g)
        if self.f is not None:
            s, y, z = self.trial - self.x, g - self.g, solved - self.solved
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs, (s, y, z)][-MEMORY:]
            self.steps += 1
        self.x, self.f, self.g, self.solved = self.trial, f, g, solved
        if np.abs(g).max() < small or self.steps >= most:
            self.done = True
            return
        q, p, kept = g.copy(), solved.copy(), []
        for s, y, z in reversed(self.pairs):
            a = (s @ q) / (y @ s)
            kept.append(a)
            q -= a * y
            p -= a * z
        if self.pairs:
            s, y, z = self.pairs[-1]
            p *= (s @ y) / (y @ z)
        for (s, y, _), a in zip(self.pairs, reversed(kept), strict=True):
            p += s * (a - (y @ p) / (y @ s))
        if p @ g <= 0:  # sums that rounding made useless
            self.pairs, p = [], g / np.abs(g).sum()
        self.direction, self.step = -p, 1.0
        self.trial = self.x + self.direction


def fit(train: DataFrame, idf: np.ndarray, masks: np.ndarray, classes: int, most: int = 1000) -> np.ndarray:
    """Weights (models, columns + 1, classes). train: places, semantic, y (0 to classes - 1), weight; masks: (models,
    semantic columns), what each model sees. A job runs for the curvature, and one for each step of the searches."""
    on = np.concatenate([np.ones((len(masks), len(idf))), masks, np.ones((len(masks), 1))], axis=1)[:, :, None]
    shape = (len(masks), on.shape[1], classes)
    rows = train.select("places", "semantic", F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"))
    total = rows.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no rows to train on")
    rows = files.through_parquet(rows.mapInArrow(packed(idf), ", ".join(f"`{c}` binary" for c in PACKED)), files.scratch(train.sparkSession))
    small, many = TOLERANCE * total, train.sparkSession.sparkContext.defaultParallelism > MANY
    curvature = Curvature(rows, len(idf), masks, classes, many)
    searchers = [Searcher(np.zeros(shape[1] * classes), lambda g, i=i: (curvature(i, g.reshape(shape[1:])) * on[i]).ravel()) for i in range(len(masks))]
    while active := [i for i, s in enumerate(searchers) if not s.done]:
        w = np.stack([searchers[i].trial for i in active]).reshape(len(active), *shape[1:]) * on[active]
        parts = rows.mapInArrow(gradients(w, idf), "part int, v binary")
        if many:
            parts = parts.groupBy(F.pmod("part", F.lit(MANY))).applyInArrow(_summed, "part int, v binary")
        for i, own, v in zip(active, w, _sum(parts.collect()).reshape(len(active), -1), strict=True):  # MANY times the weights at most
            penalty = own.copy()
            penalty[-1] = 0
            g = (v[1:].reshape(shape[1:]) + penalty) * on[i]
            searchers[i].told(v[0] + 0.5 * float((penalty**2).sum()), g.ravel(), most, small)
    return np.stack([s.x for s in searchers]).reshape(shape) * on


def predict(rows: DataFrame, w: np.ndarray, idf: np.ndarray, names: list[str], keep: list[str]) -> DataFrame:
    """keep, condition, y_pred: the likeliest class of every row for every model. rows: keep, places, semantic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                best = scores(dense(b, idf), w).argmax(2)
                for name, y in zip(names, best, strict=True):
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([name] * len(y)), pa.array(y, pa.int32())], [*keep, "condition", "y_pred"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "places", "semantic").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", condition string, y_pred int")
