"""Operator 3: a convolutional text classifier in numpy, trained on all labelled rows that aren't held out.

Words are hashed into 2**22 buckets; buckets that LEAST_DOCS (6) training rows or more have get an embedding, all others
share the zero vector. Filters of widths 1 to 3 run over every word of a text, each filter's largest value is kept, and a
logistic layer makes the score. Training sets out on the driver, from `sample`: `per_class` rows of either class by keyed
hash of their ids, and `words` words of either class together. It then passes PASSES times over every training row with
its whole text, a Spark job each: each task trains from the round's parameters over its own rows, and the model goes on by the
mean of what they add (of an embedding row: of the tasks that have it). What the driver holds is the model: some 64 bytes for
each bucket with an embedding. A fifth of the labelled rows, by hash of the id, is never trained on; all of them together
calibrate a threshold for each language, which only decides `flagged`; language is no input of the score. Scoring covers
every whole text in a pandas UDF, without a shuffle of texts.

The labels of one text in two classes are both learned from. Columns other than doc_id, text and lang (and labels' doc_id
and toxic) are ignored, whatever their names.

Cases: null and empty texts get the score of a text without words; null labels are not learned from; rows that share
a doc_id are scored one by one; without any usable label of either class every score is the share of toxic labels (0
without labels); texts longer than a chunk are cut into overlapping chunks, whose maxima are those of the whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelex.llm.common import small_batches, staged

BUCKETS, DIM, WIDTHS, FILTERS, LEAST_DOCS = 1 << 22, 16, (1, 2, 3), 8, 6
PER_CLASS, SAMPLE_WORDS, EPOCHS, BATCH, RATE, DECAY, DROP, SEED = 2500, 4_000_000, 8, 32, 0.003, 3e-4, 0.1, 3
CHUNK, CACHE = 100_000, 400_000
DECIDED = 0.7

_WORD = re.compile(r"[^\W\d_]+")


class Buckets(dict):
    """Word -> bucket, remembered for the most recent words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = b = zlib.crc32(word.encode()) % BUCKETS
        return b


def bucket_ids(text: str | None, memo: Buckets) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    seen: np.ndarray  # sorted buckets; embedding row i + 1 belongs to seen[i], row 0 is zero
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.seen):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.seen, ids), len(self.seen) - 1)
        return np.where(self.seen[at] == ids, at + 1, 0)

    def forward(self, docs: list[np.ndarray], goes_on: list[bool] | None = None):
        """Score, pooled values, and where each came from; docs hold embedding rows. Of a chunk that goes on, only
        windows that begin in its first CHUNK words count."""
        gap = max(WIDTHS)
        lengths = np.array([len(d) + gap for d in docs])
        starts = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()) + gap, np.int64)
        for s, d in zip(starts, docs, strict=True):
            ids[s : s + len(d)] = d
        x = self.embed[ids]
        pooled, where = [], []
        for k in WIDTHS:
            n = len(ids) - gap
            y = self.bias[k] + sum(x[j : j + n] @ self.filters[k][j] for j in range(k))
            for j in range(1, k):  # windows that would reach into the next text
                y[starts + lengths - j] = -np.inf
            for at in np.flatnonzero(goes_on) if goes_on else ():
                y[starts[at] + CHUNK : starts[at] + lengths[at]] = -np.inf
            top = np.maximum.reduceat(y, starts, axis=0)
            pooled.append(top)
            where.append(y)
        p = np.maximum(np.concatenate(pooled, axis=1), 0)
        return 1 / (1 + np.exp(-np.clip(p @ self.weight + self.offset, -30, 30))), p, where, ids, x, starts

    def score(self, texts: list[str | None], memo: Buckets) -> np.ndarray:
        return self.score_ids([bucket_ids(text, memo) for text in texts])

    def score_ids(self, raw: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(raw), len(WIDTHS) * FILTERS), np.float32)
        pieces, held, lap = [], 0, max(WIDTHS) - 1

        def flush() -> None:
            nonlocal pieces, held
            if pieces:
                p = self.forward([d for _, d, _ in pieces], [g for _, _, g in pieces])[1]
                np.maximum.at(out, [i for i, _, _ in pieces], p)
            pieces, held = [], 0

        for i, ids in enumerate(raw):
            rows = self.rows(ids)
            for s in range(0, max(1, len(rows)), CHUNK):
                piece = rows[s : s + CHUNK + lap]
                if held + len(piece) > CHUNK:
                    flush()
                pieces.append((i, piece, s + CHUNK < len(rows)))
                held += len(piece)
        flush()
        return 1 / (1 + np.exp(-np.clip(out @ self.weight + self.offset, -30, 30)))


def windows(m: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest value over each text (texts, filters; cut at zero), and the embedding rows of the window it
    comes from (texts, filters, words; 0 behind a filter's width). No more than CHUNK words are worked on at a time."""
    wide = max(WIDTHS)
    pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -1, m.weight.dtype)
    found = np.zeros((*pooled.shape, wide), np.int64)
    pieces, held = [], 0

    def flush() -> None:
        nonlocal pieces, held
        if pieces:
            _, p, outs, ids, _, starts = m.forward([d for _, d, _ in pieces], [g for _, _, g in pieces])
            ends = np.append(starts[1:], len(ids) - wide)
            for at, (i, _, _) in enumerate(pieces):
                better = p[at] > pooled[i]
                own = np.zeros(found.shape[1:], np.int64)
                for c, k in enumerate(WIDTHS):
                    top = outs[c][starts[at] : ends[at]].argmax(axis=0) + starts[at]
                    own[c * FILTERS : (c + 1) * FILTERS, :k] = ids[top[:, None] + np.arange(k)]
                found[i] = np.where(better[:, None], own, found[i])
                pooled[i] = np.where(better, p[at], pooled[i])
        pieces, held = [], 0

    for i, d in enumerate(docs):
        for s in range(0, max(1, len(d)), CHUNK):
            piece = d[s : s + CHUNK + wide - 1]
            if held + len(piece) > CHUNK:
                flush()
            pieces.append((i, piece, s + CHUNK < len(d)))
            held += len(piece)
    flush()
    return pooled, found


def slopes(m: Model, docs: list[np.ndarray], y: np.ndarray, balance: np.ndarray, decay: float = DECAY) -> tuple[dict[str, np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean log loss, weighted by class: for the small parameters and the offset; embedding rows that take part,
    and theirs."""
    pooled, found = windows(m, docs)
    p = 1 / (1 + np.exp(-np.clip(pooled @ m.weight + m.offset, -30, 30)))
    d = ((p - y) * balance[y.astype(int)] / len(docs)).astype(m.weight.dtype)
    grads = {"w": pooled.T @ d + decay * m.weight}
    back = np.where(pooled > 0, np.outer(d, m.weight), 0).astype(m.weight.dtype)
    rows, parts = [], []
    for c, k in enumerate(WIDTHS):
        own = slice(c * FILTERS, (c + 1) * FILTERS)
        g, at = back[:, own], found[:, own, :k]
        grads[f"b{k}"] = g.sum(axis=0)
        grads[f"f{k}"] = np.stack([np.einsum("nfd,nf->df", m.embed[at[:, :, j]], g) for j in range(k)]) + decay * m.filters[k]
        for j in range(k):
            rows.append(at[:, :, j].ravel())
            parts.append((g[:, :, None] * m.filters[k][j].T[None]).reshape(-1, DIM))
    some, back_to = np.unique(np.concatenate(rows), return_inverse=True)
    embed = np.zeros((len(some), DIM), m.embed.dtype)
    np.add.at(embed, back_to, np.concatenate(parts))
    keep = some > 0  # row 0 stays zero
    return grads, float(d.sum()), some[keep], embed[keep] + decay * m.embed[some[keep]]


def gradients(m: Model, docs: list[np.ndarray], y: np.ndarray, balance: np.ndarray, decay: float = DECAY) -> tuple[dict[str, np.ndarray], float]:
    """The same with those of the whole embedding as e."""
    grads, g0, some, own = slopes(m, docs, y, balance, decay)
    grads["e"] = decay * m.embed
    grads["e"][some] = own
    return grads, g0


def threshold(rows: list[tuple[float, float]]) -> float:
    """Of 19 cuts, the one with the best F1 over (score, label); ties go to the one nearest to a half."""
    return max(np.linspace(0.05, 0.95, 19).tolist(), key=lambda c: (_f1(rows, c), -abs(c - 0.5)))


def fit(raw: list[np.ndarray], labels: list[int], langs: list[str | None], share_held: int = 5) -> Model:
    """Adam on the log loss over the texts' buckets; of share_held rows one calibrates the thresholds (0: none), the rest train."""
    rng, y = np.random.default_rng(SEED), np.array(labels, np.float32)
    docs_of = np.unique(np.concatenate([np.unique(r) for r in raw] or [np.zeros(0, np.int64)]), return_counts=True)
    seen = docs_of[0][docs_of[1] >= LEAST_DOCS]
    m = Model(
        seen, np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.02, (len(seen), DIM))]).astype(np.float32),
        {k: rng.normal(0, 0.5 / k, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS},
        {k: np.zeros(FILTERS, np.float32) for k in WIDTHS},
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        m.weight[:] = 0
        m.offset = 30.0 if share else -30.0
        return m
    order = rng.permutation(len(y))
    held, train = np.split(order, [len(y) // share_held if share_held else 0])
    docs = [m.rows(r) for r in raw]
    params = {"e": m.embed, "w": m.weight} | {f"f{k}": m.filters[k] for k in WIDTHS} | {f"b{k}": m.bias[k] for k in WIDTHS}
    first, second, step, off = {n: np.zeros_like(v) for n, v in params.items()}, {n: np.zeros_like(v) for n, v in params.items()}, 0, [0.0, 0.0]
    balance = np.array([1.0, min(3.0, (1 - share) / share) ** 0.5], np.float32)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            some = train[at : at + BATCH]
            grads, g0 = gradients(m, [np.where(rng.random(len(docs[i])) < DROP, 0, docs[i]) for i in some], y[some], balance)
            step += 1
            off = [0.9 * off[0] + 0.1 * g0, 0.999 * off[1] + 0.001 * g0 * g0]
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            m.offset -= rate * off[0] / (np.sqrt(off[1]) + 1e-8)
            for n, v in params.items():
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.001 * (grads[n] ** 2 - second[n])
                v -= rate * first[n] / (np.sqrt(second[n]) + 1e-8)
    scores = m.score_ids([raw[i] for i in held]) if len(held) else np.zeros(0)
    for lang in {langs[i] for i in held} - {None}:
        own = [(float(s), float(y[i])) for s, i in zip(scores, held, strict=True) if langs[i] == lang]
        if 0 < sum(t for _, t in own) < len(own):
            m.thresholds[lang] = threshold(own)
    return m


def _f1(rows: list[tuple[float, float]], cut: float) -> float:
    hit = sum(t for s, t in rows if s >= cut)
    return 2 * hit / max(1.0, sum(s >= cut for s, _ in rows) + sum(t for _, t in rows))


def remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, words: int = SAMPLE_WORDS) -> pd.DataFrame:
    """ids (the buckets of the text's words, four bytes each), lang, toxic of at most per_class rows of either class, with
    at most `words` words of a class together, none of them held out; rows that share an id count one by one. Words are
    hashed on the executors: no text reaches the driver."""
    usable = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("doc_id", "toxic").distinct()
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = [usable.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    labelled = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows
    hashed = F.pandas_udf(lambda s: s.map(lambda t: bucket_ids(t, _memo).astype(np.int32)), "array<int>")
    rows = docs.select("doc_id", "text", "lang").join(labelled, "doc_id").select("doc_id", hashed("text").alias("ids"), "lang", "toxic")
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), order.alias("o"), F.xxhash64("ids").alias("same"), "*"))
    # Ids may be shared by any number of rows: rows, not ids, are counted from here on, without their words.
    by = ["o", "doc_id", "same", "row"]
    fit = rows.select("toxic", *by, F.size("ids").alias("n")).where(F.col("n") <= words // 100)
    first = [fit.where(F.col("toxic") == v).orderBy(*by).limit(per_class) for v in (0, 1)]
    total = F.sum("n").over(Window.partitionBy("toxic").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    kept = first[0].union(first[1]).withColumn("total", total).where(F.col("total") <= words).select("row")
    return rows.join(F.broadcast(kept), "row").toPandas().sort_values(by)


def calibrates(doc_id):
    """A fifth of the ids: their rows are never trained on, they calibrate the thresholds."""
    return F.pmod(F.xxhash64(F.lit(SEED + 1), doc_id), F.lit(5)) == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """ids, lang, toxic, calibrates of every labelled row that isn't held out, with its whole text, stored once."""
    usable = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("doc_id", "toxic").distinct()
    hashed = F.pandas_udf(lambda s: s.map(lambda t: bucket_ids(t, _memo).astype(np.int32)), "array<int>")
    joined = docs.select("doc_id", "text", "lang").join(usable.hint("merge"), "doc_id")  # the same plan at every size
    return staged(joined.select(hashed("text").alias("ids"), "lang", F.col("toxic").cast("int").alias("toxic"), calibrates(F.col("doc_id")).alias("calibrates")))


def widened(m: Model, seen: np.ndarray) -> Model:
    """The model with an embedding row for each bucket of seen: new ones are small and random, others as they are."""
    every = np.union1d(m.seen, seen)
    embed = np.random.default_rng(SEED).normal(0, 0.02, (len(every) + 1, DIM)).astype(np.float32)
    embed[0] = 0
    embed[np.searchsorted(every, m.seen) + 1] = m.embed[1:]
    return Model(every, embed, m.filters, m.bias, m.weight, m.offset)


def small(m: Model) -> np.ndarray:
    """Everything but the embedding, in a row."""
    return np.concatenate([m.weight, [m.offset], *[m.filters[k].ravel() for k in WIDTHS], *[m.bias[k] for k in WIDTHS]]).astype(np.float64)


def refilled(m: Model, values: np.ndarray, embed: np.ndarray) -> Model:
    at, out = len(m.weight) + 1, Model(m.seen, embed, {}, {}, values[: len(m.weight)].astype(np.float32), float(values[len(m.weight)]))
    for name in ("filters", "bias"):
        for k in WIDTHS:
            old = getattr(m, name)[k]
            getattr(out, name)[k] = values[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
    return out


#: Passes over all rows, their rate, and the embedding rows of a block.
PASSES, PASS_RATE, BLOCK = 2, 0.001, 2048


def trained(sent, balance: np.ndarray, step: int):
    """Adam over a task's rows, from the parameters of the round: what it adds to them, times the task's rows, by block of
    the embedding (block -1: all else). Moments are kept for the embedding rows that take part."""

    def run(batches):
        base: Model = sent.value
        part = TaskContext.get().partitionId()
        rng, n, t = np.random.default_rng([SEED, step, part]), 0, 0
        m = refilled(base, small(base), base.embed.copy())
        params = {"w": m.weight} | {f"f{k}": m.filters[k] for k in WIDTHS} | {f"b{k}": m.bias[k] for k in WIDTHS}
        first, second, off = {c: np.zeros_like(v) for c, v in params.items()}, {c: np.zeros_like(v) for c, v in params.items()}, [0.0, 0.0]
        one, two, touched = np.zeros_like(m.embed), np.zeros_like(m.embed), np.zeros(len(m.embed), bool)
        for b in batches:
            ids, ends = m.rows(b.column("ids").flatten().to_numpy()), np.cumsum(b.column("ids").value_lengths().to_numpy())
            docs, y = np.split(ids, ends[:-1]), b.column("toxic").to_numpy().astype(np.float32)
            order = rng.permutation(len(y))
            for some in np.split(order, range(BATCH, len(order), BATCH)):
                grads, g0, rows, own = slopes(m, [np.where(rng.random(len(docs[i])) < DROP, 0, docs[i]) for i in some], y[some], balance)
                t, n = t + 1, n + len(some)
                rate = PASS_RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                off = [0.9 * off[0] + 0.1 * g0, 0.999 * off[1] + 0.001 * g0 * g0]
                m.offset -= rate * off[0] / (np.sqrt(off[1]) + 1e-8)
                for c, v in params.items():
                    first[c] += 0.1 * (grads[c] - first[c])
                    second[c] += 0.001 * (grads[c] ** 2 - second[c])
                    v -= rate * first[c] / (np.sqrt(second[c]) + 1e-8)
                touched[rows] = True
                one[rows] += 0.1 * (own - one[rows])
                two[rows] += 0.001 * (own**2 - two[rows])
                m.embed[rows] -= rate * one[rows] / (np.sqrt(two[rows]) + 1e-8)
        if n:
            out = [(-1, np.zeros(1, np.int64), (small(m) - small(base))[None])]
            rows = np.flatnonzero(touched)
            cuts = np.flatnonzero(np.diff(rows // BLOCK)) + 1
            for own in np.split(rows, cuts) if len(rows) else ():
                out.append((int(own[0]) // BLOCK, own, m.embed[own].astype(np.float64) - base.embed[own]))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([o[0] for o in out], pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "n": pa.array([n] * len(out), pa.int64()),
                "rows": pa.array([o[1].tobytes() for o in out], pa.binary()), "added": pa.array([o[2].astype(np.float32).tobytes() for o in out], pa.binary()),
            })

    return run


def averaged(table: pa.Table) -> pa.Table:
    """One block: for each of its rows, the mean of what the tasks that had it added, weighted by their rows."""
    parts = sorted(table.to_pylist(), key=lambda r: r["part"])
    rows = [np.frombuffer(r["rows"], np.int64) for r in parts]
    some, at = np.unique(np.concatenate(rows), return_inverse=True)
    width = len(parts[0]["added"]) // 4 // len(rows[0])
    total, weight, start = np.zeros((len(some), width)), np.zeros(len(some)), 0
    for r, own in zip(parts, rows, strict=True):
        here = at[start : start + len(own)]
        total[here] += r["n"] * np.frombuffer(r["added"], np.float32).reshape(len(own), width)
        weight[here] += r["n"]
        start += len(own)
    return pa.table({"block": pa.array([parts[0]["block"]], pa.int32()), "rows": pa.array([some.tobytes()], pa.binary()), "added": pa.array([(total / weight[:, None]).astype(np.float32).tobytes()], pa.binary())})


def passed(rows: DataFrame, m: Model, balance: np.ndarray, step: int) -> Model:
    """One pass: every task trains over all its rows, and the model goes on by their mean. rows: ids, toxic."""
    sent = rows.sparkSession.sparkContext.broadcast(m)
    found = rows.select("ids", "toxic").mapInArrow(trained(sent, balance, step), "block int, part int, n long, rows binary, added binary")
    embed, values = m.embed.copy(), small(m)
    for r in found.groupBy("block").applyInArrow(averaged, "block int, rows binary, added binary").toLocalIterator():  # the size of the model
        own = np.frombuffer(r.rows, np.int64)
        added = np.frombuffer(r.added, np.float32).reshape(len(own), -1)
        if r.block < 0:
            values += added[0]
        else:
            embed[own] += added
    sent.unpersist()
    return refilled(m, values, embed)


def frequent(rows: DataFrame) -> np.ndarray:
    """Sorted buckets that LEAST_DOCS rows or more have; BUCKETS numbers at most."""
    counts = rows.select(F.explode(F.array_distinct("ids")).alias("b")).groupBy("b").count().where(F.col("count") >= LEAST_DOCS)
    return np.sort(counts.select("b").toPandas()["b"].to_numpy(np.int64))


CUTS = [round(c, 2) for c in np.linspace(0.05, 0.95, 19).tolist()]


def thresholds(rows: DataFrame, scored) -> DataFrame:
    """lang, cut: of the 19 cuts the one with the best F1 over all of a language's rows, if both classes are there; ties as
    in `threshold`. rows: ids, lang, toxic."""
    judged = rows.where("lang is not null").select("lang", "toxic", scored("ids").alias("s"))
    sums = judged.groupBy("lang").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n"), F.array(*[F.sum(F.when(F.col("s") >= c, F.col("toxic")).otherwise(0)) for c in CUTS]).alias("hit"),
        F.array(*[F.count_if(F.col("s") >= c) for c in CUTS]).alias("said"),
    ).where("t > 0 and t < n")
    cuts = F.array(*[F.struct((2 * F.get("hit", F.lit(i)) / (F.get("said", F.lit(i)) + F.col("t"))).alias("f1"), F.lit(-abs(c - 0.5)).alias("near"), F.lit(-c).alias("low")) for i, c in enumerate(CUTS)])
    return sums.select("lang", (-F.array_max(cuts)["low"]).alias("cut"))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged. per_class bounds the rows from which training sets out, not those it
    goes through."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labelled(docs, labels)
    count = {(r.calibrates, r.toxic): r.n for r in rows.groupBy("calibrates", "toxic").agg(F.count("*").alias("n")).collect()}
    apart = all(count.get((False, c)) for c in (0, 1))
    train, own = (rows.where(~F.col("calibrates")), labels.where(~calibrates(F.col("doc_id")))) if apart else (rows, labels)
    number = [count.get((False, c), 0) + (0 if apart else count.get((True, c), 0)) for c in (0, 1)]
    if all(number):
        first = sample(docs, own, per_class)
        langs = [x if isinstance(x, str) else None for x in first["lang"]]
        model = widened(fit([np.asarray(x, np.int64) for x in first["ids"]], first["toxic"].astype(int).tolist(), langs, 0), frequent(train))
        balance = np.array([1.0, min(3.0, number[0] / number[1]) ** 0.5], np.float32)
        for step in range(PASSES):
            model = passed(train, model, balance, step)
    else:
        model = fit([np.zeros(0, np.int64)] * min(1, sum(number)), [int(number[1] > 0)] * min(1, sum(number)), [None] * min(1, sum(number)))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(texts.tolist(), _memo), dtype="float64")

    @F.pandas_udf("double")
    def scored_ids(ids: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score_ids([np.asarray(x, np.int64) for x in ids]), dtype="float64")

    cuts = staged(thresholds(rows.where("calibrates") if apart else rows.limit(0), scored_ids))  # a row for each language
    out = docs.select("doc_id", "lang", (remainder(F.col("doc_id")) == 1).alias("held_out"), scored("text").alias("score")).join(cuts, "lang", "left")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= DECIDED).cast("int").alias("predicted"), (F.col("score") >= F.coalesce("cut", F.lit(0.5))).alias("flagged"))


_memo = Buckets()


def op3_toxicity(spark, sf_dir):
    from tracelex.llm.common import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
