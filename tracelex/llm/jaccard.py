"""Operator 6: exact n-gram Jaccard self-join by partitioning the universe of shingles.

A document is the set of its word shingles (64-bit hashes). Sets of like size share a scheme (a size band): it cuts
the hash universe into segments, so many that two linked sets, whose symmetric difference is at most H, agree on a
segment. What is indexed is, for each segment, a hash of the subset that falls into it.

- Cost-based allocation: a scheme weighs exact segments (one key each) against segments twice as wide that may differ
  by one shingle (a key for the subset and for each one-deletion neighbour); small sets take the latter.
- A set of size n only emits its first H(n) + 1 segments that hold two shingles or more, in the scheme's order. The
  first such segment on which two linked sets agree comes after at most H that differ, so both emit it. A set
  with too few such segments emits all it has. Empty segments, which would gather unrelated sets, thus cost nothing.
- Equal sets are one class, and only one document of a class is joined. Keys with the same documents are one key.
  Documents that share a key are first each paired with the least of them, verified, and components are formed. Then
  the documents of a key that lie in different components meet in the key's blocks, without becoming pairs of rows: a
  task rules out what the sizes and the counts of shingles in 256 hash buckets rule out (the sum of the counts'
  differences is a lower bound of the symmetric difference), the sets of what is left are brought to the block, and
  the block verifies, unites, and returns the edges of a spanning forest of its components: fewer rows than the block
  has documents. A component with more than a block's documents of a key has blocks of its own, which do not meet
  each other. No link between different sets is lost to a component.
- Verification intersects the two sets of shingle hashes.
- links() also finds all links inside a component: documents that share a key are compared with each other, block by
  block, a pair where it shares its least key, so that it is looked at once; the sets of a block's candidates are
  brought to the block once, and no pair becomes a row before it is verified.

Keys with many documents are aggregated before the shuffle, and the joins on them are plain ones that adaptive
execution splits. A block holds at most about BLOCK documents, or fewer whose sets take BLOCK_BYTES.

Cases: null, empty and blank texts have empty sets and are linked with nothing; fewer than n words are one shingle of
the whole sequence; null ids never become a component's id unless a whole component has none; repeated rows are
copies; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.llm.common import small_batches, staged

WORDS, PERCENT = 4, 85
RATIO, CACHE = 1.6, 400_000
#: Bytes of ids that are broadcast, at most; beyond, documents are joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: Documents of a key that meet others in one task, and bytes of their sets.
BLOCK, BLOCK_BYTES = 2048, 64 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Word -> hash, remembered for the most recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes. bytes.lower() and bytes.split() know ASCII only, as the definition of a word does."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words) + 1)], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        rows = len(words) - n + 1
        return np.unique(mix(sum(h[k : k + rows] * (_ODD[k % 6] + np.uint64(2 * (k // 6))) for k in range(n))))


def difference(total: int, percent: int) -> int:
    """Most elements in the symmetric difference of two sets with `total` elements together."""
    return total * (100 - percent) // (100 + percent)


@functools.lru_cache(maxsize=None)
def bands(percent: int) -> tuple[int, ...]:
    """Largest size of each band; a partner is at most one band away."""
    out, ratio = [1], max(RATIO, 100 / percent + 0.05)
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return tuple(out)


@functools.lru_cache(maxsize=None)
def scheme(band: int, percent: int) -> tuple[np.ndarray, int]:
    """First hash of each segment but the first, and how many of the first segments allow a deletion."""
    size = bands(percent)[band]
    need = difference(2 * size, percent) + 1

    def cost(wide: int) -> float:
        exact = max(0, need - 2 * wide)
        unit = size / (exact + 2 * wide)
        return exact + wide + 2 * unit * wide + 200 * (exact * math.exp(-unit) + wide * math.exp(-2 * unit))

    wide = min(range(min(need // 2 + need % 2, 64) + 1), key=cost)
    exact = max(0, need - 2 * wide)
    if not wide and exact > 6:
        exact += 2 + exact // 8
    edges = np.cumsum([2] * wide + [1] * exact)[:-1] / (exact + 2 * wide)
    return np.array([int(e * 2**64) for e in edges], np.uint64), wide


def keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set, for its own band and for the next one where a larger partner may lie there."""
    n, out = len(tokens), []
    if not n:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(bands(percent), n))
    largest = n * 100 // percent
    with np.errstate(over="ignore"):
        mixed = mix(tokens + _ODD[1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        for b in (band, band + 1) if largest > bands(percent)[band] else (band,):
            edges, wide = scheme(b, percent)
            at = np.concatenate([[0], np.searchsorted(tokens, edges), [n]])
            size = np.diff(at)
            subset = sums[at[1:]] - sums[at[:-1]]
            name = np.arange(len(size), dtype=np.uint64) * _ODD[2] + np.uint64(b) * _ODD[3]
            own = mix(subset + name)
            if wide:
                out.append(own)
                for s in range(wide):
                    out.append(mix(subset[s] - mixed[at[s] : at[s + 1]] + name[s]))
                continue
            good = np.flatnonzero(size >= 2)
            most = difference(n + min(largest, bands(percent)[b]), percent) + 1
            out.append(own[good[:most]] if len(good) >= most else own)
    return np.unique(np.concatenate(out))


def counts(tokens: np.ndarray) -> bytes:
    """Shingles in each of 256 buckets; counts beyond 255 are cut, which makes differences no larger."""
    return np.minimum(np.bincount((tokens >> np.uint64(7)).astype(np.int64) & 255, minlength=256), 255).astype(np.uint8).tobytes()


SKETCH = "n long, h1 long, h2 long, keys array<long>, counts binary"


def sketch(text: Column, words: int, percent: int) -> Column:
    @F.pandas_udf(SKETCH)
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            s = shingles(text, words)
            raw = s.tobytes()
            h1, h2 = (xxhash.xxh64_intdigest(raw, seed=k) - (1 << 63) for k in (1, 2))
            rows.append((len(s), h1, h2, keys(s, percent).view(np.int64), counts(s)))
        return pd.DataFrame(rows, columns=["n", "h1", "h2", "keys", "counts"])

    return made(text)


def shingle_array(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts], dtype=object)

    return made(text)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """needed (row, doc_id, th, and other columns) with the set of each row. Documents are found by id and the hash of
    their text, so that rows that share an id, or have none, don't meet each other."""
    near = staged(needed.withColumnsRenamed({"doc_id": "id", "th": "at"}))
    width = sum(16 + 256 * (c == "counts") for c in near.columns)
    known = F.broadcast(near) if near.count() * width <= BROADCAST_BYTES else near
    own = docs.select("doc_id", "text", text_hash().alias("th"))
    texts = own.join(known, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("at")))
    others = [c for c in near.columns if c not in ("id", "at", "row")]
    sets = texts.select("row", *others, shingle_array(F.col("text"), words).alias("set"))
    return staged(sets.groupBy("row").agg(*(F.first(c).alias(c) for c in [*others, "set"])))


def _candidates(g: dict, percent: int):
    """Of the columns of a block pair, each place with the later ones that sizes and counts don't rule out, in another
    component (where there is a root) and in the other block (where there are two). Where rows have their keys, a pair
    that shares a lesser key is left to that key."""
    n, block, two, m = g["n"], g["block"], g["i"][0] != g["j"][0], len(g["n"])
    vectors = np.frombuffer(b"".join(g["counts"]), np.uint8).reshape(m, 256).astype(np.int16)
    places, members = [()] * m, []
    if "keys" in g:
        lesser = [k[k < g["key"][0]] for k in g["keys"]]
        flat, owner = np.concatenate(lesser), np.repeat(np.arange(m), [len(k) for k in lesser])
        order = np.argsort(flat, kind="stable")
        names, begin, times = np.unique(flat[order], return_index=True, return_counts=True)
        members = [owner[order[b : b + t]] for b, t in zip(begin.tolist(), times.tolist(), strict=True) if t > 1]
        places = [[] for _ in range(m)]
        for c, own in enumerate(members):
            for x in own.tolist():
                places[x].append(c)
    for x in range(m - 1):
        ok = 100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])
        ok[: x + 1] = False
        if "root" in g:
            ok &= g["root"] != g["root"][x]
        if two:
            ok &= block != block[x]
        for c in places[x]:
            ok[members[c]] = False
        y = np.flatnonzero(ok)
        if len(y):
            apart = np.abs(vectors[y] - vectors[x]).sum(axis=1)
            y = y[apart <= (n[y] + n[x]) * (100 - percent) // (100 + percent)]
            if len(y):
                yield x, y


def _spanning(g: dict, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the components that links of this block pair unite."""
    root, sets = g["root"], [np.asarray(s).view(np.uint64) for s in g["set"]]
    # The sets of a family share most hashes: as numbers of the distinct hashes, they are marks in one array.
    distinct = np.unique(np.concatenate(sets))
    sets = [np.searchsorted(distinct, s) for s in sets]
    mark, up, out = np.zeros(len(distinct), bool), {}, []

    def find(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    for x, ys in _candidates(g, percent):
        mark[sets[x]] = True
        for y in ys.tolist():
            a, b = find(root[x]), find(root[y])
            if a != b:
                common = int(mark[sets[y]].sum())
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    up[max(a, b)] = min(a, b)
                    out.append((int(root[x]), int(root[y])))
        mark[sets[x]] = False
    return out


def _weight() -> Column:
    """Share of a block that a row takes: its set's bytes count if there are many."""
    return F.greatest(F.lit(1.0), 8 * F.col("n") * BLOCK / BLOCK_BYTES)


def _met(rows: DataFrame) -> DataFrame:
    """rows (key, row, n, root, others) as they meet, with block, i and j for each pair (i, j) of their key's blocks. A
    root with more than a block of rows has blocks of its own; these meet all but each other. Rows without a root all
    meet."""
    per = rows.groupBy("key", "root").agg(F.sum(_weight()).alias("w"))
    alone = F.col("root").isNotNull() & (F.col("w") > BLOCK)
    big = F.collect_list(F.when(alone, F.struct("root", F.ceil(F.col("w") / BLOCK).cast("int").alias("k"))))
    small = F.ceil(F.sum(F.when(alone, 0.0).otherwise(F.col("w"))) / BLOCK).cast("int")
    plan = per.groupBy("key").agg(F.greatest(small, F.lit(1)).alias("small"), big.alias("big"))
    owner = F.coalesce(F.array_position(F.transform("big", lambda b: b.root), F.col("root")), F.lit(0)).cast("int")
    own = rows.join(plan, "key").withColumn("sizes", F.concat(F.array("small"), F.transform("big", lambda b: b.k))).withColumn("owner", owner)
    name = lambda o, k: F.shiftleft(o.cast("long"), 32) + k
    own = own.withColumn("block", name(F.col("owner"), F.pmod(F.hash("row"), F.get("sizes", F.col("owner")))))
    others = F.filter(F.transform("sizes", lambda k, o: F.struct(o.alias("o"), k.alias("k"))), lambda s: (s.o != F.col("owner")) | (F.col("owner") == 0))
    blocks = F.flatten(F.transform(others, lambda s: F.transform(F.sequence(F.lit(0), s.k - 1), lambda k: name(s.o, k))))
    met = F.transform(blocks, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    return own.select(*rows.columns, "block", F.explode(met).alias("m")).select("*", "m.i", "m.j").drop("m")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (key, row, n) as they meet: for each pair (i, j) of their key's blocks."""
    return _met(rows.withColumn("root", F.lit(None).cast("long"))).drop("root")


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def across(docs: DataFrame, open_: DataFrame, ids: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: edges between roots, which span what the links between different roots unite. open_: key, row, n, root,
    counts."""

    def rest(frames):
        for _, g in whole_groups(frames):
            may = np.zeros(len(g["n"]), bool)
            for x, y in _candidates(g, percent):
                may[x] = may[y] = True
            if may.any():
                yield pd.DataFrame({c: g[c][may] for c in ("key", "i", "j", "block", "row", "root")})

    def unite(frames):
        for _, g in whole_groups(frames):
            found = _spanning(g, percent)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    wide = open_.groupBy("row").agg(F.collect_list("key").alias("keys"), F.first("counts").alias("counts"))
    met = _met(open_.drop("counts")).join(wide, "row").withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
    left = staged(by_block(met).mapInPandas(rest, "key long, i long, j long, block long, row long, root long"))
    needed = ids.join(left.select("row").distinct(), "row").select("row", "doc_id", "th", "n", "counts")
    return by_block(left.join(sets_of(docs, needed, words), "row")).mapInPandas(unite, "a long, b long").distinct()


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links. First: a, b, the ids of the representatives of two linked classes of equal sets; each pair once.
    Second: doc_id, n_shingles, n_links, the number of other rows that a row is linked with, copies among them; one row
    for each row of docs."""
    small_batches(docs.sparkSession)
    rows, classes, held = indexed(docs, words, percent)
    by = ["n", "h1", "h2"]
    sizes = rows.where("n > 0").groupBy(by).agg(F.count("*").alias("size"))
    # Keys that a document shares with none are of no use here, and the wide columns are shuffled by block only.
    wide = rows.select("row", "counts").join(held.groupBy("row").agg(F.collect_list("key").alias("keys")), "row")
    own = in_blocks(held.select("key", "row").join(rows.select("row", "n"), "row")).join(wide, "row")
    own = own.withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))

    def run(frames):
        for key, g in whole_groups(frames):
            found = [(g["row"][x], g["row"][y].tolist()) for x, y in _candidates(g, percent)]
            if found:
                met = [list({r for a, b in found for r in (a, *b)})] + [[] for _ in found[1:]]
                yield pd.DataFrame({"key": key[0], "i": key[1], "j": key[2], "a": [a for a, _ in found], "bs": [b for _, b in found], "met": met})

    near = staged(by_block(own).mapInPandas(run, "key long, i long, j long, a long, bs array<long>, met array<long>"))
    at = ["key", "i", "j"]
    needed = near.select(*at, F.explode("met").alias("row"))
    ids = classes.join(sizes, by).select("row", "doc_id", "th", "size")
    sets = sets_of(docs, ids.join(needed.select("row").distinct(), "row"), words)

    def verify(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(sets["row"], sets["size"], strict=True))
        has = {r: x.view(np.uint64) for r, x in zip(sets["row"], sets["set"], strict=True)}
        # Sets of a family share most hashes: as numbers of the block's distinct hashes, they are marks in one array.
        distinct = np.unique(np.concatenate(list(has.values())))
        has = {r: np.searchsorted(distinct, x) for r, x in has.items()}
        mark, partners, n = np.zeros(len(distinct), bool), {}, {}
        for a, bs in zip(pairs["a"], pairs["bs"], strict=True):
            mark[has[a]] = True
            for b in bs:
                common = int(mark[has[b]].sum())
                if 100 * common >= percent * (len(has[a]) + len(has[b]) - common):
                    partners.setdefault(a, []).append(b)
                    n[a], n[b] = n.get(a, 0) + size[b], n.get(b, 0) + size[a]
            mark[has[a]] = False
        rows = pd.DataFrame([(r, partners.get(r, []), k) for r, k in n.items()], columns=["row", "partners", "n"], dtype=object)
        return rows.astype({"row": "int64", "n": "int64"})

    sent = needed.join(sets, "row").select(*(F.col(c).alias(f"at_{c}") for c in at), "row", "size", "set")
    found = near.groupBy(at).cogroup(sent.groupBy([f"at_{c}" for c in at])).applyInPandas(verify, "row long, partners array<long>, n long")
    found = staged(found)
    pairs = found.select("row", F.explode("partners").alias("other"))
    name = classes.select(F.col("row").alias("r"), "doc_id")
    pairs = pairs.join(name, F.col("row") == F.col("r")).select(F.col("doc_id").alias("a"), "other")
    pairs = pairs.join(name, F.col("other") == F.col("r")).select("a", F.col("doc_id").alias("b"))
    per = classes.join(sizes, by).join(found.groupBy("row").agg(F.sum("n").alias("far")), "row", "left")
    per = per.select(*by, (F.coalesce("far", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = rows.select("doc_id", *by).join(per, by, "left")
    return pairs, out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def whole_groups(frames):
    """((key, i, j), columns) of each block pair, from frames in their order."""
    held = None
    for frame in itertools.chain(frames, [None]):
        if frame is not None:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if held is None or not len(held):
            continue
        columns = {c: held[c].to_numpy() for c in held.columns}
        name = np.stack([columns[c] for c in ("key", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in itertools.pairwise(cuts if frame is not None else [*cuts, len(held)]):
            yield tuple(name[a].tolist()), {c: v[a:b] for c, v in columns.items()}
        held = held.iloc[cuts[-1] :].reset_index(drop=True) if frame is not None else None


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) of every node with an edge: alternating large and small stars, each round
    written to the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        near = both.where("v > u") if large else both
        out = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now, was = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        now = staged(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            break
        was = state
    own = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return own.union(own.select(F.col("root").alias("node"), "root").distinct())


def indexed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their sketch; one row of each class of equal sets; key, row, least of the keys that several share,
    one key for each set of rows."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_hash().alias("th"), sketch(F.col("text"), words, percent).alias("s"))
    rows = staged(rows.select("doc_id", "row", "th", "s.*"))
    some = rows.where("n > 0")
    by = ["n", "h1", "h2"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "th"))
    classes = staged(some.groupBy(by).agg(first.alias("f")).select(*by, "f.doc_id", "f.row", "f.th"))
    index = some.select("row", "keys").join(classes.select("row"), "row", "left_semi").select("row", F.explode("keys").alias("key"))
    shared = index.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("last")).where("least < last")
    held = index.join(shared, "key")
    # Near copies share most of their keys: of keys with the same rows (their number and 128 bits of hashes say so), one is enough.
    sums = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    alike = held.groupBy("key", "least", "last").agg(F.count("*").alias("c"), *sums).groupBy("least", "last", "c", "x1", "x2")
    return rows, classes, staged(held.join(alike.agg(F.min("key").alias("key")).select("key"), "key", "left_semi").select("key", "row", "least"))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    small_batches(docs.sparkSession)
    rows, classes, held = indexed(docs, words, percent)
    by = ["n", "h1", "h2"]

    pairs = staged(held.where("row > least").select(F.col("least").alias("a"), F.col("row").alias("b")).distinct())
    near = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, classes.select("row", "doc_id", "th").join(near, "row"), words)
    found = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a")
    found = found.join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = staged(found.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"))
    roots = staged(components(links))
    placed = held.join(roots, held["row"] == roots["node"], "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = staged(placed.join(split, "key", "left_semi").join(rows.select("row", "n", "counts"), "row"))
    more = staged(across(docs, open_, rows.select("row", "doc_id", "th", "n", "counts"), words, percent))
    if more.limit(1).count():
        roots = staged(components(links.union(more)))
    named = classes.join(roots, classes["row"] == roots["node"], "left").select(*by, "doc_id", F.coalesce("root", "row").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(*by, "component_id")
    out = rows.select("doc_id", *by).join(named, by, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are linked to one with a smaller id; rows that share an id are one document. Null
    ids stay, unless they are linked to a document with an id; columns of docs may have any names."""
    own = linked(docs.select("doc_id", "text"), words, percent)
    gone = staged(own.where("component_id < doc_id").select(F.col("doc_id").alias("_id")).distinct())
    gone = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def op6_jaccard(spark, sf_dir):
    from tracelex.llm.common import table

    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_links(spark, sf_dir):
    from tracelex.llm.common import table

    return links(table(spark, sf_dir, "documents").select("doc_id", "text"))[1]


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

OP6_LINKS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, count(*) AS k FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(e.k, 0)::BIGINT AS n_links FROM d LEFT JOIN n USING (doc_id) LEFT JOIN e ON e.a = d.doc_id
"""
