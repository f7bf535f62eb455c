"""Operators on vectors, and the alignment of tokenizers, against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelex.llm import alignment, topk, whitening

FOLDER = "/opt/tokenizers"
VEC = "vec_id long, embedding array<float>"


def vectors(spark, rows, n_parts=3):
    return spark.createDataFrame(rows, VEC).repartition(n_parts)


def some_rows(n=400, dims=12, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    return rows + [(5000, None), (5050, []), (5001, [math.nan] * dims), (5002, [math.inf] + [0.0] * (dims - 1)), (5003, [None] * dims), (50, rows[7][1]), (None, rows[7][1]), (5100, [0.5] * (dims + 1)), (5101, [0.25] * (dims + 1))]


def ints(v, scale, shift=0):
    return [math.floor(scale * float(np.float32(x))) + shift for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def best(rows, k):
    out = []
    x = [(i, ints(v, 256)) for i, v in rows if good(v)]
    for qi, q in x:
        if qi is None or qi % 50:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i is None, i or 0) for i, v in x if i != qi and len(v) == len(q))
        out += [(qi, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 5])
def test_topk_is_brute_force(spark, k):
    rows = some_rows()
    df = vectors(spark, rows).withColumn("label", F.lit(1)).withColumn("row", F.lit(2)).withColumn("block", F.lit(3))
    got = topk.search(df, df.where("vec_id % 50 = 0"), k).collect()
    assert sorted(map(tuple, got), key=str) == best(rows, k)


def test_topk_of_many_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(topk, "PACK_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1 << 11)
    rows = [(i * 2, v) for i, v in some_rows(900, 20, 9) if i is not None]
    df = vectors(spark, rows, 5)
    assert sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0")).collect()), key=str) == best(rows, 5)


def test_topk_bounds_hold_and_prune():
    """Greatest scores are never below the scores, finer ones never above coarser ones, and on vectors that move together
    most candidates never get an exact score."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(-90, 90, (300, 4)), 8, axis=1) + rng.integers(-3, 4, (300, 32))
    a, b = topk.Vectors(np.arange(20), x[:20]), topk.Vectors(np.arange(20, 300), x[20:])
    exact, last = a.x @ b.x.T, np.inf
    for mine, theirs in zip(a.levels, b.levels, strict=True):
        bound = mine @ theirs.T
        assert (bound >= exact - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound
    fifth = np.sort(exact, axis=1)[:, -5]
    assert (last >= fifth[:, None]).mean() < 0.1


def test_topk_of_nothing(spark):
    none = vectors(spark, [])
    assert topk.search(none, none).collect() == []
    alone = vectors(spark, [(0, [1.0, 2.0])])
    assert topk.search(alone, alone).collect() == []


def test_topk_refuses_what_is_not_exact(spark):
    big = vectors(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0])])
    with pytest.raises(Exception, match="exact|overflow|OVERFLOW"):
        topk.search(big, big).collect()


def whitened(rows, most=8, weighted=True):
    by = defaultdict(list)
    for i, v in rows:
        if good(v) and v:
            by[len(v)].append((i, ints(v, 1024, 100000)))
    out = {}
    for size, own in by.items():
        fit = own if weighted else [(0, list(x)) for x in {tuple(x) for _, x in own}]
        n, s = len(fit), [sum(x[d] for _, x in fit) for d in range(size)]
        c = np.array([[float(n * x[d] - s[d]) / n for d in range(size)] for _, x in fit])
        v = c.T @ c / n
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e)[:most]
        for i, x in own:
            for k, o in enumerate(order):
                z = sum((x[d] - s[d] / n) * u[d, o] for d in range(size)) / math.sqrt(e[o]) if e[o] > 1e-9 else None
                out.setdefault((i, size, k + 1), []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), z, e[o] / np.trace(v) if z is not None else None))
    return out


@pytest.mark.parametrize("weighted", [True, False])
def test_whitening_is_numpys(spark, weighted):
    rows = some_rows()
    got = whitening.whiten(vectors(spark, rows).withColumn("x", F.lit(1)).withColumn("n", F.lit(1)), weighted=weighted).collect()
    want = whitened(rows, weighted=weighted)
    flat = {(i, k): v for (i, size, k), v in want.items() if size == 12}
    seen, sign = Counter(), {}
    for r in got:
        seen[(r.vec_id, r.component)] += 1
        if r.vec_id in (5100, 5101):
            assert (r.n, r.deviation) == want[(r.vec_id, 13, r.component)][0][:2]
            continue
        n, deviation, z, share = next(x for x in flat[(r.vec_id, r.component)] if x[1] == r.deviation)
        assert r.n == n and abs(r.explained - share) < 1e-9 and r.identity_error < 1e-9
        sign.setdefault(r.component, math.copysign(1, z * r.whitened))
        assert abs(z - sign[r.component] * r.whitened) < 1e-8
    assert seen == Counter({(i, k): len(v) for (i, _, k), v in want.items()} | {})
    assert not [r for r in got if r.vec_id == 5050]


def test_whitening_without_variance(spark):
    rows = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(rows) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (2, 0, None, None, None) for r in rows)
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_whitening_joins_common_vectors_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HOT", 10)
    rows = [(i, [0.5, -0.25] if i % 2 else [i / 64, 1.0]) for i in range(64)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert Counter(r.vec_id for r in got) == Counter({i: 2 for i in range(64)})


def test_deviations_beyond_floats_are_exact(spark):
    rows = [(i, [float(2**14 * (i % 3)), 1.0]) for i in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    want = {i: v[0][1] for (i, _, k), v in whitened(rows).items() if k == 1}
    assert got == want and max(want.values()) > 2**53
    wide = [(i, [float(2**20 * (i % 3)), 1.0]) for i in range(40)]
    assert {r.deviation for r in whitening.whiten(vectors(spark, wide)).collect()} >= {None}


# Operator 12.
TEXTS = [
    "plain words here, and there", "", None, "<|endoftext|> hi <s> </s> <0x41>", "▁ is no space", "日本語 mark 🙂 é ñ naïve", "x" * 700, " " * 600 + "a", "a" + "\t\n" * 300 + "b",
    "the same words the same words", "the same words the same words", "\x00\r\n \x7f", "ab", "Donaudampfschifffahrt " * 30,
]


def token_bytes(ids, side, enc):
    return [(enc.a if side == 0 else enc.b)[i] for i in ids]


def plain_groups(text, slow, sp, enc):
    raw = (" " + text).encode()
    a, b = slow.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    if not text or b"".join(token_bytes(a, 0, enc)) != raw or b"".join(token_bytes(b, 1, enc)) != raw:
        return []
    out, x, y, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(enc.a[a[i]])
            x.append(a[i])
            i += 1
        else:
            at_b += len(enc.b[b[j]])
            y.append(b[j])
            j += 1
        if at_a == at_b:
            out.append((at_a, x, y))
            x, y = [], []
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(f"{FOLDER}/{alignment.BYTE_VOCABULARY}")
    slow.encode_special_tokens = True
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.PIECE_VOCABULARY}"), alignment.encoders(FOLDER)
    all_groups = [plain_groups(t or "", slow, sp, enc) for _, t in rows]
    links = [Counter((a, b) for _, x, y in g for a in x for b in y) for g in all_groups]
    held = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (d, _), g, c in zip(rows, all_groups, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in g)
        out.append((d, sum(len(x) for _, x, _ in g), sum(len(y) for _, _, y in g), len(g), sum(c.values()), sum(n for (a, b), n in c.items() if held[a, b] == most[a]),
                    sum(n * held[p] for p, n in c.items()), hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def test_alignment_is_brute_force(spark, make, monkeypatch):
    import pyarrow.parquet as pq

    texts = TEXTS + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "an id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("n_a", F.lit(1)).repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=str) == want
    # Chunks of a few documents, rows of a few pairs, every group counted densely: the same.
    monkeypatch.setattr(alignment, "CHUNK", 3000)
    monkeypatch.setattr(alignment, "SLICE", 50)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=str) == want


def test_dense_groups_are_counted_alike(monkeypatch):
    enc = alignment.encoders(FOLDER)
    tokens = [t for t in enc.encode([t for t in TEXTS if t]) if t]
    thin = alignment.Batch(enc, tokens).links()
    monkeypatch.setattr(alignment, "DENSE", 1)
    assert all((x == y).all() for x, y in zip(thin, alignment.Batch(enc, tokens).links(), strict=True))


def test_shared_cuts_are_the_intersection():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b, last_a, last_b, base = [], [], [], [], 0
        for _ in range(int(rng.integers(1, 6))):
            size = int(rng.integers(1, 400))
            for ends, last in ((a, last_a), (b, last_b)):
                own = np.unique(rng.integers(1, size + 1, int(rng.integers(1, size + 1))))
                ends.extend((base + np.append(own[own < size], size)).tolist())
                last.append(len(ends) - 1)
            base += size
        a, b = np.array(a), np.array(b)
        x, y = alignment.shared_cuts(a, b, np.array(last_a), np.array(last_b))
        assert (a[x] == np.intersect1d(a, b)).all() and (b[y] == a[x]).all()


def test_groups_with_their_bytes(spark, make):
    text = "Straßenbahn, naïve 日本"
    rows = alignment.groups(make([text, None, "", "▁"])).collect()
    assert [r.groups is None for r in sorted(rows, key=lambda r: r.doc_id)] == [False, True, True, True]
    enc, raw, at = alignment.encoders(FOLDER), (" " + text).encode(), 0
    for g in rows[0].groups:
        assert g.start == at and raw[g.start : g.end] == b"".join(enc.a[i] for i in g.a) == b"".join(enc.b[i] for i in g.b)
        at = g.end
    assert at == len(raw)


def test_alignment_of_nothing(spark, empty):
    assert alignment.align(empty).collect() == []


def test_fast_and_slow_encoders_agree():
    import pyarrow.parquet as pq

    enc = alignment.encoders(FOLDER)
    for t in [*filter(None, TEXTS), *filter(None, pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist())]:
        assert enc.ids_a(t).tolist() == enc.slow.encode(t, add_special_tokens=False).ids
