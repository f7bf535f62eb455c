"""Terms, regressions and ablations against plain Python and single fits."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelex.operators import dictionary, linear, measure, models, terms

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "x", "été", "naïve", "end"]
made, fit = models.classifier, models.boosting.fit
CONDITIONS = {"BSL": [], "full": ["f1", "f2"], "drop_one": ["f2"], "module_only_one": ["f1"]}


def corpus(n=120, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        y = i % 3
        text = " ".join(rng.choice(WORDS + [["good", "fine"], ["plain"], ["bad", "awful"]][y]) for _ in range(rng.randint(3, 25)))
        rows.append((str(i), text if i != 7 else None, "test" if i % 4 == 3 else "train", y if i != 9 else None, rng.gauss(y, 1.0), float(i % 5) if i != 8 else None))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(corpus(), "id string, text string, split string, label int, f1 double, f2 double").repartition(3).cache()


def plain_grams(text):
    one = re.findall(r"\b\w\w+\b", (text or "").lower())
    return one + [f"{a} {b}" for a, b in zip(one, one[1:])]


def plain_vocabulary(texts, size):
    tf, df = Counter(), Counter()
    for t in texts:
        tf.update(plain_grams(t))
        df.update(set(plain_grams(t)))
    best = sorted(tf, key=lambda g: (-tf[g], g))[:size]
    return {g: (i, tf[g], df[g], math.log((1 + len(texts)) / (1 + df[g])) + 1) for i, g in enumerate(best)}


@pytest.mark.parametrize("size,buckets", [(5, 1 << 20), (20, 7), (20, 1), (40, 64), (100_000, 1 << 20)])
def test_vocabulary_is_exact_whatever_the_sketch(spark, rows, monkeypatch, size, buckets):
    """Few buckets fill up with rare terms: more is counted exactly then, with the same result."""
    monkeypatch.setattr(terms, "BUCKETS", buckets)
    got = {r.g: (r.place, r.tf, r.df, r.idf) for r in terms.vocabulary(rows.where("split = 'train'"), size, key="id").collect()}
    want = plain_vocabulary([r[1] for r in corpus() if r[2] == "train"], size)
    assert {g: v[:3] for g, v in got.items()} == {g: v[:3] for g, v in want.items()} and all(math.isclose(got[g][3], v[3]) for g, v in want.items())


def test_vocabulary_of_nothing(spark, rows):
    none = terms.vocabulary(rows.limit(0), 5, key="id")
    assert none.collect() == [] and terms.weights(rows, none, key="id").collect() == []


def test_weights_places_and_vectors_agree(spark, rows):
    vocabulary = terms.vocabulary(rows.where("split = 'train'"), 30, key="id")
    want = plain_vocabulary([r[1] for r in corpus() if r[2] == "train"], 30)
    long, placed = {}, {r.id: Counter(r.places) for r in terms.places(rows, vocabulary).collect()}
    for r in terms.weights(rows.withColumn("g", F.lit(1)), vocabulary, key="id").collect():
        long.setdefault(r.id, {})[r.place] = r.weight
    vectors = {r.id: r.tfidf for r in models.tfidf(rows, vocabulary).collect()}
    stacked = {r.id: r.features for r in models.stack_semantic(models.tfidf(rows, vocabulary), ["f1"]).collect()}
    for i, text, *_ in corpus():
        tf = Counter(want[g][0] for g in plain_grams(text) if g in want)
        raw = {p: n * next(v[3] for v in want.values() if v[0] == p) for p, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert placed[i] == tf and set(long.get(i, {})) == set(raw) and all(math.isclose(long[i][p], x / norm) for p, x in raw.items())
        assert np.allclose(vectors[i].toArray()[sorted(raw)], [raw[p] / norm for p in sorted(raw)]) and len(stacked[i]) == 31


def test_places_of_a_batch():
    """Looked up at once: pairs don't reach across rows, words stand before pairs, a null row and an empty one have none."""
    import pyarrow as pa

    listed = ["beta", "alpha beta", "alpha", "beta beta", "été gamma"]
    cut = pa.array([["gamma"], ["alpha", "beta", "beta", "alpha"], None, [], ["beta", "x1", "été"], ["gamma", "été", "gamma"]], pa.list_(pa.string()))
    assert terms.found(listed)(cut.slice(1)).to_pylist() == [[2, 0, 0, 2, 1, 3], [], [], [0], [4]]
    assert terms.found([])(cut).to_pylist() == [[]] * 6 and terms.found(listed)(cut.slice(0, 0)).to_pylist() == []


def joint(rows, conditions, most=1000):
    train = rows.where("split = 'train'")
    weighted = rows.join(F.broadcast(models.class_weights(train)), "label", "left")
    return weighted, terms.vocabulary(train, 25, key="id")


def test_joint_regressions_are_single_ones(spark, rows, monkeypatch):
    """Every model of the joint fit has the weights of a fit of its own by another implementation."""
    from pyspark.ml.classification import LogisticRegression

    monkeypatch.setattr(linear, "TOLERANCE", 1e-7)
    weighted, vocabulary = joint(rows, CONDITIONS)
    names, train = ["f1", "f2"], weighted.where("split = 'train' and label is not null")
    filled = models.tfidf(train.fillna(0.0, names), vocabulary)
    placed = terms.places(train, vocabulary).select("places", F.array(*[F.coalesce(n, F.lit(0.0)) for n in names]).alias("semantic"), F.col("label").alias("y"), "weight")
    idf = np.array([r.idf for r in vocabulary.orderBy("place").collect()])
    w = linear.fit(placed, idf, np.array([[0, 0], [1, 1], [0, 1]], float), 3)
    total = train.agg(F.sum("weight")).first()[0]
    for own, mine in zip(([], names, ["f2"]), w, strict=True):
        one = LogisticRegression(labelCol="label", weightCol="weight", regParam=1 / total, standardization=False, family="multinomial", maxIter=2000, tol=1e-14).fit(models.stack_semantic(filled, own))
        want = np.array(one.coefficientMatrix.toArray()).T
        used = [*range(len(idf)), *(len(idf) + names.index(n) for n in own)]
        assert np.abs(mine[used] - want).max() < 1e-4 and (mine[[i for i in range(len(idf) + 2) if i not in used]] == 0).all()
        # Intercepts aren't penalised: they are known up to a constant.
        assert np.abs((mine[-1] - mine[-1].mean()) - (np.array(one.interceptVector) - np.mean(one.interceptVector))).max() < 1e-4


@pytest.mark.parametrize("curved,many", [(5000, 64), (6, 1)])
def test_searches_begin_with_the_curvature(spark, rows, monkeypatch, curved, many):
    """Few steps (37 without), to the same weights, also where only some terms' products are added up, in groups."""
    weighted, vocabulary = joint(rows, CONDITIONS)
    train = weighted.where("split = 'train' and label is not null")
    raw = [F.coalesce(n, F.lit(0.0)) for n in ("f1", "f2")]
    placed = terms.places(train, vocabulary).select("places", F.array(*raw).alias("semantic"), F.col("label").alias("y"), "weight")
    idf, masks = np.array([r.idf for r in vocabulary.orderBy("place").collect()]), np.array([[0, 0], [1, 1], [0, 1]], float)
    seen, gradients = [], linear.gradients
    monkeypatch.setattr(linear, "gradients", lambda w, idf: (seen.append(len(w)), gradients(w, idf))[1])
    monkeypatch.setattr(linear, "STRIPE", 4)
    monkeypatch.setattr(linear, "MANY", many)
    monkeypatch.setattr(linear, "CURVED", curved)
    w = linear.fit(placed, idf, masks, 3)
    assert len(seen) < 16
    # At the optimum of a strictly convex loss the gradient is 0: that of the weights found is as small as asked for.
    packed = [b for b in linear.packed(idf)(iter(placed.toArrow().to_batches()))]
    monkeypatch.setattr(linear.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": staticmethod(lambda: 0)})))
    v = np.frombuffer(next(gradients(w, idf)(iter(packed))).column("v")[0].as_py()).reshape(3, -1)[:, 1:].reshape(w.shape)
    penalty = w.copy()
    penalty[:, -1] = 0
    on = np.concatenate([np.ones((3, len(idf))), masks, np.ones((3, 1))], axis=1)[:, :, None]
    total = placed.agg(F.sum("weight")).first()[0]
    assert np.abs((v + penalty) * on).max() < linear.TOLERANCE * total * 1.01


def test_sums_in_groups_are_the_sums(spark, rows, monkeypatch):
    weighted, vocabulary = joint(rows, CONDITIONS)
    train = weighted.where("split = 'train' and label is not null")
    placed = terms.places(train, vocabulary).select("places", F.array().cast("array<double>").alias("semantic"), F.col("label").alias("y"), "weight")
    idf, none = np.array([r.idf for r in vocabulary.orderBy("place").collect()]), np.zeros((2, 0))
    one = linear.fit(placed, idf, none, 3, most=2)
    monkeypatch.setattr(linear, "MANY", 1)
    assert np.allclose(one, linear.fit(placed, idf, none, 3, most=2)) and np.abs(one).max() > 0


def test_gradients_are_numeric_ones():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    idf, w = rng.uniform(1, 2, 6), rng.normal(size=(2, 9, 3))
    batch = pa.RecordBatch.from_pydict({"places": pa.array([[0, 0, 3], [], [5, 1]], pa.list_(pa.int32())), "semantic": pa.array(rng.normal(size=(3, 2)).tolist()), "y": pa.array([0, 2, 1], pa.int32()), "weight": pa.array([1.0, 0.5, 2.0])})

    def loss(w, m):
        x = linear.dense(batch, idf)
        s = x @ w[m, :-1] + w[m, -1]
        return float((np.array([1.0, 0.5, 2.0]) * (np.log(np.exp(s).sum(1)) - s[[0, 1, 2], [0, 2, 1]])).sum())

    class Context:
        partitionId = staticmethod(lambda: 0)

    linear.TaskContext.get, kept = staticmethod(lambda: Context), linear.TaskContext.get
    try:
        got = np.frombuffer(next(linear.gradients(w, idf)(iter([batch]))).column("v")[0].as_py()).reshape(2, -1)
    finally:
        linear.TaskContext.get = kept
    for m in range(2):
        assert math.isclose(got[m, 0], loss(w, m))
        for i, j in [(0, 0), (3, 1), (6, 2), (7, 0), (8, 2)]:
            up, down = w.copy(), w.copy()
            up[m, i, j] += 1e-6
            down[m, i, j] -= 1e-6
            assert abs(got[m, 1:].reshape(9, 3)[i, j] - (loss(up, m) - loss(down, m)) / 2e-6) < 1e-6


def test_ablation_grid_of_all_kinds(spark, rows):
    small = {"lr": (200, None), "rf": (5, 4), "gbt": (2, 2)}
    found = models.ablation_grid(rows.where("label is not null"), {"BSL": [], "full": ["f1", "f2"]}, ("lr", "rf", "gbt"), (1, 2), 25, small)
    got = found.groupBy("model", "condition", "seed").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("right")).collect()
    assert len(got) == 12 and {(r.n, r.ids) for r in got} == {(30, 30)}
    lr = {(r.condition, r.seed): r.right for r in got if r.model == "lr"}
    assert lr["full", 1] == lr["full", 2] and lr["full", 1] > 0.6
    metrics = measure.metrics_overall(measure.metrics_per_class(measure.confusion_matrix(found, ["model", "condition", "seed"]), ["model", "condition", "seed"]), ["model", "condition", "seed"]).collect()
    assert len(metrics) == 12 and all(math.isclose(m.accuracy, next(r.right for r in got if (r.model, r.condition, r.seed) == (m.model, m.condition, m.seed))) for m in metrics)


@pytest.mark.parametrize("kind,size", [("gbt", (300, 6)), ("rf", (300, 20))])
def test_registered_trees_have_their_stated_size(spark, rows, monkeypatch, kind, size):
    """All rounds or trees, the whole depth, and every term that such a model sees."""
    from tracelex.plans import registry

    seen, vocabulary = [], terms.vocabulary
    monkeypatch.setattr(registry, "model_rows", lambda s, d: rows.where("label is not null").withColumns({f: F.col("f1") for f in registry.X.SELECTED}))
    monkeypatch.setattr(models.terms, "vocabulary", lambda train, n, **more: (seen.append(n), vocabulary(train, n, **more))[1])
    monkeypatch.setattr(models, "classifier", lambda kind, seed, rounds, depth: (seen.append((rounds, depth)), made(kind, seed, 2, 2))[1])
    monkeypatch.setattr(models.boosting, "fit", lambda train, columns, classes, rounds, depth, rate, seed: (seen.append((rounds, depth)), fit(train, columns, classes, 1, 1))[1])
    assert registry.fitted(kind)(spark, None).count() == 30 and seen == [10000, size]


def test_class_weights_are_balanced(spark, rows):
    got = {r.label: r.weight for r in models.class_weights(rows.where("label is not null")).collect()}
    n = Counter(r[3] for r in corpus() if r[3] is not None)
    assert all(math.isclose(got[k], 119 / (3 * n[k])) for k in n)


def test_no_rows_to_train_on(spark, rows):
    none = spark.createDataFrame([], "places array<int>, semantic array<double>, y int, weight double")
    with pytest.raises(ValueError, match="no rows"):
        linear.fit(none, np.ones(3), np.ones((1, 0)), 3)


def test_places_need_a_bounded_vocabulary(spark, rows, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST", 3)
    with pytest.raises(ValueError, match="MOST"):
        terms.places(rows, terms.vocabulary(rows, 10, key="id"))


@pytest.mark.parametrize("few", [0, 100])
def test_packed_blocks_give_the_gradients_of_dense_rows(monkeypatch, few):
    """A block holds the entries that aren't 0 alone, in fewer bytes than the dense rows; both ways of a step agree."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    idf, w = rng.uniform(1, 2, 500), rng.normal(size=(3, 503, 3))
    lists = [rng.integers(0, 500, rng.integers(0, 20)).tolist() for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"places": pa.array(lists, pa.list_(pa.int32())), "semantic": pa.array(rng.normal(size=(600, 2)).tolist()), "y": pa.array(rng.integers(0, 3, 600), pa.int32()), "weight": pa.array(rng.uniform(0.5, 2, 600))})
    blocks = list(linear.packed(idf)(iter([batch])))
    assert sum(b.nbytes for b in blocks) < linear.dense(batch, idf).nbytes / 10
    monkeypatch.setattr(linear, "FEW", few)
    monkeypatch.setattr(linear.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": staticmethod(lambda: 0)})))
    got = np.frombuffer(next(linear.gradients(w, idf)(iter(blocks))).column("v")[0].as_py()).reshape(3, -1)
    x, y, weight = linear.dense(batch, idf), batch.column("y").to_numpy(), batch.column("weight").to_numpy()
    for m in range(3):
        p = np.exp(x @ w[m, :-1] + w[m, -1])
        p /= p.sum(1, keepdims=True)
        assert math.isclose(got[m, 0], -(weight * np.log(p[np.arange(600), y])).sum())
        p[np.arange(600), y] -= 1
        p *= weight[:, None]
        assert np.allclose(got[m, 1:].reshape(503, 3), np.vstack([x.T @ p, p.sum(0)]))


def test_weights_are_shuffled_without_their_words(spark, rows):
    """Words and idf are joined behind the shuffles; rows that share a key are one text."""
    vocabulary = terms.vocabulary(rows.where("split = 'train'"), 30, key="id")
    twice = rows.where("id < '3'").union(rows.where("id < '3'").withColumn("text", F.lit("alpha beta alpha good")))
    found = terms.weights(twice, vocabulary, key="id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(id#\d+, place#\d+, \d+\)", plan) and not re.search(r"hashpartitioning\(id#\d+, place#\d+, g#", plan)
    norms = found.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"), F.count_distinct("place").alias("d"), F.count("*").alias("c")).collect()
    assert len(norms) == twice.select("id").distinct().count() and all(math.isclose(r.n, 1) and r.d == r.c for r in norms)


def test_words_of_a_vocabulary_are_cut_once(spark, rows):
    """Its scans read stored words, and give each text's words and pairs as `grams` does."""
    plans, kept = [], terms.files.through_parquet
    terms.files.through_parquet = lambda df, path: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, path))[1]
    try:
        terms.vocabulary(rows.where("split = 'train'"), 20, key="id")
    finally:
        terms.files.through_parquet = kept
    assert sum("regexp_extract_all" in p for p in plans) == 1 and len(plans) > 2
    got = Counter((r.id, r.g) for r in terms.each_gram(rows.select("id", terms.words(F.col("text")).alias("_words")), "id").collect())
    assert got == Counter((r[0], g) for r in corpus() for g in plain_grams(r[1]))
