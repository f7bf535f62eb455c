"""Measures against values worked out by hand or by other means."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelex.operators import audit, fingerprint, graph, measure, sensitivity, tables
from tracelex.sources import files


def test_f_tail():
    # Upper tails of the F distribution with 2 and 965 degrees of freedom, by 1 / (1 + 2 f / 965) ** (965 / 2).
    for f in (0.0, 0.5, 1.0, 3.0, 10.0, 23.5327):
        assert math.isclose(measure.f_tail(f, 2, 965), (1 + 2 * f / 965) ** (-965 / 2), rel_tol=1e-10)
    assert math.isclose(measure.f_tail(4.0, 1, 4), 0.1161165235, rel_tol=1e-8)


def test_metrics(spark):
    rows = [(str(i), t, p, "A", 1) for i, (t, p) in enumerate([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)])]
    p = spark.createDataFrame(rows, "id string, y_true int, y_pred int, condition string, seed int")
    m = measure.confusion_matrix(p, ["condition", "seed"])
    assert m.count() == 9 and m.agg(F.sum("n")).first()[0] == 5
    o = measure.metrics_overall(measure.metrics_per_class(m, ["condition", "seed"]), ["condition", "seed"]).first()
    assert math.isclose(o.accuracy, 0.6) and math.isclose(o.macro_f1, (0.5 + 0.8 + 0) / 3) and math.isclose(o.weighted_f1, (2 * 0.5 + 2 * 0.8) / 5)


def test_constant_feature_is_not_selected(spark):
    rows = [("c", i % 3, 1.0) for i in range(30)] + [("x", i % 3, float(i % 3) + (i % 2) / 10) for i in range(30)]
    f = measure.anova_f(spark.createDataFrame(rows, "feature string, label int, value double"))
    assert [r.feature for r in measure.select_features(f).collect()] == ["x"]


def test_cells_and_traces(spark):
    cells = spark.createDataFrame([("1", "a", 2.0), ("1", "b", 0.0), ("2", "a", 1.0)], "id string, feature string, value double")
    good = spark.createDataFrame([("1", "a", 2.0), ("2", "a", 1.0), ("3", None, None)], "id string, feature string, value double")
    assert audit.trace_counts(audit.cell_trace(cells, good)).first().mismatches == 0
    bad = good.withColumn("value", F.when(F.col("id") == "2", 1.5).otherwise(F.col("value")))
    assert audit.trace_counts(audit.cell_trace(cells, bad)).first().mismatches == 1


@pytest.mark.parametrize("block", [19, 20, 21, 7])
def test_sequence_hash_is_the_blocks_hash(spark, block):
    """The same rule on both sides of a block's size."""
    sha = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    ids = [f"id{i}" for i in range(20)]
    rows = spark.createDataFrame([("s", x, i) for i, x in enumerate(ids)], "split string, id string, pos int").repartition(3)
    assert audit.sequence_sha256(rows, "split", "id", block=block).first().sha256 == sha([sha(ids[a : a + block]) for a in range(0, 20, block)])
    assert fingerprint.plain_sequences(rows, "split", "id").first().sha256 == sha(ids)


def test_a_matrix_with_a_gap_has_no_shape(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 2, 2.0), ("c", 0, 1.0), ("c", 0, 1.0)], "split string, pos int, x double")
    got = {r.split: (r.n_rows, r.shape_ok) for r in fingerprint.matrix_fingerprint(rows, ["x"], "split").collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (2, False)}


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 9, 200).astype(float), "b": rng.normal(size=101), "c": np.array([4.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)], "feature string, value double").repartition(5)
    got = {r.feature: (r.q1, r.median, r.q9) for r in measure.quantiles(rows, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q9": 0.9}).collect()}
    assert set(got) == {"a", "b", "c"} and all(np.allclose(got[k], np.quantile(v, [0.25, 0.5, 0.9])) for k, v in values.items())


def test_places_over_ranges(spark):
    names = [f"n{i % 50:02d}{i}" for i in range(300)]
    rows = spark.createDataFrame([(x,) for x in names], "author string").repartition(7)
    got = {r.author: r.before for r in tables.placed(rows, ["author"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(names))}
    assert tables.placed(rows.limit(0), ["author"]).count() == 0


def test_missing_authors_and_texts_stay(spark):
    posts = spark.createDataFrame([("1", "b", "x", "t", None, "train"), ("2", None, "y", "t", None, "val"), ("3", "a", None, None, None, "test")], "id string, author string, body string, topic string, created timestamp, split string")
    got = {r.id: r.author_id for r in tables.project_release(posts, tables.pseudonym_authors(posts)).collect()}
    assert got == {"1": "author_0002", "2": "author_0003", "3": "author_0001"}
    docs = spark.createDataFrame([(1, "u v u"), (2, ""), (3, None)], "doc_id long, text string")
    tokens = spark.createDataFrame([(1, "u", 0), (1, "v", 1), (1, "u", 2)], "doc_id long, token string, pos int")
    words = docs.select("doc_id", F.split("text", " ").alias("words")).withColumn("words", F.array_remove("words", ""))
    ids = {r.doc_id: r.ids for r in tables.encode_tokens(words, tables.build_vocab(tokens), 4).collect()}
    assert ids == {1: [2, 1, 2, 0], 2: [0] * 4, 3: [0] * 4}


def test_files_that_lack_something_are_errors(spark, tmp_path):
    one = files.write_report(spark.createDataFrame([({"good": 1.0}, {})], "positive map<string,double>, negative map<string,double>"), f"{tmp_path}/lexicon")
    with pytest.raises(ValueError, match="side of the lexicon"):
        files.read_frozen_lexicon(spark, one)
    rows = spark.createDataFrame([("1", "test", 0, 1, "lr", "BSL", 42)], files.PREDICTION)
    p = files.write_csv(rows, f"{tmp_path}/predictions")
    assert files.read_predictions(spark, p, [("lr", "BSL", 42)]).count() == 1
    with pytest.raises(ValueError, match="123"):
        files.read_predictions(spark, p, [("lr", "BSL", 42), ("lr", "BSL", 123)])
    cells = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.1), ("b", 1, 0.2)], "module string, seed int, delta double")
    with pytest.raises(ValueError, match="missing"):
        tables.pivot_complete(cells, "module", "seed", [1, 2], "delta")


def test_split_files_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SPLIT_BLOCK", 3)
    rows = spark.createDataFrame([(f"i{k}", "train" if k % 3 else "val", k // 3 if k % 3 == 0 else k - k // 3 - 1) for k in range(20)], "id string, split string, pos long")
    assert sorted(tables.read_split(spark, tables.write_split(rows, f"{tmp_path}/split")).select("id", "split", "pos").collect()) == sorted(rows.collect())


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(tables.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, 0.5]


def test_times_that_cannot_be_read_are_the_epoch(spark):
    said = ["2024-05-06 07:08:09", "2024-05-06T07:08:09Z", "2024-05-06T09:08:09+02:00", "2024-05-06", " 2024-05-06T07:08:09.5 ", "soon", "", None, "2024-13-40"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string")
    got = [r.t for r in df.orderBy("i").select(graph.datetime_literal(graph.parsed_time(F.col("t"))).alias("t")).collect()]
    assert got == ["2024-05-06T07:08:09"] * 3 + ["2024-05-06T00:00:00", "2024-05-06T07:08:09"] + ["1970-01-01T00:00:00"] * 4


def test_sensitivity_of_variants(spark):
    """Three steps of valence and two of frequency over five texts, against a loop over the variants."""
    axes = ([5, 7], [1, 3], [0.5, 1.5, 9.0])
    grid = measure.grid(spark, *axes)
    freq = {5: {"fine": 4, "bad": 3, "meh": 2}, 7: {"fine": 6, "bad": 5, "meh": 4}}
    valence = {"fine": 2.5, "bad": -1.6, "meh": -0.6}
    counts = spark.createDataFrame([(w, t, n) for w, f in freq.items() for t, n in f.items()], "window int, term string, freq long")
    values = spark.createDataFrame(list(valence.items()), "term string, valence double")
    texts = [(1, "fine day bad, meh x", [0, 4], []), (2, "meh meh", [0], [1]), (3, "plain words", [0], [0]), (4, "bad", [], [0]), (5, "", [], [])]
    frame = spark.createDataFrame(texts, "doc_id long, single string, a array<int>, b array<int>").repartition(2)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 1)], "doc_id long, label int")
    found = sensitivity.lexicons(counts, values, grid)
    results = sensitivity.run_grid(found, sensitivity.lattice(counts, values, *axes), frame, {"A": "a", "B": "b"}, labels, axes)
    got = {(r.window, r.min_freq, r.min_valence): r for r in results.collect()}
    assert len(got) == 12
    for (w, f, v), r in got.items():
        terms = {t: max(-2.0, min(2.0, x)) for t, x in valence.items() if freq[w][t] >= f and abs(x) >= v}
        valid = any(x > 0 for x in terms.values()) and any(x < 0 for x in terms.values())
        assert (r["size"], r.status) == (len(terms), "valid" if valid else "invalid")
        if not valid:
            assert r.active_docs is None and r.selected is None
            continue
        per = {}
        for d, single, *places in texts:
            for c, at in zip("AB", places, strict=True):
                sums = [sum(terms.get(x.strip(","), 0.0) for x in single.split()[max(0, p - 5) : p + 6]) for p in at]
                per[d, c] = (sum(x > 0.5 for x in sums), sum(x < -0.5 for x in sums))
        active = {d for (d, _), pn in per.items() if any(pn)}
        cells = [(c, k) for (_, c), (p, n) in per.items() for k, x in (("p", p), ("n", n), ("net", p - n)) if x]
        assert (r.active_docs, r.positive_mentions, r.negative_mentions) == (len(active), sum(p for p, _ in per.values()), sum(n for _, n in per.values()))
        assert (r.assertions, r.cells, r.covered) == (sum(any(x) for x in per.values()), len(cells), len(set(cells))) and math.isclose(r.activation, 20 * len(active))
    c = {r.variant: r for r in sensitivity.compare(results, "w5_f1_v0.5").collect()}
    assert c["w5_f3_v0.5"].delta_size == -1 and math.isclose(c["w5_f3_v0.5"].jaccard, 2 / 3) and c["w7_f1_v0.5"].jaccard == 1.0
    total = sensitivity.aggregate(results).collect()
    assert {(r.variants, r.passed) for r in total} == {(12, 8)} and all("w5_f1_v9.0" in r.invalid for r in total)


def test_manifest(spark):
    declared = spark.createDataFrame([("a" * 64 + "  one",), ("b" * 64 + "  two",), ("c" * 64 + "  gone",), ("rubbish",)], "line string")
    actual = spark.createDataFrame([("one", "a" * 64), ("two", "0" * 64), ("new", "1" * 64)], "name string, sha256 string")
    got = {r.name: r.status for r in audit.manifest_verify(declared, actual).collect()}
    assert got == {"one": "ok", "two": "mismatch", "gone": "missing", "new": "undeclared", "rubbish": "malformed"}
