"""Ablation tables and the chain of relations against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tracelex.operators import ablation, audit

SCORES = [("lr", c, s, m, m) for c, ms in {"BSL": (0.4, 0.5), "full": (0.7, 0.8), "drop_a": (0.5, 0.6), "drop_b": (0.7, 0.8), "drop_c": (0.9, 0.8)}.items() for s, m in zip((1, 2), ms, strict=True)] + [("rf", "drop_a", 1, 0.5, 0.5)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "model string, condition string, seed int, macro_f1 double, accuracy double")


def test_baselines(scores):
    got = {(r.model, r.condition, r.seed): (r.bsl, r.full) for r in ablation.baselines(scores).collect()}
    assert got["lr", "drop_a", 1] == (0.4, 0.7) and got["lr", "BSL", 2] == (0.5, 0.8) and got["rf", "drop_a", 1] == (None, None)


def test_summaries_and_ranks(spark, scores):
    sizes = spark.createDataFrame([("BSL", 0), ("full", 6), ("drop_a", 4)], "condition string, n_features int")
    out = ablation.summary(scores, sizes)
    got = {(r.model, r.condition): r for r in out.collect()}
    r = got["lr", "drop_a"]
    assert math.isclose(r.macro_f1, 0.55) and math.isclose(r.macro_f1_std, math.sqrt(0.005)) and r.runs == 2 and r.n_features == 4
    assert math.isclose(r.delta_vs_full, -0.2) and math.isclose(r.delta_vs_bsl, 0.1) and got["lr", "drop_b"].n_features is None
    assert got["rf", "drop_a"].macro_f1_std == 0 and got["rf", "drop_a"].delta_vs_full is None
    ranks = [(r.model, r.module, r.contribution, r["rank"]) for r in ablation.module_ranks(out).where("model = 'lr'").orderBy("rank").collect()]
    assert ranks == [("lr", "a", 0.2, 1), ("lr", "b", 0.0, 2), ("lr", "c", -0.1, 3)]


def chain(spark, trace, predictions, conforms=True):
    posts = spark.createDataFrame([("1", "i1"), ("2", "i2")], "id string, iri string")
    cells = spark.createDataFrame([("1", "f", 2.0), ("2", "f", 0.0), ("1", "g", 9.0), ("2", "g", 0.0)], "id string, feature string, value double")
    one = spark.createDataFrame([(conforms, 0 if conforms else 3)], "conforms boolean, results long")
    test = spark.createDataFrame([("2", 1)], "id string, label int")
    t = spark.createDataFrame(trace, "id string, post_iri string, feature string, module string, value double")
    p = spark.createDataFrame(predictions, "condition string, seed int, id string, split string, y_true int")
    return {r.relation: (r.expected, r.verified, r.exceptions, r.status) for r in audit.reconcile_chain(posts, t, cells, spark.createDataFrame([("f",)], "feature string"), one, p, test).collect()}


GOOD = [("1", "i1", "f", "m", 2.0), ("1", "i1", "g", "m", 9.0), ("2", "i2", None, None, None)]
RUNS = [("A", 1, "2", "test", 1), ("B", 1, "2", "test", 1)]


def test_a_chain_in_order(spark):
    assert chain(spark, GOOD, RUNS) == {"posts": (2, 2, 0, "passed"), "activations": (1, 1, 0, "passed"), "cells": (2, 2, 0, "passed"), "constraints": (1, 1, 0, "passed"), "predictions": (2, 2, 0, "passed")}


def test_a_chain_with_faults(spark):
    bad = "attention required"
    trace = [("1", "wrong", "f", None, 2.5), ("1", "wrong", "f", "m", 2.5)]
    runs = [("A", 1, "2", "test", 0), ("A", 1, "2", "val", 1), ("B", 1, "9", "test", 1)]
    assert chain(spark, trace, runs, False) == {
        "posts": (2, 1, 2, bad), "activations": (1, 2, 1, bad), "cells": (2, 1, 2, bad), "constraints": (1, 0, 4, bad),
        # A: a repeated row, a wrong split, a wrong label; B: an unknown id, whose label is wrong then, and a missing one.
        "predictions": (2, 3, 6, bad),
    }


def test_empty_tables(spark):
    assert chain(spark, [], [])["predictions"] == (0, 0, 0, "passed") and chain(spark, [], [])["posts"] == (2, 0, 2, "attention required")
