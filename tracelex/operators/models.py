"""TF-IDF features, classifiers and ablations with Spark ML."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelex.operators import boosting, linear, terms
from tracelex.sources import files


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, weight: n / (k * n of the class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    return n.join(F.broadcast(total), F.lit(True)).select(label, (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))


def tfidf(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """docs with a vector column tfidf over the terms of `terms.vocabulary`: tf times idf, of unit length."""
    listed = vocabulary.orderBy("place").collect()  # `size` rows
    counts = CountVectorizerModel.from_vocabulary([r.g for r in listed] or [" "], inputCol="_grams", outputCol="_tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in listed] or [0.0]), inputCol="_tf", outputCol="_weighted")
    unit = Normalizer(inputCol="_weighted", outputCol="tfidf")
    return unit.transform(scale.transform(counts.transform(docs.withColumn("_grams", terms.grams(F.col(text)))))).drop("_grams", "_tf", "_weighted")


def stack_semantic(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds features: tfidf and the named columns, nulls as 0."""
    return VectorAssembler(inputCols=["tfidf", *names], outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, names) if names else df)


#: Sizes of the models: iterations, trees or rounds, and depth; and the terms that each sees.
SIZES = {"lr": (1000, None), "rf": (300, 20), "gbt": (300, 6)}
TERMS = {"lr": 5000, "rf": 10000, "gbt": 10000}


def classifier(kind: str, seed: int = 42, rounds: int | None = None, depth: int | None = None, weights: float = 1000.0):
    """Spark ML's: lr, multinomial, penalty C = 1, which is 1 / (sum of the training weights) here; rf, at least two rows in
    a leaf. The grid trains lr and gbt itself (`linear`, `boosting`)."""
    rounds, depth = rounds or SIZES[kind][0], depth or SIZES[kind][1]
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "lr":
        return LogisticRegression(maxIter=rounds, regParam=1 / weights, standardization=False, family="multinomial", **common)
    return RandomForestClassifier(numTrees=rounds, maxDepth=depth, minInstancesPerNode=2, seed=seed, **common)


def predict_table(model, rows: DataFrame, kind: str, condition: str, seed: int) -> DataFrame:
    out = model.transform(rows)
    return out.select("id", "split", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), F.lit(kind).alias("model"), F.lit(condition).alias("condition"), F.lit(seed).alias("seed"))


def ablation_grid(
    rows: DataFrame, conditions: dict[str, list[str]], kinds: tuple[str, ...] = ("lr", "rf", "gbt"), seeds: tuple[int, ...] = (42, 123, 2024), size: int | None = None,
    sizes: dict[str, tuple[int, int | None]] | None = None,
) -> DataFrame:
    """Predictions on the test rows for every model, seed and condition; the vocabulary is fitted and the rows are written
    once. lr trains all conditions together (`linear`) on standardised columns; trees take raw ones, one fit after the
    other, gbt over rows that are binned once. size: terms, where not those of TERMS; sizes: (iterations or trees, depth) by
    kind, where not those of SIZES."""
    spark, train = rows.sparkSession, rows.where("split = 'train'")
    terms_of = {kind: size or TERMS[kind] for kind in kinds}
    every = terms.vocabulary(train, max(terms_of.values()), key="id")
    vocabulary = lambda kind: every.where(F.col("place") < terms_of[kind])  # noqa: E731  # the commonest come first
    weighted = rows.join(F.broadcast(class_weights(train)), "label")  # one row for each label
    names = sorted({n for own in conditions.values() for n in own})
    out = []
    size_of = SIZES | (sizes or {})
    if "lr" in kinds:
        out.append(joint_lr(weighted, vocabulary("lr"), conditions, names, seeds, size_of["lr"][0]))
    if "gbt" in kinds:
        out.append(boosted(weighted, vocabulary("gbt"), conditions, names, seeds, *size_of["gbt"]))
    if others := [k for k in kinds if k not in ("lr", "gbt")]:
        text = files.through_parquet(tfidf(weighted, vocabulary("rf")), files.scratch(spark))
        for condition, own in conditions.items():
            stacked = stack_semantic(text, own)
            for kind in others:
                rounds, depth = size_of[kind]
                for seed in seeds:
                    model = classifier(kind, seed, rounds, depth).fit(stacked.where("split = 'train'"))
                    out.append(predict_table(model, stacked.where("split = 'test'"), kind, condition, seed))
    return reduce(DataFrame.unionByName, out)


def shared_rows(rows: DataFrame, vocabulary: DataFrame, names: list[str], scaled: bool) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Rows that all fits of a kind share, written once in a part for each core: id, split, label, weight, places, semantic
    (standardised over the training rows, or as they are), y (the label's number, null without one); the terms' idf; the
    labels."""
    spark, train = rows.sparkSession, rows.where("split = 'train'")
    raw = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    if scaled and names:
        fit = train.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(raw) for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()  # two numbers a column
        raw = [(x - F.lit(fit[f"m{i}"] or 0.0)) / F.lit(fit[f"d{i}"] or 1.0) for i, x in enumerate(raw)]
    labels = sorted(r.label for r in train.select("label").where("label is not null").distinct().collect())  # one row a class
    y = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")) - 1
    placed = terms.places(rows, vocabulary).select("id", "split", "label", "weight", "places", F.array(*raw).cast("array<double>").alias("semantic"), y.alias("y"))
    placed = files.through_parquet(placed.repartition(spark.sparkContext.defaultParallelism), files.scratch(spark))
    return placed, np.array([r.idf for r in vocabulary.orderBy("place").collect()]), labels  # `size` numbers


def named(found: DataFrame, labels: list[int], kind: str) -> DataFrame:
    """Prediction rows: classes back to labels."""
    y = F.get(F.array(*[F.lit(v) for v in labels]), F.col("y_pred")).cast("int")
    return found.select("id", "split", "y_true", y.alias("y_pred"), F.lit(kind).alias("model"), "condition", "seed")


def joint_lr(rows: DataFrame, vocabulary: DataFrame, conditions: dict[str, list[str]], names: list[str], seeds: tuple[int, ...], most: int) -> DataFrame:
    """Prediction rows of logistic regressions of all conditions, trained together. rows: id, split, label, weight, text
    and the semantic columns."""
    placed, idf, labels = shared_rows(rows, vocabulary, names, True)
    masks = np.array([[float(n in own) for n in names] for own in conditions.values()]).reshape(len(conditions), len(names))
    w = linear.fit(placed.where("split = 'train' and label is not null"), idf, masks, len(labels), most)
    test = placed.where("split = 'test'").withColumn("y_true", F.col("label").cast("int"))
    found = linear.predict(test, w, idf, list(conditions), ["id", "split", "y_true"])
    return named(found.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in seeds]))), labels, "lr")


def boosted(rows: DataFrame, vocabulary: DataFrame, conditions: dict[str, list[str]], names: list[str], seeds: tuple[int, ...], rounds: int, depth: int, rate: float = 0.1) -> DataFrame:
    """Prediction rows of boosted trees for every condition and seed, over rows that are binned once; a condition's bytes
    are those of the terms and of its columns."""
    placed, idf, labels = shared_rows(rows, vocabulary, names, False)
    train = placed.where("split = 'train' and label is not null")
    keep = ["id", "split", "y", "weight", "label"]
    edges = boosting.bin_edges(boosting.filled(train, idf), len(idf) + len(names))
    every = files.through_parquet(boosting.byte_rows(placed, idf, edges, keep), files.scratch(rows.sparkSession))
    out = []
    for condition, used in conditions.items():
        bytes_ = [F.substring("bins", 1, len(idf)), *[F.substring("bins", len(idf) + 1 + names.index(n), 1) for n in used]]
        cut = every.withColumn("bins", F.concat(*bytes_))
        test = cut.where("split = 'test'").withColumn("y_true", F.col("label").cast("int"))
        for seed in seeds:
            trees = boosting.fit(cut.where("split = 'train' and label is not null"), len(idf) + len(used), len(labels), rounds, depth, rate, seed=seed)
            found = boosting.predict(test, trees, rate, ["id", "split", "y_true"])
            out.append(named(found.withColumns({"condition": F.lit(condition), "seed": F.lit(seed)}), labels, "gbt"))
    return reduce(DataFrame.unionByName, out)
