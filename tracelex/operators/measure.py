"""Aggregations, evaluation, selection and sensitivity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelex.operators import tables


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by, and exact quantiles (linear between neighbours) by name: equal values are counted first, placed by ranges, and
    the two rows that a quantile lies between are picked. Nulls are left out. No task holds a whole group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    own = tables.placed(counts, [*by, value], F.col("_c"), "_before")
    size = own.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_before").alias("_first"))
    own = own.join(size, by).withColumn("_start", F.col("_before") - F.col("_first"))
    holds = lambda i: F.max(F.when((F.col("_start") <= i) & (i < F.col("_start") + F.col("_c")), F.col(value)))
    place = {k: F.lit(q) * (F.col("_n") - 1) for k, q in at.items()}
    picked = own.groupBy(*by).agg(F.max("_n").alias("_n"), *[e for k, h in place.items() for e in (holds(F.floor(h)).alias(f"_low_{k}"), holds(F.ceil(h)).alias(f"_high_{k}"))])
    return picked.select(*by, *[(F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (h - F.floor(h))).alias(k) for k, h in place.items()])


def feature_coverage(rows: DataFrame) -> DataFrame:
    """rows: feature, value."""
    hit = F.count_if(F.col("value") != 0)
    out = rows.groupBy("feature").agg(hit.alias("nonzero"), (100 * hit / F.count("*")).alias("percent"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.count_if(F.col("value").isNull()).alias("missing"))
    return out.join(quantiles(rows, ["feature"], "value", {"median": 0.5}), "feature", "left")


def module_coverage(rows: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows: key, feature, module, split, value; selected: feature. Per module: its features, how many of them are selected,
    posts with any activation, and their share in each split."""
    known = rows.select("module", "feature").distinct().join(F.broadcast(selected.select("feature", F.lit(1).alias("_s"))), "feature", "left")  # a row for each feature
    known = known.groupBy("module").agg(F.count("*").alias("features"), F.count("_s").alias("selected"))
    per = rows.groupBy(key, "module", "split").agg((F.sum(F.abs("value")) > 0).alias("active"))
    share = lambda s: (100 * F.count_if(F.col("active") & (F.col("split") == s)) / F.count_if(F.col("split") == s)).alias(f"{s}_percent")
    return per.groupBy("module").agg(F.count_if("active").alias("active"), (100 * F.count_if("active") / F.count("*")).alias("percent"), share("train"), share("val"), share("test")).join(known, "module")


def label_entropy(rows: DataFrame, by: str) -> DataFrame:
    """Base-2 entropy of the labels in each group."""
    n = rows.groupBy(by, "label").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return n.select(by, (-p * F.log2(p)).alias("e")).groupBy(by).agg(F.sum("e").alias("entropy"))


def numeric_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))
    return out.join(quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)


def confusion_matrix(predictions: DataFrame, by: list[str]) -> DataFrame:
    """by, y_true, y_pred, n over the fixed grid of three classes."""
    spark = predictions.sparkSession
    grid = spark.range(9).select((F.col("id") / 3).cast("int").alias("y_true"), (F.col("id") % 3).cast("int").alias("y_pred"))
    counts = predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    runs = counts.select(*by).distinct().join(F.broadcast(grid), F.lit(True))
    return runs.join(counts, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def metrics_per_class(matrix: DataFrame, by: list[str]) -> DataFrame:
    rows = matrix.select(*by, "n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), ((F.col("y_true") == c) & (F.col("y_pred") == c)).alias("hit"), (F.col("y_true") == c).alias("own"), (F.col("y_pred") == c).alias("said"))
        for c in range(3)])).alias("x")).select(*by, "n", "x.*")
    s = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    out = rows.groupBy(*by, "label").agg(s("hit").alias("hit"), s("own").alias("support"), s("said").alias("said"))
    p, r = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("support"))
    return out.select(*by, "label", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support", "said", "hit")


def metrics_overall(per_class: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro F1 over the labels that occur, weighted F1."""
    seen = (F.col("support") > 0) | (F.col("said") > 0)
    return per_class.groupBy(*by).agg(
        _ratio(F.sum("hit"), F.sum("support")).alias("accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def confusion_delta(matrix: DataFrame, plus: str = "ENR", minus: str = "BSL") -> DataFrame:
    """y_true, y_pred, delta: row shares in points, one condition less the other, averaged over seeds."""
    share = 100 * _ratio(F.col("n"), F.sum("n").over(Window.partitionBy("condition", "seed", "y_true")))
    rows = matrix.select("condition", "seed", "y_true", "y_pred", share.alias("s"))
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("s")))
    return rows.groupBy("y_true", "y_pred").agg((mean(plus) - mean(minus)).alias("delta"))


def seed_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.bround(F.avg("macro_f1"), 4).alias("mean"), F.bround(F.stddev_samp("macro_f1"), 4).alias("std"), F.count("*").alias("n_seeds"))


def anova_f(rows: DataFrame) -> DataFrame:
    """feature, k, n, f. rows: feature, label, value. Sums are taken of values less the feature's mean."""
    mean = rows.groupBy("feature").agg(F.avg("value").alias("centre"))
    x = F.col("value") - F.col("centre")
    per = rows.join(F.broadcast(mean), "feature").groupBy("feature", "label").agg(F.count("*").alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    out = per.groupBy("feature").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k")))
    return out.select("feature", "k", "n", F.when(F.abs(within) > 1e-12, f).alias("f"))


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution: the incomplete beta function as a continued fraction (modified Lentz)."""
    if f is None or not f >= 0:
        return float("nan")
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = c = 1.0
    d = 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def anova_p(f: DataFrame) -> DataFrame:
    """Adds p. f has one row for each feature, a few hundred at most; they are worked out on the driver."""
    rows = [(*r, None if r.f is None else f_tail(r.f, r.k - 1, r.n - r.k)) for r in f.collect()]
    return f.sparkSession.createDataFrame(rows, f.schema.add("p", "double"))


def support_check(predictions: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """by, label, n, expected, ok: rows of each class in each run against the same support for all. expected: label, n."""
    runs = predictions.select(*by).distinct().join(F.broadcast(expected.select("label", F.col("n").alias("expected"))), F.lit(True))  # one row for each run, three classes
    n = predictions.groupBy(*by, F.col("y_true").alias("label")).agg(F.count("*").alias("n"))
    out = runs.join(n, [*by, "label"], "full_outer").select(*by, "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return out.withColumn("ok", F.col("n") == F.col("expected"))


def select_features(f: DataFrame, level: float = 0.05) -> DataFrame:
    return anova_p(f).where(F.col("p") < level).orderBy(F.asc_nulls_last("p"), F.desc("f"), "feature")


def standardize(rows: DataFrame) -> DataFrame:
    """Adds z: (value - train mean) / train population deviation; a deviation of 0 counts as 1."""
    fit = rows.where("split = 'train'").groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return rows.join(F.broadcast(fit), "feature").withColumn("z", (F.col("value") - F.col("m")) / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).drop("m", "d")


def grid(spark, windows, frequencies, valences) -> DataFrame:
    """variant, window, min_freq, min_valence for every combination."""
    axes = [F.array(*[F.lit(x) for x in xs]) for xs in (windows, frequencies, valences)]
    out = spark.range(1).select(F.explode(axes[0]).alias("window")).select("window", F.explode(axes[1]).alias("min_freq")).select("*", F.explode(axes[2]).alias("min_valence"))
    return out.withColumn("variant", F.format_string("w%d_f%d_v%s", "window", "min_freq", F.col("min_valence").cast("string")))
