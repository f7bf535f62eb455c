"""Ablations: what each module of features adds to each model. Tables of runs, which are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which contributions are compared, so that ties don't depend on the order of a sum.
DIGITS = 9


def baselines(scores: DataFrame, bsl: str = "BSL", full: str = "full") -> DataFrame:
    """scores (model, condition, seed, macro_f1) with the scores of the same model and seed without features, and with all;
    null where there is no such run."""
    own = Window.partitionBy("model", "seed")
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("macro_f1"))).over(own)
    return scores.withColumns({"bsl": of(bsl), "full": of(full)})


def summary(scores: DataFrame, sizes: DataFrame, bsl: str = "BSL", full: str = "full") -> DataFrame:
    """Per model and condition: number of features, means and deviations over seeds (0 for one seed), runs, and how the mean
    differs from those of all features and of none. sizes: condition, n_features."""
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")
    per = scores.groupBy("model", "condition").agg(F.avg("macro_f1").alias("macro_f1"), std("macro_f1"), F.avg("accuracy").alias("accuracy"), std("accuracy"), F.count("*").alias("runs"))
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("macro_f1"))).over(Window.partitionBy("model"))
    return per.join(F.broadcast(sizes), "condition", "left").withColumns({"delta_vs_full": F.col("macro_f1") - of(full), "delta_vs_bsl": F.col("macro_f1") - of(bsl)})


def module_ranks(summaries: DataFrame, prefix: str = "drop_") -> DataFrame:
    """model, module, contribution (what dropping the module costs), rank: per model, ties by the module's name."""
    lost = F.round(-F.col("delta_vs_full"), DIGITS)
    rows = summaries.where(F.startswith("condition", F.lit(prefix))).select("model", F.substr("condition", F.lit(len(prefix) + 1)).alias("module"), lost.alias("contribution"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("contribution"), "module")))
