"""Sensitivity of lexicon, coverage, graph and selection to window, frequency and valence: all variants in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.operators import dictionary, measure, tables
from tracelex.sources import files

METRICS = ["size", "active_docs", "activation", "covered", "positive_mentions", "negative_mentions", "assertions", "cells", "selected", "selected_active"]

#: What a concept contributes to a text's features.
SIDES = ("positive", "negative", "net")

# Window, least frequency and least valence of the seven rows of the small grid, the canonical one first.
SMALL = [(5, 3, 1.0), (3, 3, 1.0), (7, 3, 1.0), (5, 2, 1.0), (5, 5, 1.0), (5, 3, 0.5), (5, 3, 1.5)]


def lexicons(counts: DataFrame, valence: DataFrame, grid: DataFrame) -> DataFrame:
    """variant, window, min_freq, min_valence, size, positive, negative, terms (sorted), status of every variant of a grid.

    counts: window, term, freq; valence: term, valence; grid: variant, window, min_freq, min_valence (a few hundred rows)."""
    own = counts.join(valence, "term").join(F.broadcast(grid), (counts["window"] == grid["window"]) & (F.col("freq") >= F.col("min_freq")) & (F.abs("valence") >= F.col("min_valence")))
    per = own.groupBy("variant").agg(F.count("*").alias("size"), F.count_if(F.col("valence") > 0).alias("positive"), F.count_if(F.col("valence") < 0).alias("negative"), F.array_sort(F.collect_set("term")).alias("terms"))
    out = grid.join(per, "variant", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("size", "positive", "negative")})
    out = out.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return out.withColumn("status", F.when((F.col("positive") > 0) & (F.col("negative") > 0), "valid").otherwise("invalid"))


def lattice(counts: DataFrame, valence: DataFrame, windows: list[int], frequencies: list[int], valences: list[float], clamp: float = 2.0) -> DataFrame:
    """term, cell: where a term stands among the steps of the grid. A cell has the term's weight, how many of the (rising)
    valences it reaches, and for each window how many of the frequencies. counts: window, term, freq; valence: term, valence."""
    reached = lambda steps, x: F.size(F.filter(F.array(*[F.lit(v) for v in steps]), lambda v: x >= v))
    freq = F.map_from_entries(F.collect_list(F.struct("window", "freq")))
    per = counts.where(F.col("window").isin(windows)).groupBy("term").agg(freq.alias("freq")).join(valence, "term")
    weight = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col("valence")))
    of_window = F.array(*[reached(frequencies, F.coalesce(F.try_element_at("freq", F.lit(w)), F.lit(0))) for w in windows])
    return per.select("term", F.struct(weight.alias("w"), reached(valences, F.abs("valence")).alias("v"), of_window.alias("f")).alias("cell"))


def _added_up(axes: tuple[list, list, list], n_concepts: int) -> Callable:
    """For rows of a label and, for each concept, the mentions' cells: per variant, label and set of features that are not
    0, the number of texts and the sums and squares of each feature (positive, negative and net mentions of each concept)."""
    steps = [(f"{w}|{f}|{v}", i, j + 1, k + 1) for i, w in enumerate(axes[0]) for j, f in enumerate(axes[1]) for k, v in enumerate(axes[2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = batch.num_rows, []
            label = batch.column(0).fill_null(-1).to_numpy()
            for column in batch.columns[1:]:
                text, mentions = np.repeat(np.arange(n), column.value_lengths().to_numpy()), column.flatten()
                cells, mention = mentions.flatten(), np.repeat(np.arange(len(mentions)), mentions.value_lengths().to_numpy())
                weight, v = cells.field("w").to_numpy(), cells.field("v").to_numpy()
                parts.append((text, mention, weight, v, cells.field("f").flatten().to_numpy().reshape(-1, len(axes[0]))))
            out = []
            for key, w, f, v in steps:
                values = np.zeros((3 * n_concepts, n), np.int64)
                for c, (text, mention, weight, valence, freq) in enumerate(parts):
                    on = (freq[:, w] >= f) & (valence >= v)
                    polarity = np.bincount(mention[on], weight[on], len(text))
                    values[3 * c], values[3 * c + 1] = (np.bincount(text[side], minlength=n) for side in (polarity > 0.5, polarity < -0.5))
                    values[3 * c + 2] = values[3 * c] - values[3 * c + 1]
                mask = ((values != 0) << np.arange(3 * n_concepts)[:, None]).sum(0)
                some = np.flatnonzero(mask)
                group, at = np.unique(np.stack([label[some], mask[some]]), axis=1, return_inverse=True)
                counts = [np.bincount(at, minlength=group.shape[1])] + [np.bincount(at, x[some] ** p, group.shape[1]).astype(np.int64) for p in (1, 2) for x in values]
                out += [(key, None if a < 0 else int(a), int(b), *map(int, row)) for (a, b), row in zip(group.T, np.stack(counts, 1), strict=True)]
            names = ["key", "label", "mask", "n", *[f"{x}{i}" for x in "sq" for i in range(3 * n_concepts)]]
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * (1 + 6 * n_concepts)]
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def run_grid(variants: DataFrame, cells: DataFrame, texts: DataFrame, places: dict[str, str], labels: DataFrame, axes: tuple[list, list, list], level: float = 0.05) -> DataFrame:
    """variants with, for each valid one: active_docs (texts with a mention that isn't neutral) and activation (their
    share in per cent), covered (features that are somewhere not 0), positive_mentions, negative_mentions, assertions
    (text and concept with such a mention), cells (features of texts that are not 0), selected (features with an ANOVA p
    below level over the labelled training texts) and selected_active (texts where one of those is not 0).

    One scan for all variants. A word's cell in the lattice of frequency and valence says for every variant whether it
    counts, so a word near a mention is looked up once; a mention keeps the few cells of its window, and a variant's polarity sums
    those that dominate its steps, for all mentions of a batch together. What a batch gives leaves it as sums by variant,
    label and the set of a text's features.

    variants: all of axes (windows, frequencies, valences), 125 rows or so; texts: doc_id, single (white space collapsed) and
    for each concept the column of its mentions' places; cells: of `lattice`; labels: doc_id, label of the training texts."""
    windows, frequencies, valences = axes
    table = dictionary.hash_table(cells, "term", "cell")
    if table is None:
        raise ValueError("a lexicon under a grid of thresholds has at most dictionary.MOST terms")
    rows = dictionary.windows_looked_up(texts.withColumn("words", F.split("single", " ")), table, list(places.values()), "seen")

    def of(i: int) -> Column:
        near = F.transform(F.filter("seen", lambda x: x["k"] == i), lambda x: F.filter(x["values"], lambda c: c.isNotNull()))
        return F.filter(near, lambda m: F.size(m) > 0)

    live = [of(i).alias(f"m{i}") for i in range(len(places))]
    n_values = 3 * len(live)
    each = rows.select("doc_id", *live).join(labels, "doc_id", "left").select("label", *[f"m{i}" for i in range(len(live))])
    sums = ", ".join(f"{x}{i} long" for x in "sq" for i in range(n_values))
    found = each.mapInArrow(_added_up(axes, len(live)), f"key string, label int, mask int, n long, {sums}")
    facts = found.groupBy("key", "label", "mask").agg(F.sum("n").alias("n"), *[F.sum(f"{x}{i}").alias(f"{x}{i}") for x in "sq" for i in range(n_values)])
    facts = files.through_parquet(facts, files.scratch(texts.sparkSession))  # at most variants x labels x sets of features

    features = [(f"{c}_{side}", 3 * i + k) for i, c in enumerate(places) for k, side in enumerate(SIDES)]
    long = facts.where("label is not null").select("key", "label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for f, i in features])).alias("v")).select("key", "label", "v.*")
    classes = labels.groupBy("label").agg(F.count("*").alias("c"))
    total = classes.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    per = long.groupBy("key", "feature", "label").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    # Texts without such mentions have 0: they only count in the sizes of the classes.
    per = per.join(F.broadcast(classes), "label").groupBy("key", "feature").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("b"))
    per = per.join(F.broadcast(total), F.lit(True))  # three classes, one total
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = F.when(F.abs(within) > 1e-12, F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))))
    tested = measure.anova_p(per.select(F.concat_ws("/", "key", "feature").alias("feature"), "k", "n", f.alias("f"))).where(F.col("p") < level)
    at = F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(1 << i).alias("bit")) for x, i in features])
    bits = per.sparkSession.range(1).select(F.explode(at).alias("x")).select("x.*")
    chosen = tested.select(F.substring_index("feature", "/", 1).alias("key"), F.substring_index("feature", "/", -1).alias("feature")).join(F.broadcast(bits), "feature")
    chosen = chosen.groupBy("key").agg(F.count("*").alias("selected"), F.sum("bit").alias("chosen"))

    p, n = ([F.col(f"s{3 * i + k}") for i in range(len(live))] for k in (0, 1))
    on = [(F.col("mask").bitwiseAND(0b111 << (3 * i)) != 0).cast("int") for i in range(len(live))]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    found = facts.join(F.broadcast(chosen), "key", "left").groupBy("key").agg(
        F.sum("n").alias("active_docs"), F.sum(add(p)).alias("positive_mentions"), F.sum(add(n)).alias("negative_mentions"), F.sum(F.col("n") * add(on)).alias("assertions"),
        F.sum(F.col("n") * F.bit_count("mask")).alias("cells"), F.bit_count(F.bit_or("mask")).cast("long").alias("covered"), F.max(F.coalesce("selected", F.lit(0))).alias("selected"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.coalesce("chosen", F.lit(0))) != 0, F.col("n")).otherwise(0)).alias("selected_active"),
    )
    docs = texts.agg(F.count("*").alias("_docs"))
    key = F.concat_ws("|", "window", "min_freq", F.col("min_valence").cast("string"))
    out = variants.withColumn("key", key).join(found, "key", "left").drop("key").join(F.broadcast(docs), F.lit(True))
    out = out.withColumn("activation", 100 * F.coalesce("active_docs", F.lit(0)) / F.greatest("_docs", F.lit(1))).drop("_docs")
    return out.withColumns({c: F.when(F.col("status") == "valid", F.coalesce(c, F.lit(0))) for c in METRICS[1:]})


def aggregate(results: DataFrame) -> DataFrame:
    """A row for each metric: its summary over the valid variants, how many variants there are and passed, and the names of
    those that didn't."""
    ok = F.col("status") == "valid"
    per = measure.numeric_summary(tables.unpivot(results.where(ok), METRICS, "variant").withColumnRenamed("feature", "metric"), "value", ["metric"])
    passed = results.agg(F.count("*").alias("variants"), F.count_if(ok).alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col("variant")))), ",").alias("invalid"))
    return per.join(F.broadcast(passed), F.lit(True))  # one row


def compare(results: DataFrame, canonical: str) -> DataFrame:
    """variant, window, min_freq, min_valence, the difference of each metric from the canonical variant's, and the Jaccard
    of the terms."""
    base = results.where(F.col("variant") == canonical).select(F.col("terms").alias("_terms"), *[F.col(m).alias(f"_{m}") for m in METRICS])
    out = results.join(F.broadcast(base), F.lit(True))  # one row
    return out.select("variant", "window", "min_freq", "min_valence", *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in METRICS], tables.jaccard(F.col("terms"), F.col("_terms")).alias("jaccard"))


def collected(spark, path: str, grid: DataFrame) -> DataFrame:
    """variant, status, metrics of every variant of a grid from the stored reports; `missing` where there is none, and
    `repeated` where there are several."""
    schema = "variant string, status string, " + ", ".join(f"{m} {'double' if m == 'activation' else 'long'}" for m in METRICS)
    stored = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    per = stored.groupBy("variant").agg(F.count("*").alias("_n"), F.max("status").alias("_status"), *[F.max(m).alias(m) for m in METRICS])
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").otherwise(F.col("_status"))
    return grid.select("variant").join(per, "variant", "left").select("variant", status.alias("status"), *METRICS)
