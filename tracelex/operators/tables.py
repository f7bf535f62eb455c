"""Scans, projections, joins, windows and set operations on posts, splits, features and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelex.operators import dictionary
from tracelex.sources import files

#: Ids on one line of a split file.
SPLIT_BLOCK = 10_000


def columns_by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c, t in df.dtypes if c.startswith(prefix) and t in ("double", "float", "int", "bigint")]


def unpivot(features: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """key, feature, value; nulls are 0."""
    pairs = [F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value")) for n in names]
    return features.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.*")


def placed(df: DataFrame, order: list, weight: Column | None = None, name: str = "before") -> DataFrame:
    """df with the sum of the weights (1 each) of all rows that come before a row in a total order: sums inside range
    partitions, plus the sums of the partitions before. No task holds more than a range. The ranges are written to the
    shared folder, so that every later step sees the same ones."""
    weight = F.lit(1) if weight is None else weight
    own = df.repartitionByRange(*order).withColumn("_weight", weight.cast("long")).withColumn("_part", F.spark_partition_id())
    own = files.through_parquet(own, files.scratch(df.sparkSession))
    parts = own.groupBy("_part").agg(F.sum("_weight").alias("_sum"))  # one row for each partition
    parts = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_base"))
    inside = F.sum("_weight").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(parts, "_part").withColumn(name, F.col("_inside") + F.col("_base")).drop("_weight", "_part", "_inside", "_base")


def project_release(posts: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Null authors are `unknown`, as in the pseudonyms."""
    named = posts.withColumn("author", F.coalesce("author", F.lit("unknown")))
    return named.join(pseudonyms, "author").select("id", "author_id", "body", "topic", "created", "split")


def pseudonym_authors(posts: DataFrame) -> DataFrame:
    """author, author_id: ordinals over the sorted distinct authors (null: `unknown`)."""
    names = posts.select(F.coalesce("author", F.lit("unknown")).alias("author")).distinct()
    return placed(names, ["author"]).select("author", F.format_string("author_%04d", F.col("before") + 1).alias("author_id"))


def write_split(positions: DataFrame, path: str) -> str:
    """positions (id, split, pos) as JSON lines: the split, the first position, and up to SPLIT_BLOCK ids in order."""
    block = F.floor(F.col("pos") / SPLIT_BLOCK)
    rows = positions.groupBy("split", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias("ids"))
    return files.write_report(rows.select("split", (F.col("block") * SPLIT_BLOCK).alias("first"), "ids"), path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """id, split, pos of what write_split wrote."""
    rows = spark.read.schema("split string, first long, ids array<string>").json(path)
    return rows.select("split", "first", F.posexplode("ids").alias("at", "id")).select("id", "split", (F.col("first") + F.col("at")).alias("pos"))


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """id, split, pos of a JSON document with one ordered id list for each split."""
    raw = spark.read.json(path, multiLine=True)
    parts = [raw.select(F.lit(s).alias("split"), F.posexplode(s).alias("pos", "id")) for s in ("train", "val", "test") if s in raw.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("id").cast("string").alias("id"), "split", "pos")


def split_positions(posts: DataFrame) -> DataFrame:
    """doc_id, id, split, pos: place in the split's order (by doc_id)."""
    sizes = posts.groupBy("split").agg(F.count("*").alias("n"))  # one row for each split
    bases = sizes.select(F.col("split").alias("_split"), (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("_first"))
    own = placed(posts.select("doc_id", "id", "split"), ["split", "doc_id"])
    return own.join(bases, F.col("split").eqNullSafe(F.col("_split"))).select("doc_id", "id", "split", (F.col("before") - F.col("_first")).alias("pos"))


def check_split_disjoint(split: DataFrame) -> DataFrame:
    return split.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("n_splits")).where("n > 1")


def join_module_map(rows: DataFrame, modules: DataFrame) -> DataFrame:
    return rows.join(modules, "feature", "left").withColumn("module", F.coalesce("module", F.lit("unmapped")))


def condition_features(modules: DataFrame, selected: DataFrame) -> DataFrame:
    """condition, feature: none for BSL, all, the selected ones, and all but (or only) each module."""
    names = modules.select("module").distinct()
    every = modules.select("feature", F.col("module").alias("own"))
    full = every.select(F.lit("full").alias("condition"), "feature")
    sel = selected.select(F.lit("selected").alias("condition"), "feature")
    drop = names.join(every, F.col("module") != F.col("own")).select(F.concat(F.lit("drop_"), "module").alias("condition"), "feature")
    only = every.select(F.concat(F.lit("module_only_"), "own").alias("condition"), "feature")
    return full.unionByName(sel).unionByName(drop).unionByName(only)


def require_columns(df: DataFrame, names: list[str], key: str) -> DataFrame:
    """check, ok: missing columns by the schema, emptiness and uniqueness of the key by one aggregate."""
    have = set(df.columns)
    agg = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count_if(F.col(key).isNull()).alias("z"))
    rows = [F.struct(F.lit(f"has_{n}").alias("check"), F.lit(n in have).alias("ok")) for n in names]
    rows += [F.struct(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("ok")), F.struct(F.lit("key_unique").alias("check"), (F.col("n") == F.col("d") + F.col("z")).alias("ok")),
             F.struct(F.lit("key_not_null").alias("check"), (F.col("z") == 0).alias("ok"))]
    return agg.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def theta_lexicon_grid(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """variant, term: every (least frequency, least valence) pair at once; the grid is a few hundred rows."""
    return counts.join(F.broadcast(grid), (F.col("freq") >= F.col("min_freq")) & (F.abs("valence") >= F.col("min_valence"))).select("variant", "term")


def set_symmetric_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = a.select(F.col(key).alias("k"), F.lit(1).alias("left")).distinct(), b.select(F.col(key).alias("k"), F.lit(1).alias("right")).distinct()
    both = x.join(y, "k", "full_outer").where("left is null or right is null")
    return both.select(F.col("k").alias(key), F.when(F.col("left").isNull(), "right").otherwise("left").alias("side"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """subset, missing: whether all keys of a are in b, and how many are not."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti").agg((F.count("*") == 0).alias("subset"), F.count("*").alias("missing"))


def build_vocab(tokens: DataFrame, least: int = 2, cap: int | None = None) -> DataFrame:
    """token, freq, index from 2: frequent tokens first, ties by token."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    out = placed(counts, [F.desc("freq"), F.asc("token")]).select("token", "freq", (F.col("before") + 2).alias("index"))
    return out.where(F.col("index") < cap + 2) if cap else out


#: Ids of the commonest tokens, which are looked up in the row.
HEAD = 1 << 16


def encode_tokens(docs: DataFrame, vocab: DataFrame, length: int, words: str = "words", key: str = "doc_id", head: int = HEAD) -> DataFrame:
    """key, ids: the ids of a text's words in order, 1 for unknown ones, cut and padded with 0 to a length; one row for each
    row of docs, also for texts without words. vocab: token, index (from 2, the commonest first).

    The commonest `head` tokens are a hash table that every task looks words up in. Only words that aren't there leave
    their row: with their places they meet the rest of the vocabulary in a shuffled join, and go back to their row. Texts
    and vocabulary are written once on the way. Null words are unknown; rows with a repeated or null key stay apart."""
    spark = docs.sparkSession
    kept = lambda df: files.through_parquet(df, files.scratch(spark))
    vocab = kept(vocab.select("token", F.col("index").cast("int").alias("index")))
    table, held = dictionary.hash_table(vocab.where(F.col("index") < head + 2), "token", "index"), "_table"
    if table is None:
        raise ValueError(f"head is at most {dictionary.MOST}")
    cut = docs.select(key, F.slice(F.coalesce(words, F.array().cast("array<string>")), 1, length).alias("_words")).withColumn(held, table)
    found = cut.withColumn("_ids", F.transform("_words", lambda w: dictionary.looked_up(F.col(held), w))).drop(held)
    rare = F.filter(F.transform("_words", lambda w, i: F.when(F.get(F.col("_ids"), i).isNull(), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    rows = kept(found.select(F.monotonically_increasing_id().alias("_row"), key, "_ids", rare.alias("_rare")))
    tail = vocab.where(F.col("index") >= head + 2)
    pad = lambda ids: F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size(ids))).alias("ids")
    known = F.transform("_ids", lambda i: F.coalesce(i, F.lit(1)))
    if tail.isEmpty():
        return rows.select(key, pad(known))
    some = rows.where("size(_rare) > 0")
    met = some.select("_row", F.explode("_rare").alias("x")).select("_row", F.col("x.i").alias("i"), F.col("x.w").alias("token")).join(tail, "token")
    back = met.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("i", "index"))).alias("_back"))  # of one text's places
    own = F.transform("_ids", lambda i, at: F.coalesce(i, F.try_element_at(F.col("_back"), at), F.lit(1)))
    return rows.where("size(_rare) = 0").select(key, pad(known)).union(some.join(back, "_row", "left").select(key, pad(own)))


def pivot_complete(rows: DataFrame, index: str, column: str, values: list, value: str) -> DataFrame:
    """index x column matrix of the mean of value; ValueError if a cell is missing."""
    out = rows.groupBy(index).pivot(column, values).agg(F.avg(value))
    out = files.through_parquet(out, files.scratch(rows.sparkSession))
    missing = out.agg(*[F.count_if(F.col(f"`{v}`").isNull()).alias(str(v)) for v in values]).first().asDict()
    if any(missing.values()):
        raise ValueError(f"cells of the {index} x {column} matrix are missing: {missing}")
    return out
