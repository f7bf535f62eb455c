"""TF-IDF over words and word pairs, with a vocabulary of the commonest terms of the training texts.

Most n-grams of a corpus are rare, and counting all of them shuffles all of them. So they are first counted by bucket, a
sketch that merges to at most BUCKETS numbers and never says too little. The terms of the fullest buckets are counted
exactly; the count of the last one that the vocabulary would take is a bound that only terms of buckets as full can reach,
and those alone are counted exactly, with the number of their texts. The result is exact whatever the corpus.

Cases: null and empty texts have no terms, and a norm of 0; ties go to the lesser term; fewer terms than asked for are all
taken; rows that share a key are one text; an empty training set gives an empty vocabulary; other columns are kept where
said, and not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.operators import dictionary
from tracelex.sources import files

#: Buckets of the sketch, and how many times as many buckets as terms are counted to find the bound.
BUCKETS, FULLEST = 1 << 20, 2


def words(text: Column) -> Column:
    """Words of two and more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w{2,}"), F.lit(0))


def each_gram(cut: DataFrame, key: str) -> DataFrame:
    """key, g: a row for each of `grams`, from rows with the words of a text (_words); functions that Spark compiles alone."""
    behind = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    both = cut.select(key, "_words", behind.alias("_behind")).select(key, F.explode(F.arrays_zip("_words", "_behind")).alias("p"))
    return both.select(key, F.explode(F.array("p._words", F.concat("p._words", F.lit(" "), "p._behind"))).alias("g")).where("g IS NOT NULL")


def grams(text: Column) -> Column:
    """Words of two and more characters, and pairs of neighbours."""
    one = words(text)
    pairs = F.zip_with(one, F.slice(one, 2, F.greatest(F.size(one) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(one, F.filter(pairs, lambda x: x.isNotNull()))


def vocabulary(train: DataFrame, size: int = 5000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """g, tf, df, idf, place of the `size` terms with the most occurrences, by falling tf and then by term; idf is
    ln((1 + texts) / (1 + df)) + 1. The words are cut once and stored; of three scans of them, the first two run while this
    is built."""
    spark = train.sparkSession
    kept = lambda df: files.through_parquet(df, files.scratch(spark))
    bucket = F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int").alias("b")
    cut = kept(train.select(key, words(F.col(text)).alias("_words")))
    each = each_gram(cut, key).select(key, "g", bucket)
    sketch = kept(each.groupBy("b").agg(F.count("*").alias("most")))
    fullest = sketch.orderBy(F.desc("most"), "b").limit(FULLEST * size).select("b")  # a report of bounded length
    sure = each.join(F.broadcast(fullest), "b", "left_semi").groupBy("g").agg(F.count("*").alias("tf")).orderBy(F.desc("tf")).limit(size)
    bound = sure.agg(F.when(F.count("*") == size, F.min("tf")).otherwise(F.lit(0)).alias("t")).first().t or 0
    rest = each.join(sketch.where(F.col("most") >= bound).select("b"), "b", "left_semi")
    counts = rest.groupBy(key, "g").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).where(F.col("tf") >= bound)
    best = counts.orderBy(F.desc("tf"), "g").limit(size)
    texts = train.agg(F.count_distinct(key).alias("n"))  # one row
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("neg"), "g", "tf", "df"))).alias("v")).select(F.posexplode("v").alias("place", "x")).select("place", "x.g", "x.tf", "x.df")
    return kept(listed.join(F.broadcast(texts), F.lit(True)).select("g", "tf", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "place"))


def weights(docs: DataFrame, terms: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, place, g, weight: the terms of each text, tf times idf, of length 1 for each text."""
    # Texts are shuffled as places and numbers: a term's words and idf are joined behind the shuffles (`size` terms).
    each = docs.select(key, F.explode(grams(F.col(text))).alias("g")).join(F.broadcast(terms.select("g", "place")), "g").select(key, "place")
    counts = each.groupBy(key, "place").agg(F.count("*").alias("n"))
    own = counts.join(F.broadcast(terms.select("place", "idf")), "place").select(key, "place", (F.col("n") * F.col("idf")).alias("w"))
    norm = own.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    found = own.join(norm, key).select(key, "place", (F.col("w") / F.col("norm")).alias("weight"))
    return found.join(F.broadcast(terms.select("g", "place")), "place").select(key, "place", "g", "weight")


def places(docs: DataFrame, terms: DataFrame, text: str = "text", name: str = "places") -> DataFrame:
    """docs with the places of a text's known terms, one for each occurrence, words before pairs, in the row: nothing is
    shuffled. Spark cuts the words; a batch's words and pairs are looked up at once, pairs only of words that begin and end
    some term."""
    if terms.limit(dictionary.MOST + 1).count() > dictionary.MOST:
        raise ValueError("a vocabulary of features has at most dictionary.MOST terms")
    listed = [r.g for r in terms.orderBy("place").collect()]  # `size` rows
    return docs.withColumn(name, F.arrow_udf(found(listed), "array<int>")(words(F.col(text))))


def found(listed: list[str]) -> Callable:
    """Lists of words to lists of places in `listed`."""
    of = {kind: [i for i, g in enumerate(listed) if (" " in g) == kind] for kind in (False, True)}
    pairs = [listed[i].split(" ") for i in of[True]]
    firsts, seconds = (sorted({p[j] for p in pairs}) for j in (0, 1))

    def run(cut: pa.Array) -> pa.Array:
        n, flat = len(cut), cut.flatten()
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(cut), 0).to_numpy())

        def looked_up(values: pa.Array, rows: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
            at = pc.fill_null(pc.index_in(values, pa.array([listed[i] for i in of[kind]], values.type)), -1).to_numpy()
            known = at >= 0
            return rows[known], np.array(of[kind], np.int32)[at[known]]

        first, second = flat[:-1], flat[1:]
        both = pc.and_(pc.is_in(first, pa.array(firsts, flat.type)), pc.is_in(second, pa.array(seconds, flat.type))).to_numpy(zero_copy_only=False) & (row[:-1] == row[1:])
        joined = pc.binary_join_element_wise(first.filter(pa.array(both)), second.filter(pa.array(both)), pa.scalar(" ", flat.type))
        parts = [looked_up(flat, row, False), looked_up(joined, row[:-1][both], True)]
        row, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[np.argsort(row, kind="stable")], pa.int32()))

    return run
