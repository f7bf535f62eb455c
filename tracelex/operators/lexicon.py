"""Inducing a polarity lexicon from training texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelex.functions import text as T


def concept_windows(docs: DataFrame, anchors: list[str], stopwords: list[str], window: int = 5, key: str = "doc_id") -> DataFrame:
    """key, token: tokens around each anchor. The position counts words between white space, the slice counts word
    tokens; overlapping windows repeat tokens. Stopwords and tokens of two characters or fewer are left out."""
    return windows_grid(docs, anchors, stopwords, [window], key).drop("window")


def _around(docs: DataFrame, anchors: list[str], key: str, taken) -> DataFrame:
    """key and, in a row each, what `taken` (from the tokens and a place) gives for every anchor's place. Anchors that are
    single words can't overlap, and are found in one pass."""
    low = docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("single", T.collapsed(F.col("low")))
    alone = all(re.fullmatch(r"\w+", a) for a in anchors)
    patterns = [rf"(?U)\b(?:{'|'.join(anchors)})\b"] if alone and anchors else [T.long_pattern(a) for a in anchors]
    at = F.concat(*[T.mention_positions(F.col("single"), p, True) for p in patterns])
    low = low.select(key, F.regexp_extract_all("low", F.lit(r"(?U)\b\w+\b"), 0).alias("tokens"), at.alias("at"))
    return low.select(key, F.explode(F.flatten(F.transform("at", lambda a: taken(F.col("tokens"), a)))).alias("x")).select(key, "x.*")


def _slice(tokens, at, w):
    first = F.greatest(at - w, F.lit(0))
    return first, F.slice(tokens, first + 1, at + w + 1 - first)


def _kept(token, stopwords: list[str]):
    return (F.length(token) > 2) & ~F.col(token).isin(*stopwords)


def windows_grid(docs: DataFrame, anchors: list[str], stopwords: list[str], windows: list[int], key: str = "doc_id") -> DataFrame:
    """window, key, token: the same for each of several window sizes, in one scan."""

    def taken(tokens, at):
        of = lambda w: F.transform(_slice(tokens, at, w)[1], lambda t: F.struct(F.lit(w).alias("window"), t.alias("token")))
        return F.concat(*[of(w) for w in windows])

    return _around(docs, anchors, key, taken).where(_kept("token", stopwords)).select("window", key, "token")


def window_counts(docs: DataFrame, anchors: list[str], stopwords: list[str], windows: list[int], key: str = "doc_id") -> DataFrame:
    """window, term, freq: how often each token stands in a window of each size. Only the widest windows are taken apart;
    tokens are counted by their distance from the anchor, and a window's count is the sum over the distances within."""

    def taken(tokens, at):
        first, near = _slice(tokens, at, max(windows))
        return F.transform(near, lambda t, i: F.struct(t.alias("term"), F.abs(first + i - at).alias("off")))

    each = _around(docs, anchors, key, taken).where(_kept("term", stopwords))
    sums = [F.count_if(F.col("off") <= w).alias(f"w{w}") for w in windows]
    per = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"w{w}").alias("freq")) for w in windows])
    return each.groupBy("term").agg(*sums).select("term", F.explode(per).alias("x")).select("x.window", "term", "x.freq").where("freq > 0")


def leaked(induced_on: DataFrame, split: DataFrame) -> DataFrame:
    """split, n: ids of the induction set that are not in the training split, and ids in no split at all (split null)."""
    out = induced_on.select("id").distinct().join(split.select("id", "split"), "id", "left")
    return out.where("split is null or split <> 'train'").groupBy("split").agg(F.count("*").alias("n"))


def induce_lexicon(windows: DataFrame, valence: DataFrame, least: int = 3, strong: float = 1.0, clamp: float = 2.0) -> DataFrame:
    """term, freq, valence, weight, polarity of the frequent terms with a strong valence. valence: a small table."""
    counts = windows.groupBy(F.col("token").alias("term")).agg(F.count("*").alias("freq"))
    kept = counts.where(F.col("freq") >= least).join(valence, "term").where(F.abs("valence") >= strong)
    weight = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col("valence")))
    return kept.select("term", "freq", "valence", weight.alias("weight"), F.when(F.col("valence") > 0, "positive").otherwise("negative").alias("polarity"))


def lexicon_stats(windows: DataFrame, lexicon: DataFrame) -> DataFrame:
    tokens = windows.agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("vocabulary"))
    n = lambda s: F.count_if(F.col("polarity") == s).alias(s)
    sides = lexicon.agg(F.count("*").alias("kept"), n("positive"), n("negative"))
    return tokens.join(sides, F.lit(True)).withColumn("status", F.when((F.col("positive") > 0) & (F.col("negative") > 0), "valid").otherwise("invalid"))
