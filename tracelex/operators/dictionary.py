"""Dictionaries as tables: vocabularies and lexicons of any size, in plans that don't grow with them.

Terms are matched by a join on token n-grams: a text is cut into words and single other characters; where a token is the
first of some terms, the n-grams of those terms' numbers of tokens meet the terms by hash. Spark broadcasts the terms while
they are below its threshold and shuffles both sides beyond. First tokens, and the words of a lexicon, are looked up in the
row: one aggregation makes them a hash table (an array of small maps), which a scalar subquery hands to every task, so
that time doesn't grow with the entries. Beyond MOST entries all n-grams go to the join, and a lexicon is joined too.

Cases: null texts are empty; rows that share a key are one text; a term that repeats within a concept counts once for each
row; empty terms never match; empty tables give empty results; columns beside the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.functions import text as T

#: Buckets of a hash table, and entries up to which a dictionary is one (some 40 MB).
BUCKETS, MOST = 1 << 13, 500_000

#: Texts whose matches are added up in one part.
TEXTS = 20_000

#: Stands before or after a gram whose outer character has no word boundary beside it, and before a concept.
NO_EDGE = "\u0002"


def tokens(lower: Column) -> Column:
    """Words and, one by one, all other characters."""
    return F.regexp_extract_all(lower, F.lit(r"(?Us)\w+|."), F.lit(0))


def gram(toks: Column, i: Column, k: Column) -> Column:
    """The run of k tokens from the i-th on. One that begins or ends with a character which isn't of a word matches only
    beside one that is, as a word boundary there demands."""
    is_word = lambda at: F.coalesce((F.length(F.get(toks, at)) > 1) | F.regexp_like(F.get(toks, at), F.lit(r"(?U)^\w")), F.lit(False))
    last = i + k - 1
    before = F.when(is_word(i) | is_word(i - 1), "").otherwise(NO_EDGE)
    after = F.when(is_word(last) | is_word(last + 1), "").otherwise(NO_EDGE)
    return F.concat(before, F.when(k == 1, F.get(toks, i)).otherwise(F.array_join(F.slice(toks, i + 1, k), "")), after)


def grams(toks: Column, lengths: Callable[[Column], Column]) -> Column:
    """All runs of tokens that a long term can be. lengths: from a first token to the numbers of tokens of its terms."""
    at = F.transform(toks, lambda t, i: F.transform(lengths(t), lambda k: F.struct(i.alias("i"), k.alias("k"))))
    within = F.filter(F.flatten(at), lambda x: x["i"] + x["k"] <= F.size(toks))
    return F.array_distinct(F.transform(within, lambda x: gram(toks, x["i"], x["k"])))


def term_matches(docs: DataFrame, terms: DataFrame, compounds: DataFrame | None = None, key: str = "doc_id", short_only: bool = False, by_text: bool = False) -> DataFrame:
    """key, concept, term, term_pos, hits, score: one row for each scoring term of each text. hits: how often a short term
    stands between boundary characters, or 1 for a longer one that stands as whole words. Every compound that the text
    contains adds 0.5 to all terms of its concept. terms: concept, term, term_pos; compounds: concept, compound, a
    dictionary of at most some hundred. short_only: the rows of short terms alone; texts aren't cut into tokens then.
    by_text: matches are dealt by text into parts of some TEXTS texts, so that what a task adds up doesn't grow with the
    table and aggregations by text need no further shuffle; for vocabularies of which a text repeats few terms."""
    short = F.length("term") < T.LONG_FROM
    named = terms.select("concept", "term", "term_pos")
    if short_only:
        named = named.where(short)
    keyed = named.where(F.length("term") > 0).select(F.when(short, "s").otherwise("l").alias("kind"), F.col("term").alias("gram"), F.lit(1.0).alias("weight"), "concept", "term", "term_pos")
    low = docs.select(F.col(key), F.lower(T.clean_code_blocks(F.col("text"))).alias("low"))
    toks = low if short_only else low.select(key, "low", tokens(F.col("low")).alias("toks"))
    none = F.array().cast("array<int>")
    firsts = named.where(~short).select(tokens(F.col("term")).alias("t")).select(F.get("t", F.lit(0)).alias("first"), F.size("t").alias("k"))
    heads = None if short_only else hash_table(firsts.groupBy("first").agg(F.array_sort(F.collect_set("k")).alias("k")), "first", "k")
    if short_only:
        long_keys = F.array().cast("array<string>")
    elif heads is None:
        toks = toks.withColumn("heads", firsts.select(F.array_sort(F.collect_set("k"))).scalar())
        long_keys = grams(F.col("toks"), lambda t: F.coalesce("heads", none))
    else:
        toks = toks.withColumn("heads", heads)
        long_keys = grams(F.col("toks"), lambda t: F.coalesce(looked_up(F.col("heads"), t), none))
    short_keys = F.filter(T.boundary_split(F.col("low")), lambda p: (F.length(p) > 0) & (F.length(p) < T.LONG_FROM))
    kinds: list[tuple[str, Column]] = [("s", short_keys)] if short_only else [("l", long_keys), ("s", short_keys)]
    if compounds is not None:
        keyed = keyed.union(named.select(F.lit("c"), "concept", F.lit(0.5), "concept", "term", "term_pos"))
        listed = compounds.select(F.collect_list(F.struct("concept", "compound")).alias("c")).scalar()
        toks = toks.withColumn("compounds", listed)
        found = F.filter("compounds", lambda c: F.contains(F.col("low"), c["compound"]))
        kinds.append(("c", F.transform(found, lambda c: c["concept"])))

    def of_kind(kind: str, own: Column) -> Column:
        return F.transform(own, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))

    every = F.concat(*[of_kind(kind, own) for kind, own in kinds])
    each = toks.select(key, F.explode(every).alias("g")).select(key, "g.kind", "g.gram")
    hit = each.join(keyed, ["kind", "gram"])
    if by_text:
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TEXTS))
        hit = hit.select(key, "concept", "term", "term_pos", "kind", "weight").repartition(parts, key)
    hits = F.sum(F.when(F.col("kind") != "c", F.col("weight")).otherwise(0.0)).alias("hits")
    return hit.groupBy(key, "concept", "term", "term_pos").agg(hits, F.sum("weight").alias("score"))


def hash_table(entries: DataFrame, key: str, value: str) -> Column | None:
    """The entries as an array of maps by hash, a scalar subquery; None where there are more than MOST (a count of at most
    that many rows is run). A repeated key keeps its greatest value."""
    if entries.limit(MOST + 1).count() > MOST:
        return None
    one = entries.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(value).alias("v"))
    buckets = one.groupBy(bucket(F.col("k")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    every = entries.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(F.broadcast(buckets), "b", "left")
    return every.select(F.transform(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"]), lambda x: x["m"]).alias("t")).scalar()


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def looked_up(table: Column, word: Column) -> Column:
    """The word's value, null if it has none."""
    return F.try_element_at(F.get(table, bucket(word)), word)


def bare_words(single: Column) -> Column:
    """The words of a text whose white space is collapsed, without punctuation; what was all punctuation is empty."""
    return F.split(F.regexp_replace(single, r"(?U)[^\w\s]", ""), " ")


def each_looked_up(rows: DataFrame, table: Column, single: str, name: str, missing: Column | None = None) -> DataFrame:
    """Adds an array: the value of each word of a text whose white space is collapsed, punctuation removed. The subquery
    stands in a projection of its own, as it may not stand in a lambda; the optimiser joins the two, so that no row ever
    holds the table."""
    held = "_table"
    value = lambda w: looked_up(F.col(held), w)
    filled = value if missing is None else lambda w: F.coalesce(value(w), missing)
    return rows.withColumn(held, table).withColumn(name, F.transform(bare_words(F.col(single)), filled)).drop(held)


def windows_looked_up(rows: DataFrame, table: Column, places: list[str], name: str, missing: Column | None = None) -> DataFrame:
    """Adds an array of k, at and values: for each place of the k-th of the columns `places`, the values of the words of its
    window, punctuation removed. Only words of windows are looked up. rows: words and the places; as for
    `each_looked_up`, the table is used once."""
    held = "_table"

    def value(w: Column) -> Column:
        found = looked_up(F.col(held), F.regexp_replace(w, r"(?U)[^\w\s]", ""))
        return found if missing is None else F.coalesce(found, missing)

    def of(k: int, column: str) -> Column:
        return F.transform(column, lambda at: F.struct(F.lit(k).alias("k"), at.alias("at")))

    every = F.concat(*[of(k, p) for k, p in enumerate(places)])
    seen = F.transform(every, lambda x: F.struct(x["k"].alias("k"), x["at"].alias("at"), F.transform(T.mention_window(F.col("words"), x["at"]), value).alias("values")))
    return rows.withColumn(held, table).withColumn(name, seen).drop(held)


def valences(rows: DataFrame, lexicon: DataFrame, single: str = "single", name: str = "values") -> DataFrame:
    """Adds an array: the valence of each word of a text whose white space is collapsed, punctuation removed, 0 for words
    without one. lexicon: term, valence."""
    table = hash_table(lexicon, "term", "valence")
    if table is not None:
        return each_looked_up(rows, table, single, name, F.lit(0.0))
    # Too large for a value of the plan: a text's distinct words meet the lexicon, and come back to it as a map.
    row = "_row"
    numbered = rows.withColumn(row, F.xxhash64(single))
    each = numbered.select(row, F.explode(F.array_distinct(bare_words(F.col(single)))).alias("term")).distinct()
    found = each.join(lexicon.groupBy("term").agg(F.max("valence").alias("valence")), "term").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("term", "valence"))).alias("_found"))
    value = lambda w: F.coalesce(F.try_element_at(F.col("_found"), w), F.lit(0.0))
    return numbered.join(found, row, "left").withColumn(name, F.transform(bare_words(F.col(single)), value)).drop(row, "_found")


def windowed(values: Column, at: Column, window: int = T.WINDOW) -> Column:
    """Sum of the values from `window` before to `window` after a place, from left to right. Sums of floats depend on their
    order, so the few values are added as they stand instead of subtracting two prefix sums."""
    return F.aggregate(T.mention_window(values, at, window), F.lit(0.0), lambda a, v: a + v)
