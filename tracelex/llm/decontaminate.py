"""Operator 9: benchmark decontamination, in DataFrame functions only.

Every window of `n` consecutive item words (a shorter item is one window) goes into a hash set: a bit map of 16 bits or
more for each counted window, 2**27 (16 MB) at most, an array literal in the plan. A document row tests all its word
windows against that map, without leaving the row; only windows whose bit is set are exploded, as words, and joined with
the item windows by equality of the words, so a hash collision never counts. The join broadcasts the windows if their
measured bytes are below `broadcast_bytes`, and is a shuffle join beyond. What is shuffled after it is one narrow row for
each document and each suspected window.

Cases: a null or empty text has no words and is clean; an item without words has no window; null item ids make hits
but are not listed; repeated rows are judged one by one; other columns of either table are ignored by `scan` and
carried through by `remove`, whatever their names; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.llm.common import ascii_lower, staged, unused

#: What separates words; words are runs of the ASCII digits, a-z and everything beyond ASCII.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the map for each window, and of the whole map at least and at most; beyond, more windows are suspects.
WINDOW_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Bytes of contaminated documents' ids that are broadcast, at most; beyond, documents are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _window(h: Column, at: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(h, at, length))


def _starts(size: Column, length: Column) -> Column:
    return F.when(size >= length, F.sequence(F.lit(1), size - length + 1)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """len, key (the words), hash, items: one row for each distinct window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", _hashes(F.col("w")).alias("h"), F.least(F.size("w"), F.lit(n)).alias("len"))
    made = F.transform(
        _starts(F.size("w"), F.col("len")),
        lambda i: F.struct(
            F.array_join(F.slice("w", i, F.col("len")), " ").alias("key"), _window(F.col("h"), i, F.col("len")).alias("hash")
        ),
    )
    rows = w.select("item_id", "len", F.explode(made).alias("x")).select("item_id", "len", "x.key", "x.hash")
    return rows.groupBy("len", "key", "hash").agg(F.collect_set("item_id").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, hits (merged word spans, 0-based,
    end exclusive): one row for each row of docs."""
    spark = docs.sparkSession
    found = staged(benchmark_windows(benchmark, n))
    about = found.agg(F.count("*").alias("n"), F.collect_set("len").alias("lengths"), F.sum(F.length("key") + 8 * F.size("items") + 64).alias("size")).first()
    lengths, size = about.lengths, about["size"] or 0
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (WINDOW_BITS * about.n).bit_length()))
    slot = F.pmod("hash", F.lit(n_bits))
    bits = found.groupBy((slot / 64).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("b")
    )
    filled = spark.range(n_bits // 64).select(F.col("id").cast("int").alias("at")).join(bits, "at", "left")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    # The bit map's text, MOST_BITS at most, which Spark folds to one array literal.
    bitmap = F.split(F.lit(filled.agg(F.array_join(F.transform(ordered, lambda x: x.b.cast("string")), ",")).first()[0]), ",").cast("array<bigint>")
    w = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    w = w.select("*", F.size("w").alias("n_words"), _hashes(F.col("w")).alias("h"))

    def hit(i: Column, length: Column) -> Column:
        slot = F.pmod(_window(F.col("h"), i, length), F.lit(n_bits))
        word = F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int"))
        return F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    def suspects(length: Column) -> Column:
        starts = F.filter(_starts(F.col("n_words"), length), lambda i: hit(i, length))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("at"), length.alias("len"), F.array_join(F.slice("w", i, length), " ").alias("key")))

    w = w.select("doc_id", "row", "n_words", F.flatten(F.array(*[suspects(F.lit(x)) for x in sorted(lengths) or [n]])).alias("s"))
    # A document without suspects gets a key of its own, which no window has: a null key would gather them all.
    rows = w.select("doc_id", "row", "n_words", F.explode_outer("s").alias("s")).select(
        "doc_id", "row", "n_words", "s.at", F.coalesce("s.len", F.lit(0)).alias("len"),
        F.coalesce("s.key", F.concat(F.lit("#"), F.col("row").cast("string"))).alias("key"),
    )
    known = found.select("len", "key", "items")
    rows = rows.join(F.broadcast(known) if size <= broadcast_bytes else known, ["len", "key"], "left")
    per = rows.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("len")).alias("end"))))).alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", start,
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s["at"], a.end))).alias("n"), F.greatest(a.end, s.end).alias("end")),
        lambda a: a.n,
    )
    return per.select(
        "doc_id", F.col("n_words").cast("long"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", (F.size("spans") > 0).alias("contaminated"), F.col("spans").alias("hits"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, what: str = "documents") -> DataFrame:
    """docs without what the benchmark contaminates: whole documents, or (what="spans") only the hit words, each
    replaced by nothing, with the separators kept. Null ids match null ids. Rows that share a doc_id share its fate;
    for spans doc_id has to be a key."""
    bad = scan(docs.select("doc_id", "text"), benchmark, n).where("contaminated").withColumnsRenamed({"doc_id": "_id"})
    if what == "documents":
        ids = staged(bad.select("_id").distinct())
        ids = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_anti")
    hits, own = unused(docs, "hits"), unused(docs, "id")
    bad = bad.select(F.col("_id").alias(own), F.col("hits").alias(hits))
    out = docs.join(bad, docs["doc_id"].eqNullSafe(bad[own]), "left")
    # Pieces alternate between words and separators; the words are numbered in order.
    pieces = F.split(F.col("text"), r"(?<=[0-9A-Za-z\x{80}-\x{10FFFF}])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])|(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[0-9A-Za-z\x{80}-\x{10FFFF}])")
    first = F.when(F.col("text").rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)
    number = lambda i: F.when((i - first) % 2 == 0, ((i - first) / 2).cast("int")).otherwise(-1)
    kept = F.filter(pieces, lambda p, i: ~F.exists(hits, lambda s: (number(i) >= s["at"]) & (number(i) < s.end)))
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return out.withColumn("text", text).select(docs.columns)


def op9_decontaminate(spark, sf_dir):
    from tracelex.llm.common import table

    r = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bi)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS k FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw USING (l, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
