"""Text expressions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tracelex.functions import text as T
from tracelex.operators import dictionary, enrich

# Each boundary rule of short terms: ends of the text, space, hyphen, brackets, quotes, punctuation; and what is none:
# letters on a side, a slash, an at sign, a digit.
HITS = ["ai", "Kitchens without AI", "pre-AI, post-ai", "[ai]{AI}(Ai)", "say 'ai' or \"AI\"", "ai;ai:ai!ai?ai.", "`ai`\tai\nai"]
COUNTS = [1, 1, 2, 3, 2, 5, 3]
MISSES = ["a rainy Thursday", "paid the bail", "ai2 and 2ai", "x/ai/y", "who@ai", "Hawaii", "a i"]


def test_short_and_long_terms(spark):
    df = spark.createDataFrame([(t,) for t in HITS + MISSES], "text string")
    got = [r.n for r in df.select(T.short_hits(F.lower("text"), "ai").alias("n")).collect()]
    assert got == COUNTS + [0] * len(MISSES)
    df = spark.createDataFrame([("a nation ètion tion.",), ("ètion",), ("the tion",)], "text string")
    assert [r.n for r in df.select(T.long_hit(F.lower("text"), "tion").alias("n")).collect()] == [True, False, True]


@pytest.mark.parametrize("text", ["", "x", "`code` and text", "a ```long\ncode``` b", "plain", "` unclosed"])
def test_code_blocks(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(T.clean_code_blocks(F.col("text")).alias("t")).first().t
    assert got == re.sub(r"`[^`]+`|```[\s\S]+?```", " ", text)


TEXTS = ["that thing and that", "with that, thing that", "that", " that  that\nthat", "no match", "a b c d e f g that h i j k l m n", "thatthat that-that", "ai ai (ai) and ai", "ai"]


@pytest.mark.parametrize("term", ["that", "thing", "ai"])
def test_mention_positions(spark, term):
    def plain(text):
        b = r"[\s\-\(\)\[\]\{\}\.,;:!\?\"'`]"
        pattern = rf"(?:^|{b}){term}(?={b}|$)" if len(term) < 4 else rf"\b{term}\b"
        return [max(0, len(text[: m.start()].split()) - 1) for m in re.finditer(pattern, text)]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r.i: r.at for r in df.select("i", T.mention_positions(F.col("text"), T.term_pattern(term)).alias("at")).collect()}
    assert [sorted(got[i]) for i in range(len(TEXTS))] == [sorted(plain(" ".join(t.split()))) for t in TEXTS]


def test_window_polarity(spark, monkeypatch):
    """By the hash table, and by the join for lexicons beyond its size."""
    lexicon = spark.createDataFrame([("good", 1.5), ("bad", -1.0), ("bad", -2.0), (None, 9.0), ("none", None)], "term string, valence double")
    df = spark.createDataFrame([("w1 w2 good, w4 w5 hit bad! w8 w9 w10 w11 good",), ("",), ("good",)], "text string").select(F.col("text").alias("single"), T.words(F.col("text")).alias("words"))
    for most in (dictionary.MOST, 2):
        monkeypatch.setattr(dictionary, "MOST", most)
        at = F.least(F.lit(5), F.greatest(F.size("words") - 1, F.lit(0)))
        polarity = dictionary.windowed(F.col("values"), at)
        rows = dictionary.valences(df, lexicon).select("words", T.mention_window(F.col("words"), at).alias("w"), polarity.alias("p"), T.mention_class(polarity).alias("k")).collect()
        rows = {len(r.words): r for r in rows}
        assert rows[12].w == rows[12].words[:11] and (rows[12].p, rows[12].k) == (0.5, "neutral")
        assert (rows[1].p, rows[1].k) == (1.5, "positive") and (rows[0].p, rows[0].k) == (0.0, "neutral")


WILD = ["node.js and c++ code", "C++, c--", "a naïve café; e\u0301te", "#tag x#tag (#tag) tag#", "end of the line.", "over-the-top the top", "日本 語 日本語", "x_y x y", "ai AI-ai (ai) .ai. ai2", "well known  well known", "", None, "who's who"]
WILD_TERMS = ["node.js", "c++", "c++ code", "naïve", "café", "ete", "e\u0301te", "#tag", "tag#", "line.", "the top", "over-the-top", "日本", "日本語", "x_y", "x y", "ai", "well known", "who's", "who", "top", "x#tag", " the "]


def plain_hits(text, term):
    low = re.sub(r"`[^`]+`|```[\s\S]+?```", " ", text or "").lower()
    return sum(x == term for x in re.split(T.BOUNDARY, low))


def test_terms_by_table_are_the_patterns(spark):
    """Words with other characters inside, at either end, combining marks, and compounds."""
    terms = spark.createDataFrame([("C" if i % 2 else "D", t, i) for i, t in enumerate(WILD_TERMS)] + [("C", "", 99)], "concept string, term string, term_pos int")
    compounds = spark.createDataFrame([("C", "own  w"), ("C", "++"), ("D", "absent")], "concept string, compound string")
    docs = spark.createDataFrame(list(enumerate(WILD)), "doc_id int, text string").withColumn("term", F.lit("x")).withColumn("toks", F.lit(1))
    rows = dictionary.term_matches(docs, terms, compounds).collect()
    long = [t for t in WILD_TERMS if len(t) >= T.LONG_FROM]  # the patterns themselves, run by the engine that runs them elsewhere
    low = F.lower(T.clean_code_blocks(F.col("text")))
    found = {r.doc_id: dict(zip(long, r[1:], strict=True)) for r in docs.select("doc_id", *[T.long_hit(low, t).alias(f"h{k}") for k, t in enumerate(long)]).collect()}
    got = {(r.doc_id, r.term): (r.hits, r.score) for r in rows}
    want = {}
    for i, text in enumerate(WILD):
        for k, t in enumerate(WILD_TERMS):
            bonus = sum(0.5 for x in ("own  w", "++") if k % 2 and x in (text or "").lower())
            n = int(found[i][t]) if t in long else plain_hits(text, t)
            if n + bonus:
                want[i, t] = (n, n + bonus)
    # A concept's bonus falls to its rows whatever their term, the empty one included.
    assert {k: v for k, v in got.items() if k[1]} == want


def test_vocabulary_of_a_hundred_thousand_terms(spark):
    """Plans are as long as for one term, and every planted term is found."""
    def plan(n):
        terms = spark.range(n).select(F.lit("C").alias("concept"), F.concat(F.lit("term"), F.col("id")).alias("term"), F.col("id").cast("int").alias("term_pos"))
        docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a term"), F.col("id") * 499, F.lit(", more")).alias("text"))
        found = dictionary.term_matches(docs, terms)
        return found, len(found._jdf.queryExecution().optimizedPlan().toString())

    (many, size), (_, less) = plan(100_000), plan(10)
    assert abs(size - less) < 100 and sorted(r.term for r in many.collect()) == sorted(f"term{i * 499}" for i in range(200))


def test_mentions_by_table_are_those_by_columns(spark):
    vocabulary = [("A", "ai", 0), ("A", "thing", 1), ("B", "that", 2), ("B", "c+d", 3)]
    compounds = {"A": ["that thing"], "B": []}
    docs = spark.createDataFrame(list(enumerate([*TEXTS, "good thing, AI that bad thing is (ai) ai", None, "c+d then c+d"])), "doc_id int, text string")
    lexicon = spark.createDataFrame([("good", 1.5), ("bad", -1.0)], "term string, valence double")
    one = enrich.mentions(docs, vocabulary, compounds, lexicon)
    terms, more = spark.createDataFrame(vocabulary, "concept string, term string, term_pos int"), spark.createDataFrame([("A", "that thing")], "concept string, compound string")
    two = enrich.mentions_by_table(docs, terms, more, lexicon)
    rows = lambda df: sorted(map(str, df.select("doc_id", "concept", "at", "window", "polarity", "kind").collect()))
    assert rows(one) == rows(two) and len(rows(one)) > 20


def test_windows_are_looked_up_near_mentions_only(spark, monkeypatch):
    """The same mentions with a lexicon that is looked up in the windows and with one that is joined; no column holds the
    values of all words. Marks, white space and code don't move a place."""
    texts = [None, "", " ", "good thing, not\u0001 thing-bad", "\u0001 a  b\t`thing`\nthing on", "x" * 9 + " bad thing " * 3, "thing", "no such word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lexicon = spark.createDataFrame([("good", 1.5), ("bad", -2.0), ("thingbad", 0.25)], "term string, valence double")
    found = lambda: sorted(map(tuple, enrich.mentions(docs, [("A", "thing", 0), ("A", "no", 1), ("B", "bad", 2)], {"A": ["thing on"]}, lexicon).collect()))
    rows, _ = enrich.in_row(docs, [("A", "thing", 0)], {}, lexicon)
    assert "values" not in rows.columns
    assert [r.n for r in rows.orderBy("doc_id").select(T.spaced_count(F.col("spaced")).alias("n")).collect()] == [len((t or "").replace("`thing`", " ").split()) for t in texts]
    near = found()
    monkeypatch.setattr(dictionary, "MOST", 0)
    assert near and near == found()


def test_matches_by_text_and_of_short_terms(spark, monkeypatch, capsys):
    """The same rows; parts grow with the texts, one shuffle serves all sums by text; short terms need no tokens."""
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate((HITS + MISSES) * 4)], "doc_id int, text string")
    terms = spark.createDataFrame([("A", "ai", 0), ("B", "ai", 1), ("A", "kitchens", 2), ("B", "post-ai", 3)], "concept string, term string, term_pos int")
    compounds = spark.createDataFrame([("A", "rain")], "concept string, compound string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = dictionary.term_matches(docs, terms, compounds)
    monkeypatch.setattr(dictionary, "TEXTS", 5)
    dealt = dictionary.term_matches(docs, terms, compounds, by_text=True)
    assert rows(dealt) == rows(plain) and dealt.rdd.getNumPartitions() == -(-docs.count() // 5)
    enrich.concept_scores(dealt).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(doc_id") == 1
    short = dictionary.term_matches(docs, terms, short_only=True)
    assert rows(short) == rows(dictionary.term_matches(docs, terms).where("length(term) < 4"))
    short.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out
