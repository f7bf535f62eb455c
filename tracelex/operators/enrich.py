"""Concept matching and polarity: one row of numeric features for each text, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelex.functions import text as T
from tracelex.operators import dictionary


def vocab_terms(concepts: DataFrame, labels: DataFrame, scheme: str, languages: tuple[str, ...] = ("es", "en")) -> DataFrame:
    """concept, term: lower-cased preferred labels (in the languages) and alternative labels of a scheme's concepts."""
    own = concepts.where(F.col("scheme") == scheme).select("concept")
    said = labels.where((F.col("kind") == "altLabel") | F.col("lang").isin(*languages)).join(own, "concept")
    return said.select("concept", F.lower("label").alias("term")).dropDuplicates(["concept", "term"])


def compound_bonus(lower: Column, compounds: list[str]) -> Column:
    """0.5 for each compound that the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(lower, F.lit(c)).cast("double") * 0.5 for c in compounds], F.lit(0.0))


def concept_scores(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    return scores.groupBy(key, "concept").agg(F.sum("score").alias("score"))


def concept_winner(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """The last scoring term of each concept, in vocabulary order."""
    return scores.groupBy(key, "concept").agg(F.max_by("term", "term_pos").alias("term"))


def top_concepts(concepts: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """The n best concepts of each text: score, then longer name, then name."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(F.length("concept")), "concept")
    return concepts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def only(parts: Column, terms: list[str]) -> Column:
    """The parts that are one of some terms, in one pass; what counts single terms then has few to look at."""
    return F.filter(parts, lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")


def in_row(docs: DataFrame, vocabulary: list[tuple], compounds: dict[str, list[str]], lexicon: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Scores, winners and mentions of every concept, found in the row of the text: one scan, no shuffle. Returns the
    rows (key, keep, clean, low, parts, spaced, single, shorts, words, and three columns for each concept), and for each concept the
    names of two: score, and an array of (at, window, polarity) for the mentions of the last scoring term and of the
    compounds. The k-th concept's column at{k} has the places alone. Words of windows are looked up in the lexicon (term, valence), and windows add the values. The vocabulary is that
    of the feature columns; `dictionary.term_matches` takes one of any size. Null texts are empty."""
    concepts = list(dict.fromkeys(c for c, _, _ in vocabulary))
    base = docs.select(key, *keep, T.clean_code_blocks(F.col("text")).alias("clean")).withColumn("low", F.lower("clean"))
    # Texts that hold the mark, which is rare, are spaced again without it.
    base = base.withColumns({"parts": T.boundary_split(F.col("low")), "spaced": T.spaced(F.col("low"))})
    base = base.withColumn("single", F.when(F.contains("spaced", F.lit(T.MARK)), T.collapsed(F.col("spaced"))).otherwise(F.col("spaced")))
    terms = sorted(enumerate(vocabulary), key=lambda v: v[1][2])
    base = base.withColumn("shorts", only(F.col("parts"), [t for _, t, _ in vocabulary if len(t) < T.LONG_FROM]))
    hits = {f"h{i}": T.short_count(F.col("shorts"), t).cast("double") if len(t) < T.LONG_FROM else T.long_hit(F.col("low"), t).cast("double") for i, (_, t, _) in terms}
    bonus = {f"b{k}": compound_bonus(F.col("low"), compounds.get(c, [])) for k, c in enumerate(concepts)}
    base = base.withColumns(hits | bonus | {"words": F.when(F.col("single") == "", F.array().cast("array<string>")).otherwise(F.split("single", " "))})
    found, names = {}, {}
    for k, c in enumerate(concepts):
        own = [(i, t) for i, (concept, t, _) in terms if concept == c]
        found[f"s{k}"] = reduce(lambda x, y: x + y, [F.col(f"h{i}") for i, _ in own]) + F.col(f"b{k}") * len(own)
        others = [(x, T.long_pattern(x)) for x in compounds.get(c, [])]
        at = F.array().cast("array<int>")
        for i, t in own:  # the last scoring term in vocabulary order supplies the mentions
            places = F.concat(*[T.term_positions(F.col("single"), x, p) for x, p in ((t, T.term_pattern(t)), *others)])
            at = F.when(F.col(f"h{i}") + F.col(f"b{k}") > 0, places).otherwise(at)
        found[f"at{k}"] = at
        names[c] = (f"s{k}", f"m{k}")
    base, window = base.withColumns(found), lambda at: T.mention_window(F.col("words"), at)
    table = dictionary.hash_table(lexicon, "term", "valence")
    if table is None:
        base = dictionary.valences(base, lexicon)
        seen = {f"m{k}": F.transform(f"at{k}", lambda at: F.struct(at.alias("at"), window(at).alias("window"), dictionary.windowed(F.col("values"), at).alias("polarity"))) for k in range(len(concepts))}
        return base.withColumns(seen), names
    base = dictionary.windows_looked_up(base, table, [f"at{k}" for k in range(len(concepts))], "seen", F.lit(0.0))

    def of(k: int) -> Column:
        total = lambda x: F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v)
        return F.transform(F.filter("seen", lambda x: x["k"] == k), lambda x: F.struct(x["at"].alias("at"), window(x["at"]).alias("window"), total(x).alias("polarity")))

    return base.withColumns({f"m{k}": of(k) for k in range(len(concepts))}), names


def mentions(docs: DataFrame, vocabulary: list[tuple], compounds: dict[str, list[str]], lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, concept, at, window, polarity, kind: the mentions of each concept's winning term and of the compounds found."""
    rows, names = in_row(docs, vocabulary, compounds, lexicon, key)

    def named(c: str, m: str) -> Column:
        return F.transform(m, lambda x: F.struct(F.lit(c).alias("concept"), *[x[n].alias(n) for n in ("at", "window", "polarity")]))

    every = F.concat(*[named(c, m) for c, (_, m) in names.items()])
    return rows.select(key, F.explode(every).alias("x")).select(key, "x.*").withColumn("kind", T.mention_class(F.col("polarity")))


def mentions_by_table(docs: DataFrame, terms: DataFrame, compounds: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same rows for vocabularies of any size, given as tables (terms: concept, term, term_pos; compounds: concept,
    compound): texts meet the winning terms and the compounds found in a join, and each pair's pattern is a column."""
    scores = dictionary.term_matches(docs, terms, compounds, key)
    won = concept_winner(scores, key)
    texts = docs.select(key, T.collapsed(F.lower(T.clean_code_blocks(F.col("text")))).alias("single"))
    texts = dictionary.valences(texts, lexicon).withColumn("words", F.filter(F.split("single", " "), lambda w: w != ""))
    winners = won.select(key, "concept", T.term_pattern_of(F.col("term")).alias("pattern"))
    others = won.join(compounds, "concept").select(key, "concept", T.long_pattern_of(F.col("compound")).alias("pattern"))
    found = texts.join(winners.union(others), key).select(key, "concept", "words", "values", T.mention_positions_of(F.col("single"), F.col("pattern")).alias("places"))
    seen = F.transform("places", lambda at: F.struct(at.alias("at"), T.mention_window(F.col("words"), at).alias("window"), dictionary.windowed(F.col("values"), at).alias("polarity")))
    return found.select(key, "concept", F.explode(seen).alias("x")).select(key, "concept", "x.*").withColumn("kind", T.mention_class(F.col("polarity")))


def polarity_ratio(total: Column, n: Column) -> Column:
    """Half the mean of the classified windows' polarities, within [-1, 1]; 0 without mentions."""
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.greatest(n, F.lit(1)) / 2))).otherwise(0.0)


def concept_polarity(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of each kind, sums over positive and over negative windows, and the ratio, per text and concept."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("polarity")).otherwise(0.0)).alias(f"{k}_score")
    out = found.groupBy(key, "concept").agg(n("positive"), n("negative"), n("neutral"), total("positive"), total("negative"), F.count("*").alias("mentions"))
    return out.withColumn("ratio", polarity_ratio(F.col("positive_score") + F.col("negative_score"), F.col("mentions"))).drop("mentions")


def modifier_flags(docs: DataFrame, modifiers: dict[str, list[str]], factors: dict[str, float], most: int = 10, key: str = "doc_id") -> DataFrame:
    """A flag per type, the number of matching patterns and the product of their factors."""
    low = docs.select(key, F.lower(T.clean_code_blocks(F.col("text"))).alias("low"))
    hits = {k: [T.short_hits(F.col("low"), p) > 0 for p in ps] for k, ps in modifiers.items()}
    flags = [F.coalesce(reduce(lambda a, b: a | b, h), F.lit(False)).cast("int").alias(k) for k, h in hits.items()]
    n = F.least(F.lit(most), reduce(lambda a, b: a + b, [x.cast("int") for h in hits.values() for x in h]))
    factor = reduce(lambda a, b: a * b, [F.when(x, F.lit(factors[k])).otherwise(F.lit(1.0)) for k, h in hits.items() for x in h])
    return low.select(key, *flags, n.alias("n_patterns"), factor.alias("factor"))


def emotion_weights(docs: DataFrame, emotions: dict[str, dict[str, float]], key: str = "doc_id") -> DataFrame:
    """Per emotion, all hits of its patterns times their weights."""
    low = docs.select(key, F.lower(T.clean_code_blocks(F.col("text"))).alias("low"))
    return low.select(key, *[reduce(lambda a, b: a + b, [T.short_hits(F.col("low"), p) * F.lit(w) for p, w in ps.items()]).alias(e) for e, ps in emotions.items()])


def concept_features(docs: DataFrame, vocabulary: list[tuple], compounds: dict[str, list[str]], concepts: list[str], key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each text: a score for each concept, how many matched, and their density per word. One pass: what a
    text needs is in its own row, so nothing is exploded or shuffled. keep: further columns of docs."""
    base = docs.select(key, *keep, T.clean_code_blocks(F.col("text")).alias("clean"))
    base = base.select(key, *keep, "clean", F.lower("clean").alias("low")).withColumn("parts", T.boundary_split(F.col("low")))
    out = []
    for c in concepts:
        terms = [t for k, t, _ in vocabulary if k == c]
        hits = reduce(lambda a, b: a + b, [T.short_count(F.col("parts"), t).cast("double") if len(t) < T.LONG_FROM else T.long_hit(F.col("low"), t).cast("double") for t in terms])
        out.append((hits + compound_bonus(F.col("low"), compounds.get(c, [])) * len(terms)).alias(f"ont_{c.lower()}"))
    wide = base.select(key, *keep, T.word_count(F.col("clean")).alias("n_words"), *out)
    n = reduce(lambda a, b: a + b, [(F.col(f"ont_{c.lower()}") > 0).cast("double") for c in concepts])
    wide = wide.withColumn("ont_count", n)
    return wide.withColumn("ont_density", F.col("ont_count") / F.greatest(F.col("n_words"), F.lit(1)))


def feature_vector(
    docs: DataFrame, vocabulary: list[tuple], compounds: dict[str, list[str]], lexicon: DataFrame, modifiers: dict[str, list[str]], factors: dict[str, float],
    emotions: dict[str, dict[str, float]], valence: dict[str, int], key: str = "doc_id",
) -> DataFrame:
    """key, n_words and all features of a text, in one scan without a shuffle.

    For each concept: found, score, positive, negative and neutral mentions, ratio. A flag and the product of factors for
    modifiers; a flag and a weight for each emotion; counts and densities per word of the three; totals and the ratio of
    mentions over all concepts; and what derives from these (`derived`). valence: 1 or -1 for each emotion."""
    rows, names = in_row(docs, vocabulary, compounds, lexicon, key)
    kind = lambda m, k: F.size(F.filter(m, lambda x: T.mention_class(x["polarity"]) == k)).cast("double")
    strong = lambda m: F.aggregate(m, F.lit(0.0), lambda a, x: a + F.when(F.abs(x["polarity"]) > 0.5, x["polarity"]).otherwise(0.0))
    cols: dict[str, Column] = {}
    for c, (score, m) in names.items():
        c = c.lower()
        cols |= {f"ont_{c}": (F.col(score) > 0).cast("double"), f"ont_{c}_score": F.col(score)}
        cols |= {f"ont_{c}_{k}": kind(m, k) for k in ("positive", "negative", "neutral")} | {f"ont_{c}_ratio": polarity_ratio(strong(m), F.size(m))}
    patterns = list(dict.fromkeys(p for ps in (*modifiers.values(), *emotions.values()) for p in ps))
    rows = rows.withColumn("said", only(F.col("parts"), patterns))
    rows = rows.withColumns({f"p{i}": T.short_count(F.col("said"), p) for i, p in enumerate(patterns)})
    hit = {p: F.col(f"p{i}") for i, p in enumerate(patterns)}
    for k, ps in modifiers.items():
        cols[f"ont_mod_{k}"] = F.greatest(F.lit(0), *[(hit[p] > 0).cast("int") for p in ps]).cast("double")
    cols["ont_count_modifiers"] = reduce(lambda a, b: a + b, [(hit[p] > 0).cast("double") for ps in modifiers.values() for p in ps])
    cols["ont_modifier_factor"] = reduce(lambda a, b: a * b, [F.when(hit[p] > 0, F.lit(factors[k])).otherwise(F.lit(1.0)) for k, ps in modifiers.items() for p in ps])
    for e, ps in emotions.items():
        cols[f"ont_weight_{e}"] = reduce(lambda a, b: a + b, [hit[p] * F.lit(w) for p, w in ps.items()])
    wide = rows.select(key, T.spaced_count(F.col("spaced")).cast("long").alias("n_words"), *[v.alias(k) for k, v in cols.items()])
    return derived(wide, [c.lower() for c in names], list(emotions), valence)


def derived(rows: DataFrame, concepts: list[str], emotions: list[str], valence: dict[str, int]) -> DataFrame:
    """Adds flags, counts, densities, totals and composites to the features of concepts, modifiers and emotions."""
    total = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    rows = rows.withColumns({f"ont_emo_{e}": (F.col(f"ont_weight_{e}") > 0).cast("double") for e in emotions})
    rows = rows.withColumns({
        "ont_count_concepts": total([f"ont_{c}" for c in concepts]), "ont_count_emotions": total([f"ont_emo_{e}" for e in emotions]),
        "ont_domain_score": total([f"ont_{c}_score" for c in concepts]), "ont_emotion_weight": total([f"ont_weight_{e}" for e in emotions]),
        "ont_emotion_valence": reduce(lambda a, b: a + b, [F.col(f"ont_weight_{e}") * F.lit(float(valence[e])) for e in emotions]),
    } | {f"ont_total_{k}": total([f"ont_{c}_{k}" for c in concepts]) for k in ("positive", "negative", "neutral")})
    size = F.greatest(F.col("n_words"), F.lit(1))
    mentions_, factor = total([f"ont_total_{k}" for k in ("positive", "negative", "neutral")]), F.abs(F.col("ont_modifier_factor"))
    parts = [F.col(f"ont_count_{k}") for k in ("concepts", "modifiers", "emotions")]
    return rows.withColumns({
        "ont_domain_density": parts[0] / size, "ont_modifier_density": parts[1] / size, "ont_emotion_density": parts[2] / size,
        "ont_emotion_x_polarity": parts[2] * factor, "ont_semantic_richness": parts[0] + parts[1] + parts[2], "ont_polarity_abs": factor,
        "ont_emotion_concept_ratio": parts[2] / F.greatest(parts[0], F.lit(1.0)), "ont_has_elements": (parts[0] + parts[1] + parts[2] > 0).cast("double"),
        "ont_composite": 0.4 * F.col("ont_domain_score") + 0.3 * factor + 0.3 * F.col("ont_emotion_weight"),
        "ont_global_ratio": F.when(mentions_ > 0, (F.col("ont_total_positive") - F.col("ont_total_negative")) / F.greatest(mentions_, F.lit(1.0))).otherwise(0.0),
    })
