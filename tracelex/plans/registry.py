"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelex.functions import text as T
from tracelex.operators import ablation, audit, dictionary, enrich, fingerprint, graph, inference, lexicon, measure, models, sensitivity, shapes, tables, terms
from tracelex.plans import fixtures as X
from tracelex.sources import files

QUERIES: dict = {}
ORACLES: dict = {}

B_SQL = r"""[\s\-\(\)\[\]\{\}\.,;:!\?"''`]"""


def _marked(p):
    return re.sub(r"(\W)", "\4\\1\3", p).replace("\4", "' || chr(4) || '").replace("\3", "' || chr(3) || '")


def _short(t):
    return f"len(list_filter(sp, lambda x: x = '{t}'))"


def _hit(t):
    return f"{_short(t)}::DOUBLE" if len(t) < T.LONG_FROM else rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])')::INTEGER::DOUBLE"


def _bonus(c):
    return " + ".join(f"0.5 * contains(low, '{x}')::INTEGER" for x in X.COMPOUNDS.get(c, [])) or "0.0"


POSTS = """posts AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'u' || (doc_id % 97) AS author, '' AS title, text AS body, source AS topic, lang,
  CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END AS created,
  CASE doc_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM documents)"""
LAB = "lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS label FROM labels)"
LOW = rf"""cln AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '`[^`]+`|```[\s\S]+?```', ' ', 'g') AS clean FROM documents),
low AS (SELECT doc_id, clean, lower(clean) AS low, regexp_split_to_array(lower(clean), '{B_SQL}') AS sp FROM cln)"""
SCORES = LOW + ", vs AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS concept, '{t}' AS term, {p} AS term_pos, {_hit(t)} AS hits, {_hit(t)} + {_bonus(c)} AS score FROM low" for c, t, p in X.VOCABULARY
) + "), sc AS (SELECT * FROM vs WHERE score > 0)"
FEAT = LOW + r""", f0 AS (SELECT doc_id, len(list_filter(regexp_split_to_array(clean, '\s+'), lambda x: x <> '')) AS n_words, """ + ", ".join(
    "(" + " + ".join(_hit(t) for k, t, _ in X.VOCABULARY if k == c) + f") + ({_bonus(c)}) * {sum(k == c for k, _, _ in X.VOCABULARY)} AS ont_{c.lower()}" for c in X.CONCEPTS
) + " FROM low), f1 AS (SELECT *, " + " + ".join(f"(ont_{c.lower()} > 0)::INTEGER::DOUBLE" for c in X.CONCEPTS) + """ AS ont_count FROM f0),
feat AS (SELECT *, ont_count / greatest(n_words, 1) AS ont_density FROM f1)"""
# Matches get a mark (1) where they begin; boundary characters stand between 4 and 3 before, so that matches don't overlap.
_PATTERNS = [(c, f"'{t}'", t, len(t) < T.LONG_FROM) for c, t, _ in X.VOCABULARY] + [(c, "NULL", x, False) for c, xs in X.COMPOUNDS.items() for x in xs]
MENTIONS = SCORES + r""", won AS (SELECT doc_id, concept, arg_max(term, term_pos) AS wt FROM sc GROUP BY ALL),
pat(concept, term, p, short) AS (VALUES """ + ", ".join(f"('{c}', {t}, '{_marked(x)}', {short})" for c, t, x, short in _PATTERNS) + rf"""),
sg AS (SELECT doc_id, trim(regexp_replace(low, '\s+', ' ', 'g')) AS sg FROM low),
sb AS (SELECT doc_id, list_filter(string_split(sg, ' '), lambda x: x <> '') AS words, regexp_replace(sg, '({B_SQL})', chr(4) || '\1' || chr(3), 'g') AS b,
  regexp_replace(sg, '([^\p{{L}}\p{{N}}_])', chr(4) || '\1' || chr(3), 'g') AS l FROM sg),
mk AS (SELECT doc_id, concept, short, words, string_split(replace(replace(regexp_replace(CASE WHEN short THEN b ELSE l END, '(^|' || chr(3) || ')' || p || '(' || chr(4) || '|$)', '\1' || chr(1) || p || '\2', 'g'), chr(3), ''), chr(4), ''), chr(1)) AS ps
  FROM won JOIN pat USING (concept) JOIN sb USING (doc_id) WHERE pat.term IS NULL OR pat.term = wt),
pre AS (SELECT doc_id, concept, words, CASE WHEN short THEN left(t, greatest(length(t) - 1, 0)) ELSE t END AS t FROM (SELECT *, array_to_string(ps[1:k], '') AS t FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM mk))),
mat AS (SELECT doc_id, concept, words, greatest(len(list_filter(string_split(t, ' '), lambda x: x <> '')) - 1, 0)::INTEGER AS "at" FROM pre),
mw AS (SELECT doc_id, concept, "at", words[greatest("at" - 5, 0) + 1:"at" + 6] AS words FROM mat),
mp AS (SELECT *, list_sum(list_transform(words, lambda x: CASE regexp_replace(x, '[^\p{{L}}\p{{N}}_\s]', '', 'g') """ + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in X.LEXICON.items()) + """ ELSE 0.0::DOUBLE END)) AS polarity FROM mw),
mn AS (SELECT *, CASE WHEN polarity > 0.5 THEN 'positive' WHEN polarity < -0.5 THEN 'negative' ELSE 'neutral' END AS kind FROM mp),
cp AS (SELECT doc_id, concept, count(*) FILTER (kind = 'positive') AS positive, count(*) FILTER (kind = 'negative') AS negative, count(*) FILTER (kind = 'neutral') AS neutral,
  coalesce(sum(polarity) FILTER (kind = 'positive'), 0.0) AS positive_score, coalesce(sum(polarity) FILTER (kind = 'negative'), 0.0) AS negative_score, count(*) AS n FROM mn GROUP BY ALL),
cr AS (SELECT *, greatest(-1.0, least(1.0, (positive_score + negative_score) / n / 2)) AS ratio FROM cp)"""
CELLS = FEAT + ", cells AS (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, {f}::DOUBLE AS value FROM feat" for f in X.FEATURES) + ")"
MODS = "mods(feature, module, concept) AS (VALUES " + ", ".join(f"('{f}', '{m}', {repr(c) if c else 'NULL'})" for f, (m, c) in X.MODULES.items()) + ")"
SEL = "sel(feature, ord) AS (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(X.SELECTED)) + ")"
PRED = FEAT + ", " + LAB + """, runs(condition, seed) AS (SELECT * FROM (VALUES ('BSL'), ('ENR')) a(c), (VALUES (42), (123), (2024)) b(s)),
pred AS (SELECT CAST(feat.doc_id AS VARCHAR) AS id, 'test' AS split, label AS y_true, condition, seed,
  (CASE WHEN condition = 'BSL' THEN 2 WHEN ont_alpha > 2 THEN 2 WHEN ont_beta > 0 THEN 1 ELSE 0 END + CASE WHEN (feat.doc_id + seed) % 11 = 0 THEN 1 ELSE 0 END) % 3 AS y_pred
  FROM feat JOIN lab USING (doc_id), runs WHERE feat.doc_id % 5 = 4)"""
MATRIX = PRED + """, grid AS (SELECT a AS y_true, b AS y_pred FROM range(3) x(a), range(3) y(b)),
cm AS (SELECT r.condition, r.seed, g.y_true, g.y_pred, count(p.id) AS n FROM (SELECT DISTINCT condition, seed FROM pred) r CROSS JOIN grid g
  LEFT JOIN pred p ON p.condition = r.condition AND p.seed = r.seed AND p.y_true = g.y_true AND p.y_pred = g.y_pred GROUP BY ALL)"""
CLASSES = MATRIX + """, h AS (SELECT condition, seed, l AS label, coalesce(sum(n) FILTER (y_true = l AND y_pred = l), 0) AS hit, coalesce(sum(n) FILTER (y_true = l), 0) AS support,
  coalesce(sum(n) FILTER (y_pred = l), 0) AS said FROM cm, range(3) x(l) GROUP BY ALL),
h2 AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit::DOUBLE / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS recall FROM h),
pc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM h2)"""
OVERALL = CLASSES + """, ov AS (SELECT condition, seed, sum(hit)::DOUBLE / sum(support) AS accuracy, avg(f1) FILTER (support > 0 OR said > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM pc GROUP BY ALL)"""
SAN = r"CASE WHEN regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9_\\-]', '_', 'g') = '' THEN 'missing' ELSE regexp_replace({0}, '[^A-Za-z0-9_\\-]', '_', 'g') END"
BASE = graph.BASE
IRI = lambda kind, e: f"'{BASE}{kind}_' || " + SAN.format(e)
TRIPLES = POSTS + ", " + LAB + f""", pl AS (SELECT posts.*, label, {IRI('post', 'id')} AS pi, {IRI('author', 'author')} AS ai, {IRI('topic', 'topic')} AS ti FROM posts LEFT JOIN lab USING (doc_id)),
tr AS (SELECT DISTINCT * FROM (
  SELECT pi AS s, 'rdf:type' AS p, '{BASE}Post' AS o, 'iri' AS o_kind, NULL AS o_datatype FROM pl UNION ALL SELECT pi, 'identifier', id, 'literal', 'xsd:string' FROM pl
  UNION ALL SELECT pi, 'author', ai, 'iri', NULL FROM pl UNION ALL SELECT pi, 'topic', ti, 'iri', NULL FROM pl UNION ALL SELECT pi, 'language', lang, 'literal', 'xsd:string' FROM pl
  UNION ALL SELECT pi, 'created', strftime(coalesce(created, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S'), 'literal', 'xsd:dateTime' FROM pl
  UNION ALL SELECT pi, 'length', CAST(length(trim(body)) AS VARCHAR), 'literal', 'xsd:integer' FROM pl
  UNION ALL SELECT pi, 'label', CASE label WHEN 0 THEN '{BASE}Negative' WHEN 1 THEN '{BASE}Neutral' WHEN 2 THEN '{BASE}Positive' END, 'iri', NULL FROM pl
  UNION ALL SELECT ai, 'rdf:type', '{BASE}Author', 'iri', NULL FROM pl UNION ALL SELECT ti, 'rdf:type', '{BASE}Topic', 'iri', NULL FROM pl) WHERE o IS NOT NULL)"""
FOCUS = TRIPLES + f", fo AS (SELECT DISTINCT s FROM tr WHERE p = 'rdf:type' AND o = '{BASE}Post')"
TRACE = CELLS + ", " + MODS + ", " + POSTS + f""", act AS (SELECT CAST(doc_id AS VARCHAR) AS id, feature, module, concept, value FROM cells JOIN mods USING (feature) WHERE value <> 0),
tm AS (SELECT posts.id, split, {IRI('post', 'posts.id')} AS post_iri, feature, module, concept, value FROM posts LEFT JOIN act USING (id))"""
POS = POSTS + ", pos AS (SELECT doc_id, id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos FROM posts)"
VAL = "val(term, valence) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in X.VALENCE.items()) + ")"
TOK = r"tok AS (SELECT doc_id, token, pos FROM (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)))"
FREQ = TOK + ", fq AS (SELECT token, count(*) AS freq FROM tok GROUP BY 1)"
VOC = FREQ + ", vo AS (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) + 1 AS index FROM fq WHERE freq >= 2)"


# What the queries below have in common.
docs = lambda s, d: X.table(s, d, "documents")
features = lambda s, d: enrich.concept_features(docs(s, d), X.VOCABULARY, X.COMPOUNDS, X.CONCEPTS)
cells = lambda s, d: tables.unpivot(features(s, d), X.FEATURES)
stored_cells = lambda s, d: tables.unpivot(stage(s, features(s, d)), X.FEATURES)
scores = lambda s, d: dictionary.term_matches(docs(s, d), X.vocabulary(s), X.compounds(s), by_text=True)
mapped = lambda s, d: tables.join_module_map(cells(s, d), X.modules(s))
with_split = lambda s, d: mapped(s, d).withColumn("split", X.split_of(F.col("doc_id")))
labelled = lambda s, d: cells(s, d).join(X.labels(s, d), "doc_id")
triples = lambda s, d: graph.post_triples(X.posts(s, d).join(X.labels(s, d), "doc_id", "left"))
focus = lambda t: graph.targets(t, f"{BASE}Post")
id_cells = lambda s, d: mapped(s, d).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
stage = lambda s, df: files.through_parquet(df, files.scratch(s))
traced = lambda s, own: graph.trace_rows(own.withColumns({"id": F.col("doc_id").cast("string"), "split": X.split_of(F.col("doc_id"))}), X.FEATURES, X.modules(s))
trace = lambda s, d: traced(s, features(s, d))
positions = lambda s, d: tables.split_positions(X.posts(s, d))
valence = lambda s: s.createDataFrame(list(X.VALENCE.items()), "term string, valence double")
tokens = lambda s, d: docs(s, d).select("doc_id", F.posexplode(T.words(F.lower("text"))).alias("pos", "token"))
windows = lambda s, d: lexicon.concept_windows(docs(s, d).where(X.split_of(F.col("doc_id")) == "train"), X.ANCHORS, X.STOPWORDS)
freq = lambda s, d: tokens(s, d).groupBy("token").agg(F.count("*").alias("freq"))


def predictions(s, d):
    runs = s.createDataFrame([(c, n) for c in ("BSL", "ENR") for n in (42, 123, 2024)], "condition string, seed int")
    f = features(s, d).where("doc_id % 5 = 4").join(X.labels(s, d), "doc_id").join(F.broadcast(runs), F.lit(True))
    base = F.when(F.col("condition") == "BSL", 2).when(F.col("ont_alpha") > 2, 2).when(F.col("ont_beta") > 0, 1).otherwise(0)
    shift = F.when((F.col("doc_id") + F.col("seed")) % 11 == 0, 1).otherwise(0)
    return f.select(F.col("doc_id").cast("string").alias("id"), F.lit("test").alias("split"), F.col("label").alias("y_true"), "condition", "seed", ((base + shift) % 3).alias("y_pred"))


KEYS = ["condition", "seed"]
matrix = lambda s, d: measure.confusion_matrix(predictions(s, d), KEYS)
per_class = lambda s, d: measure.metrics_per_class(matrix(s, d), KEYS)
overall = lambda s, d: measure.metrics_overall(per_class(s, d), KEYS)


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql=None, name=None):
    def wrap(f):
        add(name or f.__name__, lambda s, d: rounded(f(s, d)), sql)
        return f

    return wrap


# Scans and sinks.
add("entry_activation", lambda s, d: rounded(
    enrich.top_concepts(enrich.concept_scores(scores(s, d))).join(docs(s, d).select("doc_id", "source"), "doc_id").groupBy("source", "concept").agg(F.count("*").alias("posts"), F.avg("score").alias("mean_score"))),
    f"WITH {SCORES} SELECT source, concept, count(*) AS posts, round(avg(score), 6) AS mean_score FROM (SELECT doc_id, concept, sum(score) AS score FROM sc GROUP BY ALL) JOIN documents USING (doc_id) GROUP BY ALL")
add("scan_documents", lambda s, d: docs(s, d).select("doc_id", "lang", "source", "n_chars"), "SELECT doc_id, lang, source, n_chars FROM documents")


add("scan_lexicon", lambda s, d: tokens(s, d).select("token").distinct().join(F.broadcast(valence(s)), F.col("token") == F.col("term")).select("term", "valence"),
    f"WITH {VAL}, {TOK} SELECT DISTINCT term, valence FROM val JOIN tok ON token = term")


add("sink_parquet", lambda s, d: rounded(files.through_parquet(features(s, d), files.scratch(s))), f"WITH {FEAT} SELECT doc_id, n_words, " + ", ".join(f"round({f}, 6) AS {f}" for f in X.FEATURES) + " FROM feat")
add("sink_csv_union", lambda s, d: s.read.option("header", True).schema("lang string, n long, source string").csv(files.write_csv(files.union_rows([
    docs(s, d).groupBy("lang").agg(F.count("*").alias("n")), docs(s, d).groupBy("source").agg(F.count("*").alias("n"))]), files.scratch(s))),
    "SELECT lang, count(*) AS n, NULL AS source FROM documents GROUP BY lang UNION ALL SELECT NULL, count(*), source FROM documents GROUP BY source")
add("sink_report_json", lambda s, d: s.read.schema("docs long, langs long").json(files.write_report(docs(s, d).agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs")), files.scratch(s))),
    "SELECT count(*) AS docs, count(DISTINCT lang) AS langs FROM documents")
FULL = lambda c: f"CASE WHEN {c} LIKE 'http%' THEN {c} ELSE '{BASE}' || replace({c}, ':', '_') END"
_LONG = lambda c: "CASE " + " ".join(f"WHEN starts_with({c}, '{a}') THEN '{b}' || substr({c}, {len(a) + 1})" for a, b in graph.PREFIXES.items()) + f" WHEN regexp_matches({c}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {c} ELSE '{BASE}' || {c} END"
_ESC = "replace(replace(replace(replace(replace(o, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '\"', '\\\"')"
# Beside the posts' triples, the texts themselves with their language: white space, quotes and backslashes of all kinds.
TEXTS_G = f"tt AS (SELECT s, p, o, o_kind, o_datatype, NULL AS o_lang FROM tr UNION ALL SELECT '{BASE}post_' || doc_id, 'text', '\"' || text || '\\n' || chr(10) || chr(9) || '\\', 'literal', 'rdf:langString', lang FROM documents WHERE text IS NOT NULL)"


def text_triples(s, d):
    said = F.concat(F.lit('"'), "text", F.lit("\\n\n\t\\"))
    texts = docs(s, d).where("text is not null").select(F.concat(F.lit(f"{BASE}post_"), F.col("doc_id").cast("string")), F.lit("text"), said, F.lit("literal"), F.lit("rdf:langString"), "lang")
    return triples(s, d).withColumn("o_lang", F.lit(None).cast("string")).union(texts)


add("sink_ntriples", lambda s, d: s.read.text(files.write_lines(graph.ntriples(text_triples(s, d)), files.scratch(s))).withColumnRenamed("value", "line"),
    f"""WITH {TRIPLES}, {TEXTS_G} SELECT '<' || {_LONG('s')} || '> <' || {_LONG('p')} || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || {_LONG('o')} || '>' ELSE '"' || {_ESC} || '"' || CASE WHEN o_lang IS NOT NULL THEN '@' || o_lang WHEN o_datatype <> 'xsd:string' THEN '^^<' || {_LONG('o_datatype')} || '>' ELSE '' END END || ' .' AS line FROM tt""")
add("scan_ntriples", lambda s, d: files.read_ntriples(s, files.write_lines(graph.ntriples(text_triples(s, d)), files.scratch(s))), f"WITH {TRIPLES}, {TEXTS_G} SELECT * FROM tt")

# Projections and filters.
add("combine_text_space", lambda s, d: X.posts(s, d).select("id", T.combine(F.col("topic"), F.col("body")).alias("text")), f"WITH {POSTS} SELECT id, trim(coalesce(topic, '') || ' ' || coalesce(body, '')) AS text FROM posts")
add("combine_text_sentence", lambda s, d: X.posts(s, d).select("id", T.combine(F.col("title"), F.col("body"), sep=". ").alias("text")), f"WITH {POSTS} SELECT id, trim(coalesce(title, '') || '. ' || coalesce(body, '')) AS text FROM posts")
add("rdf_text_length", lambda s, d: X.posts(s, d).select("id", F.length(T.combine(F.col("title"), F.col("body"))).alias("n")), f"WITH {POSTS} SELECT id, length(trim(title || ' ' || body)) AS n FROM posts")
add("clean_code_blocks", lambda s, d: docs(s, d).select("doc_id", F.md5(T.clean_code_blocks(F.col("text"))).alias("md5")), f"WITH {LOW} SELECT doc_id, md5(clean) AS md5 FROM low")
add("columns_by_prefix", lambda s, d: (lambda f: rounded(f.select("doc_id", *tables.columns_by_prefix(f, "ont_"))))(features(s, d)), f"WITH {FEAT} SELECT doc_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in X.FEATURES) + " FROM feat")
add("fill_zero_cast", lambda s, d: tables.unpivot(docs(s, d).join(X.labels(s, d), "doc_id", "left").select("doc_id", "label"), ["label"]), f"WITH {LAB} SELECT doc_id, 'label' AS feature, coalesce(label, 0)::DOUBLE AS value FROM documents LEFT JOIN lab USING (doc_id)")
query(f"WITH {CELLS} SELECT doc_id, feature, round(value, 6) AS value FROM cells WHERE value <> 0", "filter_nonzero")(lambda s, d: cells(s, d).where("value <> 0"))
query(f"WITH {CELLS}, {SEL} SELECT doc_id, feature, round(value, 6) AS value FROM cells SEMI JOIN sel USING (feature) WHERE value <> 0", "filter_selected")(lambda s, d: cells(s, d).where("value <> 0").join(X.selection(s), "feature", "left_semi"))
add("filter_split", lambda s, d: X.posts(s, d).where("split = 'val'").select("id"), f"WITH {POSTS} SELECT id FROM posts WHERE split = 'val'")
add("condition_features", lambda s, d: tables.condition_features(X.modules(s), X.selection(s)).join(cells(s, d).where("value <> 0").groupBy("feature").agg(F.count("*").alias("n")), "feature"),
    f"""WITH {CELLS}, {MODS}, {SEL}, n AS (SELECT feature, count(*) AS n FROM cells WHERE value <> 0 GROUP BY 1), c AS (SELECT 'full' AS condition, feature FROM mods UNION ALL SELECT 'selected', feature FROM sel
    UNION ALL SELECT 'drop_' || m, feature FROM mods, (SELECT DISTINCT module AS m FROM mods) WHERE m <> module UNION ALL SELECT 'module_only_' || module, feature FROM mods) SELECT condition, feature, n FROM c JOIN n USING (feature)""")
add("require_columns", lambda s, d: tables.require_columns(docs(s, d), ["doc_id", "text", "absent"], "doc_id"),
    """SELECT unnest(['has_doc_id', 'has_text', 'has_absent', 'not_empty', 'key_unique', 'key_not_null']) AS "check", unnest([true, true, false, count(*) > 0, count(*) = count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL), count(*) = count(doc_id)]) AS ok FROM documents""")

# Joins.
add("join_split_ordered", lambda s, d: positions(s, d).join(X.posts(s, d).select("id", "lang"), "id").select("id", "split", "pos", "lang"), f"WITH {POS} SELECT pos.id, pos.split, pos, lang FROM pos JOIN posts USING (id)")
add("check_split_disjoint", lambda s, d: tables.check_split_disjoint(positions(s, d).union(positions(s, d).where("doc_id % 50 = 0").withColumn("split", F.lit("val")))),
    f"WITH {POS}, u AS (SELECT id, split FROM pos UNION ALL SELECT id, 'val' FROM pos WHERE doc_id % 50 = 0) SELECT id, count(*) AS n, count(DISTINCT split) AS n_splits FROM u GROUP BY id HAVING count(*) > 1")
add("anti_missing_ids", lambda s, d: X.posts(s, d).select("id").join(X.labels(s, d).select(F.col("doc_id").cast("string").alias("id")), "id", "left_anti"), f"WITH {POSTS} SELECT id FROM posts WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
add("join_lexicon", lambda s, d: freq(s, d).join(F.broadcast(valence(s)), F.col("token") == F.col("term")).select("term", "freq", "valence"), f"WITH {VAL}, {FREQ} SELECT term, freq, valence FROM fq JOIN val ON token = term")
query(f"WITH {CELLS}, {MODS} SELECT doc_id, feature, round(value, 6) AS value, coalesce(module, 'unmapped') AS module, concept FROM cells LEFT JOIN mods USING (feature)", "join_module_map")(mapped)


def conditions():
    """The features of every condition: none, all, the selected ones, all but a module, a module alone."""
    modules = sorted({m for m, _ in X.MODULES.values()})
    own = lambda m: [f for f in X.FEATURES if X.MODULES[f][0] == m]
    return {"BSL": [], "full": X.FEATURES, "selected": X.SELECTED} | {f"drop_{m}": [f for f in X.FEATURES if f not in own(m)] for m in modules} | {f"module_only_{m}": own(m) for m in modules}


# Runs of two rules under every condition and seed: sums over the condition's features that are not 0.
ARUN = ["model", "condition", "seed"]
_score = lambda own: " + ".join(f"(ont_{f[4:]} > 0)::INTEGER * {X.FEATURES.index(f) + 1}" for f in own) or "0"
ABLATED = FEAT + ", " + LAB + ", ap AS (" + " UNION ALL ".join(
    f"SELECT doc_id, label AS y_true, '{m}' AS model, '{c}' AS condition, seed, ((({_score(own)}) {turn}) % 3 + ((doc_id + seed) % 11 = 0)::INTEGER) % 3 AS y_pred FROM feat JOIN lab USING (doc_id), (VALUES (42), (123), (2024)) s(seed) WHERE doc_id % 5 = 4"
    for m, turn in (("rule", ""), ("vote", "// 2")) for c, own in conditions().items()
) + """), ah AS (SELECT model, condition, seed, l AS label, count(*) FILTER (y_true = l AND y_pred = l) AS hit, count(*) FILTER (y_true = l) AS support, count(*) FILTER (y_pred = l) AS said FROM ap, range(3) x(l) GROUP BY ALL),
a2 AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit::DOUBLE / said END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS re FROM ah),
a3 AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM a2),
ao AS (SELECT model, condition, seed, sum(hit)::DOUBLE / sum(support) AS accuracy, avg(f1) FILTER (support > 0 OR said > 0) AS macro_f1 FROM a3 GROUP BY ALL),
nf(condition, n_features) AS (VALUES """ + ", ".join(f"('{c}', {len(own)})" for c, own in conditions().items()) + """),
am AS (SELECT model, condition, avg(macro_f1) AS macro_f1, coalesce(stddev_samp(macro_f1), 0) AS macro_f1_std, avg(accuracy) AS accuracy, coalesce(stddev_samp(accuracy), 0) AS accuracy_std, count(*) AS runs FROM ao GROUP BY ALL),
asu AS (SELECT am.*, n_features, macro_f1 - max(macro_f1) FILTER (condition = 'full') OVER (PARTITION BY model) AS delta_vs_full, macro_f1 - max(macro_f1) FILTER (condition = 'BSL') OVER (PARTITION BY model) AS delta_vs_bsl FROM am JOIN nf USING (condition)),
ar AS (SELECT model, replace(condition, 'drop_', '') AS module, round(-delta_vs_full, 9) AS contribution FROM asu WHERE condition LIKE 'drop%')"""  # fmt: skip


def ablated(s, d):
    rows = stage(s, features(s, d).where("doc_id % 5 = 4").join(X.labels(s, d), "doc_id"))
    value = lambda own: reduce(lambda a, b: a + b, [F.when(F.col(f) > 0, X.FEATURES.index(f) + 1).otherwise(0) for f in own], F.lit(0))
    turned = {"rule": lambda x: x, "vote": lambda x: F.floor(x / 2)}
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition"), f(value(own)).cast("int").alias("score")) for m, f in turned.items() for c, own in conditions().items()])
    each = rows.select("doc_id", F.col("label").alias("y_true"), F.explode(runs).alias("x")).select("doc_id", "y_true", "x.*").withColumn("seed", F.explode(F.array(F.lit(42), F.lit(123), F.lit(2024))))
    return each.withColumn("y_pred", (F.col("score") % 3 + F.when((F.col("doc_id") + F.col("seed")) % 11 == 0, 1).otherwise(0)) % 3)


ablation_scores = lambda s, d: measure.metrics_overall(measure.metrics_per_class(measure.confusion_matrix(ablated(s, d).withColumn("id", F.col("doc_id")), ARUN), ARUN), ARUN)
ablation_summary = lambda s, d: ablation.summary(ablation_scores(s, d), s.createDataFrame([(c, len(own)) for c, own in conditions().items()], "condition string, n_features int"))
query(f"WITH {ABLATED} SELECT model, condition, seed, round(macro_f1, 6) AS macro_f1, round(max(macro_f1) FILTER (condition = 'BSL') OVER (PARTITION BY model, seed), 6) AS bsl, round(max(macro_f1) FILTER (condition = 'full') OVER (PARTITION BY model, seed), 6) AS \"full\" FROM ao", "join_baselines")(
    lambda s, d: ablation.baselines(ablation_scores(s, d)).select(*ARUN, "macro_f1", "bsl", "full"))
query(f"WITH {ABLATED} SELECT model, condition, n_features, runs, {', '.join(f'round({c}, 6) AS {c}' for c in ('macro_f1', 'macro_f1_std', 'accuracy', 'accuracy_std', 'delta_vs_full', 'delta_vs_bsl'))} FROM asu", "agg_ablation_summary")(ablation_summary)
query(f"WITH {ABLATED} SELECT model, module, round(contribution, 6) AS contribution, row_number() OVER (PARTITION BY model ORDER BY contribution DESC, module) AS rank FROM ar", "rank_modules")(lambda s, d: ablation.module_ranks(ablation_summary(s, d)))
CELLTRACE = TRACE + """, ct AS (SELECT CAST(doc_id AS VARCHAR) AS id, c.feature, c.value, t.value AS trace_value, c.value <> 0 AS trace_expected,
  CASE WHEN c.value <> 0 THEN coalesce(abs(c.value - t.value) <= 1e-12, false) ELSE t.value IS NULL END AS cell_match FROM cells c LEFT JOIN tm t ON t.id = CAST(c.doc_id AS VARCHAR) AND t.feature = c.feature)"""
# Cells and trace are both of the features that one scan of the texts stored.
celltrace = lambda s, d: (lambda own: audit.cell_trace(tables.unpivot(own, X.FEATURES).select(F.col("doc_id").cast("string").alias("id"), "feature", "value"), traced(s, own)))(stage(s, features(s, d)))
query(f"WITH {CELLTRACE} SELECT id, feature, round(value, 6) AS value, round(trace_value, 6) AS trace_value FROM ct", "join_cell_trace")(lambda s, d: celltrace(s, d).select("id", "feature", "value", "trace_value"))
# A trace with other values for some posts, without the rows of some, and with rows of zero cells for others.
FAULTS = CELLS + """, ft AS (SELECT CAST(doc_id AS VARCHAR) AS id, feature, CASE WHEN doc_id % 50 = 1 THEN value + 0.5 ELSE value END AS v FROM cells WHERE (value <> 0 AND doc_id % 50 <> 2) OR doc_id % 50 = 3),
cf AS (SELECT CAST(doc_id AS VARCHAR) AS id, cells.feature, value, v AS trace_value, value <> 0 AS trace_expected, CASE WHEN value <> 0 THEN coalesce(abs(value - v) <= 1e-12, false) ELSE v IS NULL END AS cell_match FROM cells LEFT JOIN ft ON ft.id = CAST(doc_id AS VARCHAR) AND ft.feature = cells.feature)"""
query(f"WITH {FAULTS} SELECT id, feature, round(value, 6) AS value, round(trace_value, 6) AS trace_value, trace_expected, cell_match FROM cf", "cell_trace")(
    lambda s, d: (lambda c: audit.cell_trace(c.select("id", "feature", "value"), c.where(((F.col("value") != 0) & (F.col("doc_id") % 50 != 2)) | (F.col("doc_id") % 50 == 3)).select("id", "feature", F.when(F.col("doc_id") % 50 == 1, F.col("value") + 0.5).otherwise(F.col("value")).alias("value"))))(
        stored_cells(s, d).withColumn("id", F.col("doc_id").cast("string"))))
query(f"WITH {CELLTRACE} SELECT count(*) AS cells, count(*) FILTER (trace_expected) AS nonzero, count(trace_value) AS traced, count(*) FILTER (NOT cell_match) AS mismatches FROM ct", "agg_trace_counts")(lambda s, d: audit.trace_counts(celltrace(s, d)))
GRID_SQL = "gr AS (SELECT 'f' || f || '_v' || v AS variant, f AS min_freq, v AS min_valence FROM (VALUES (1), (3), (50)) a(f), (VALUES (0.5::DOUBLE), (1.0), (2.0)) b(v))"
small_grid = lambda s: s.createDataFrame([(f"f{f}_v{v}", f, v) for f in (1, 3, 50) for v in (0.5, 1.0, 2.0)], "variant string, min_freq int, min_valence double")
add("theta_lexicon_grid", lambda s, d: tables.theta_lexicon_grid(QUERIES["join_lexicon"](s, d), small_grid(s)), f"WITH {VAL}, {FREQ}, {GRID_SQL} SELECT variant, term FROM fq JOIN val ON token = term JOIN gr ON freq >= min_freq AND abs(valence) >= min_valence")
add("cross_variants", lambda s, d: docs(s, d).select("doc_id").join(F.broadcast(s.createDataFrame([(2,), (5,), (10,)], "window int")), F.lit(True)), 'SELECT doc_id, "window" FROM documents, (VALUES (2), (5), (10)) w("window")')
add("anti_concept_membership", lambda s, d: graph.chk_scheme(triples(s, d), ["topic"], triples(s, d).where("p = 'topic'").groupBy("o").agg(F.count("*").alias("n")).where("n >= 51").select("o")),
    f"WITH {TRIPLES} SELECT s AS focus, 'topic' AS path, o AS value, 'scheme' AS component, 'Violation' AS severity, 'scheme of topic' AS message FROM tr WHERE p = 'topic' AND o NOT IN (SELECT o FROM tr WHERE p = 'topic' GROUP BY o HAVING count(*) >= 51)")
SHORT = "u7 AS (SELECT s, p, CASE WHEN o LIKE '_%7' THEN left(o, length(o) - 1) ELSE o END AS o FROM tr WHERE p = 'identifier')"
# Identifiers that end in 7 lose that digit, so that some are had twice.
shortened = lambda s, d: triples(s, d).where("p = 'identifier'").withColumn("o", F.when(F.col("o").like("_%7"), F.expr("left(o, length(o) - 1)")).otherwise(F.col("o")))
add("chk_unique_identifier", lambda s, d: graph.chk_unique(shortened(s, d), "identifier"),
    f"WITH {TRIPLES}, {SHORT} SELECT s AS focus, 'identifier' AS path, o AS value, 'unique' AS component, 'Violation' AS severity, 'unique of identifier' AS message FROM (SELECT *, count(*) OVER (PARTITION BY o) AS n FROM u7) WHERE n > 1")
add("self_duplicate_identifier", lambda s, d: shortened(s, d).groupBy(F.col("o").alias("identifier")).agg(F.count("*").alias("n"), F.min("s").alias("first")).where("n > 1"),
    f"WITH {TRIPLES}, {SHORT} SELECT o AS identifier, count(*) AS n, min(s) AS first FROM u7 GROUP BY 1 HAVING count(*) > 1")

# Enrichment.
LABELS_V = [("A", "Alpha", "prefLabel", "en"), ("A", "Alfa", "prefLabel", "es"), ("A", "AI", "altLabel", "fr"), ("B", "Beta", "prefLabel", "de"), ("C", "Gamma", "prefLabel", "en")]


@query("""SELECT d.lang, x.concept, x.term FROM (SELECT DISTINCT lang FROM documents) d JOIN (SELECT DISTINCT l.concept, lower(l.label) AS term, l.lang FROM (VALUES ('A', 'Alpha', 'prefLabel', 'en'), ('A', 'Alfa', 'prefLabel', 'es'), ('A', 'AI', 'altLabel', 'fr'), ('B', 'Beta', 'prefLabel', 'de'), ('C', 'Gamma', 'prefLabel', 'en')) l(concept, label, kind, lang)
  WHERE concept IN ('A', 'B') AND (kind = 'altLabel' OR lang IN ('es', 'en'))) x ON true""")
def vocab_terms(s, d):
    concepts = s.createDataFrame([("A", "tech"), ("B", "tech"), ("C", "other")], "concept string, scheme string")
    terms = enrich.vocab_terms(concepts, s.createDataFrame(LABELS_V, "concept string, label string, kind string, lang string"), "tech")
    return docs(s, d).select("lang").distinct().join(F.broadcast(terms), F.lit(True))


low_col = lambda: F.lower(T.clean_code_blocks(F.col("text")))
# Vocabularies as tables: the terms of the benchmark's texts, words, pairs and triples.
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\p{M}]+')"
TERMS_SQL = f"""bw AS (SELECT {WORDS_SQL} AS w FROM benchmark), bt AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM bw)"""
TOKENS_SQL = r"""tk AS (SELECT doc_id, regexp_extract_all(low, '[\p{L}\p{N}_\p{M}]+|[^\p{L}\p{N}_\p{M}]') AS t FROM low),
gm AS (SELECT doc_id, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2]), list_transform(range(1, len(t) - 3), lambda i: t[i] || t[i + 1] || t[i + 2] || t[i + 3] || t[i + 4])))) AS term FROM tk)"""
matches = lambda s, d: dictionary.term_matches(docs(s, d), X.benchmark_terms(s, d))
add("match_short_term", lambda s, d: dictionary.term_matches(docs(s, d), X.benchmark_terms(s, d), short_only=True).select("doc_id", "term", F.col("hits").cast("long").alias("hits")),
    f"WITH {LOW}, {TERMS_SQL} SELECT doc_id, term, count(*) AS hits FROM (SELECT doc_id, unnest(sp) AS term FROM low) JOIN bt USING (term) WHERE length(term) < 4 GROUP BY ALL")
add("match_long_term", lambda s, d: matches(s, d).where("length(term) >= 4").select("doc_id", "concept", "term", F.col("hits").cast("int").alias("hit")),
    f"WITH {LOW}, {TERMS_SQL}, {TOKENS_SQL} SELECT doc_id, left(term, 1) AS concept, term, 1 AS hit FROM gm JOIN bt USING (term) WHERE length(term) >= 4")
add("compound_bonus", lambda s, d: docs(s, d).select("doc_id", *[enrich.compound_bonus(low_col(), X.COMPOUNDS[c]).alias(c) for c in X.COMPOUNDS]), f"WITH {LOW} SELECT doc_id, {', '.join(f'({_bonus(c)})::DOUBLE AS {c}' for c in X.COMPOUNDS)} FROM low")
query(f"WITH {SCORES} SELECT doc_id, concept, round(sum(score), 6) AS score FROM sc GROUP BY ALL", "concept_scores")(lambda s, d: enrich.concept_scores(scores(s, d)))
query(f"WITH {SCORES} SELECT doc_id, concept, arg_max(term, term_pos) AS term FROM sc GROUP BY ALL", "concept_winner")(lambda s, d: enrich.concept_winner(scores(s, d)))
query(f"WITH {SCORES} SELECT * FROM (SELECT doc_id, concept, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(concept) DESC, concept) AS rank FROM (SELECT doc_id, concept, sum(score) AS score FROM sc GROUP BY ALL)) WHERE rank <= 2", "top_concepts")(
    lambda s, d: enrich.top_concepts(enrich.concept_scores(scores(s, d)), 2))
mention_rows = lambda s, d: enrich.mentions(docs(s, d), X.VOCABULARY, X.COMPOUNDS, X.lexicon(s))
query(f"WITH {MENTIONS} SELECT doc_id, concept, \"at\" FROM mn", "mention_positions")(lambda s, d: mention_rows(s, d).select("doc_id", "concept", "at"))
query(f"WITH {MENTIONS} SELECT doc_id, concept, \"at\", array_to_string(words, ' ') AS words FROM mn", "mention_window")(lambda s, d: mention_rows(s, d).select("doc_id", "concept", "at", F.array_join("window", " ").alias("words")))
query(f"WITH {MENTIONS} SELECT doc_id, concept, \"at\", round(polarity, 6) AS polarity FROM mn", "window_polarity")(lambda s, d: mention_rows(s, d).select("doc_id", "concept", "at", "polarity"))
query(f"WITH {MENTIONS} SELECT concept, kind, count(*) AS n FROM mn GROUP BY ALL", "mention_class")(lambda s, d: mention_rows(s, d).groupBy("concept", "kind").agg(F.count("*").alias("n")))
query(f"WITH {MENTIONS} SELECT doc_id, concept, positive, negative, neutral, round(positive_score, 6) AS positive_score, round(negative_score, 6) AS negative_score, round(ratio, 6) AS ratio FROM cr", "concept_polarity")(
    lambda s, d: enrich.concept_polarity(mention_rows(s, d)))
FACTORS = X.FACTORS
_flag = lambda k: "greatest(" + ", ".join(f"({_short(p)} > 0)::INTEGER" for p in X.MODIFIERS[k]) + ")"
query(f"WITH {LOW} SELECT doc_id, {', '.join(f'{_flag(k)} AS {k}' for k in X.MODIFIERS)}, least(10, {' + '.join(f'({_short(p)} > 0)::INTEGER' for ps in X.MODIFIERS.values() for p in ps)}) AS n_patterns, round({' * '.join(f'CASE WHEN {_short(p)} > 0 THEN {FACTORS[k]}::DOUBLE ELSE 1 END' for k, ps in X.MODIFIERS.items() for p in ps)}, 6) AS factor FROM low", "modifier_flags")(
    lambda s, d: enrich.modifier_flags(docs(s, d), X.MODIFIERS, FACTORS))
_emo = {e: " + ".join(f"{_short(p)} * {w}::DOUBLE" for p, w in ps.items()) for e, ps in X.EMOTIONS.items()}
query(f"WITH {LOW} SELECT doc_id, {', '.join(f'round({x}, 6) AS {e}' for e, x in _emo.items())} FROM low", "emotion_weights")(lambda s, d: enrich.emotion_weights(docs(s, d), X.EMOTIONS))
add("text_word_count", lambda s, d: docs(s, d).select("doc_id", T.word_count(T.clean_code_blocks(F.col("text"))).alias("n")), f"WITH {FEAT} SELECT doc_id, n_words AS n FROM feat")
query(f"WITH {FEAT} SELECT doc_id, n_words, {', '.join(f'round({f}, 6) AS {f}' for f in X.FEATURES)} FROM feat", "concept_features")(features)
_low = [c.lower() for c in X.CONCEPTS]
_sum = lambda xs: "(" + " + ".join(xs) + ")"
_mods = [(k, p) for k, ps in X.MODIFIERS.items() for p in ps]
VECTOR = MENTIONS + FEAT[len(LOW):] + ", px AS (SELECT doc_id, " + ", ".join(f"max({k}) FILTER (concept = '{c}') AS {c.lower()}_{k}" for c in X.CONCEPTS for k in ("positive", "negative", "neutral", "ratio")) + " FROM cr GROUP BY 1), v0 AS (SELECT low.doc_id, feat.n_words, " + ", ".join(
    [f"(feat.ont_{c} > 0)::INTEGER::DOUBLE AS ont_{c}, feat.ont_{c} AS ont_{c}_score" for c in _low]
    + [f"coalesce({c}_{k}, 0)::DOUBLE AS ont_{c}_{k}" for c in _low for k in ("positive", "negative", "neutral", "ratio")]
    + [f"greatest({', '.join(f'({_short(p)} > 0)::INTEGER' for p in ps)})::DOUBLE AS ont_mod_{k}" for k, ps in X.MODIFIERS.items()]
    + [_sum(f"({_short(p)} > 0)::INTEGER::DOUBLE" for _, p in _mods) + " AS ont_count_modifiers", " * ".join(f"CASE WHEN {_short(p)} > 0 THEN {X.FACTORS[k]}::DOUBLE ELSE 1 END" for k, p in _mods) + " AS ont_modifier_factor"]
    + [_sum(f"{_short(p)} * {w}::DOUBLE" for p, w in ps.items()) + f" AS ont_weight_{e}" for e, ps in X.EMOTIONS.items()]
) + " FROM low JOIN feat USING (doc_id) LEFT JOIN px USING (doc_id)), v1 AS (SELECT *, " + ", ".join(
    [f"(ont_weight_{e} > 0)::INTEGER::DOUBLE AS ont_emo_{e}" for e in X.EMOTIONS]
    + [_sum(f"ont_{c}" for c in _low) + " AS ont_count_concepts", _sum(f"(ont_weight_{e} > 0)::INTEGER::DOUBLE" for e in X.EMOTIONS) + " AS ont_count_emotions", _sum(f"ont_{c}_score" for c in _low) + " AS ont_domain_score",
       _sum(f"ont_weight_{e}" for e in X.EMOTIONS) + " AS ont_emotion_weight", _sum(f"ont_weight_{e} * {v}::DOUBLE" for e, v in X.EMOTION_VALENCE.items()) + " AS ont_emotion_valence"]
    + [_sum(f"ont_{c}_{k}" for c in _low) + f" AS ont_total_{k}" for k in ("positive", "negative", "neutral")]
) + """ FROM v0), v2 AS (SELECT *, ont_count_concepts / greatest(n_words, 1) AS ont_domain_density, ont_count_modifiers / greatest(n_words, 1) AS ont_modifier_density, ont_count_emotions / greatest(n_words, 1) AS ont_emotion_density,
  ont_count_emotions * abs(ont_modifier_factor) AS ont_emotion_x_polarity, ont_count_concepts + ont_count_modifiers + ont_count_emotions AS ont_semantic_richness, abs(ont_modifier_factor) AS ont_polarity_abs,
  ont_count_emotions / greatest(ont_count_concepts, 1.0) AS ont_emotion_concept_ratio, (ont_count_concepts + ont_count_modifiers + ont_count_emotions > 0)::INTEGER::DOUBLE AS ont_has_elements,
  0.4::DOUBLE * ont_domain_score + 0.3::DOUBLE * abs(ont_modifier_factor) + 0.3::DOUBLE * ont_emotion_weight AS ont_composite,
  CASE WHEN ont_total_positive + ont_total_negative + ont_total_neutral > 0 THEN (ont_total_positive - ont_total_negative) / (ont_total_positive + ont_total_negative + ont_total_neutral) ELSE 0.0 END AS ont_global_ratio FROM v1)"""
vector = lambda s, d: enrich.feature_vector(docs(s, d), X.VOCABULARY, X.COMPOUNDS, X.lexicon(s), X.MODIFIERS, X.FACTORS, X.EMOTIONS, X.EMOTION_VALENCE)
ALL_FEATURES = list(dict.fromkeys(re.findall(r" AS (ont_\w+)", VECTOR[VECTOR.index(", v0 AS") :])))
query(f"WITH {VECTOR} SELECT doc_id, n_words, {', '.join(f'round({f}, 6) AS {f}' for f in ALL_FEATURES)} FROM v2", "feature_vector")(vector)
DERIVED = ["ont_domain_density", "ont_modifier_density", "ont_emotion_density", "ont_emotion_x_polarity", "ont_semantic_richness", "ont_polarity_abs", "ont_emotion_valence", "ont_emotion_concept_ratio", "ont_has_elements", "ont_composite", "ont_global_ratio"]
query(f"WITH {VECTOR} SELECT doc_id, {', '.join(f'round({f}, 6) AS {f}' for f in DERIVED)} FROM v2", "derived_features")(lambda s, d: vector(s, d).select("doc_id", *DERIVED))
query(f"WITH {VAL}, {FREQ} SELECT term, freq, valence, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, valence)) AS weight, CASE WHEN valence > 0 THEN 'positive' ELSE 'negative' END AS polarity FROM fq JOIN val ON token = term WHERE freq >= 3 AND abs(valence) >= 1", "induce_lexicon")(
    lambda s, d: lexicon.induce_lexicon(tokens(s, d), valence(s)))
LEXS = f"{VAL}, {FREQ}, lx AS (SELECT * FROM fq JOIN val ON token = term WHERE freq >= 3 AND abs(valence) >= 1)"
add("lexicon_stats", lambda s, d: lexicon.lexicon_stats(tokens(s, d), lexicon.induce_lexicon(tokens(s, d), valence(s))),
    f"WITH {LEXS} SELECT (SELECT count(*) FROM tok) AS tokens, (SELECT count(*) FROM fq) AS vocabulary, count(*) AS kept, count(*) FILTER (valence > 0) AS positive, count(*) FILTER (valence < 0) AS negative, CASE WHEN count(*) FILTER (valence > 0) > 0 AND count(*) FILTER (valence < 0) > 0 THEN 'valid' ELSE 'invalid' END AS status FROM lx")


# Aggregations.
query(f"WITH {CELLS} SELECT feature, count(*) FILTER (value <> 0) AS nonzero, round(100.0::DOUBLE * count(*) FILTER (value <> 0) / count(*), 6) AS percent, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS max, count(*) FILTER (value IS NULL) AS missing FROM cells GROUP BY 1", "agg_feature_coverage")(lambda s, d: measure.feature_coverage(cells(s, d)))
_sh = lambda k: f"round(100.0::DOUBLE * count(*) FILTER (active AND split = '{k}') / count(*) FILTER (split = '{k}'), 6) AS {k}_percent"
query(f"WITH {CELLS}, {MODS}, {SEL}, {POSTS}, a AS (SELECT doc_id, module, split, sum(abs(value)) > 0 AS active FROM cells JOIN mods USING (feature) JOIN posts USING (doc_id) GROUP BY ALL) SELECT module, any_value((SELECT count(*) FROM mods m WHERE m.module = a.module)) AS features, any_value((SELECT count(*) FROM mods m SEMI JOIN sel USING (feature) WHERE m.module = a.module)) AS selected, count(*) FILTER (active) AS active, round(100.0::DOUBLE * count(*) FILTER (active) / count(*), 6) AS percent, {_sh('train')}, {_sh('val')}, {_sh('test')} FROM a GROUP BY 1", "agg_module_coverage")(
    lambda s, d: measure.module_coverage(with_split(s, d), X.selection(s)))
query(f"WITH {CELLS}, {LAB}, n AS (SELECT feature, label, count(*) AS n FROM cells JOIN lab USING (doc_id) WHERE value <> 0 GROUP BY ALL), p AS (SELECT feature, n::DOUBLE / sum(n) OVER (PARTITION BY feature) AS p FROM n) SELECT feature, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1", "agg_label_entropy")(
    lambda s, d: measure.label_entropy(labelled(s, d).where("value <> 0"), "feature"))
add("agg_overall_activation", lambda s, d: features(s, d).withColumn("split", X.split_of(F.col("doc_id"))).rollup("split").agg(F.count("*").alias("posts"), F.count_if(F.col("ont_count") > 0).alias("active"), F.count_if((F.col("ont_alpha") != 0) | (F.col("ont_gamma") != 0)).alias("selected")),
    f"WITH {FEAT} SELECT CASE doc_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, count(*) AS posts, count(*) FILTER (ont_count > 0) AS active, count(*) FILTER (ont_alpha <> 0 OR ont_gamma <> 0) AS selected FROM feat GROUP BY ROLLUP (1)")
@query(f"WITH {LAB}, sp AS (SELECT CASE doc_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, label FROM lab) SELECT split, label, n, coalesce(round(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY split), 0), 6), 0) AS percent FROM (SELECT g.split, l::INTEGER AS label, count(sp.label) AS n FROM (VALUES ('train'), ('val'), ('test')) g(split) CROSS JOIN range(3) r(l) LEFT JOIN sp ON sp.label = l AND sp.split = g.split GROUP BY ALL)")
def agg_label_distribution(s, d):
    """Every label in every split, also where there is none."""
    every = s.range(3).select(F.col("id").cast("int").alias("label"), F.explode(F.array(*[F.lit(x) for x in ("train", "val", "test")])).alias("split"))
    n = X.labels(s, d).groupBy(X.split_of(F.col("doc_id")).alias("split"), "label").agg(F.count("*").alias("n"))
    out = every.join(n, ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy("split"))), F.lit(0.0)))


query(f"WITH {OVERALL} SELECT condition, round_even(avg(macro_f1), 4) AS mean, round_even(stddev_samp(macro_f1), 4) AS std, count(*) AS n_seeds FROM ov GROUP BY 1", "agg_seed_summary")(lambda s, d: measure.seed_summary(overall(s, d), ["condition"]))
NUM = "min({0}) AS min, quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.5) AS median, avg({0}) AS mean, quantile_cont({0}, 0.75) AS q3, max({0}) AS max, stddev_pop({0}) AS std"
query(f"WITH {CELLS} SELECT feature, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(mean, 6) AS mean, round(q3, 6) AS q3, round(max, 6) AS max, round(std, 6) AS std FROM (SELECT feature, {NUM.format('value')} FROM cells GROUP BY 1)", "agg_numeric_summary")(lambda s, d: measure.numeric_summary(cells(s, d), "value", ["feature"]))
query(f"WITH {VAL}, {FREQ}, {GRID_SQL}, k AS (SELECT variant, term FROM fq JOIN val ON token = term JOIN gr ON freq >= min_freq AND abs(valence) >= min_valence) SELECT term, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(DISTINCT variant) FROM k), 6) AS share FROM k GROUP BY 1", "agg_feature_stability")(
    lambda s, d: (lambda k: k.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(k.agg(F.count_distinct("variant").alias("v"))), F.lit(True)).select("term", "n", (F.col("n") / F.col("v")).alias("share")))(QUERIES["theta_lexicon_grid"](s, d)))
query(f"WITH {PRED}, g AS (SELECT DISTINCT condition, seed, l FROM pred, range(3) r(l)), c AS (SELECT g.condition, g.seed, g.l AS label, count(p.id) AS n FROM g LEFT JOIN pred p ON p.condition = g.condition AND p.seed = g.seed AND p.y_pred = g.l GROUP BY ALL), sh AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY condition, seed) AS share FROM c) SELECT condition, label::INTEGER AS label, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS std FROM sh GROUP BY 1, 2", "agg_prediction_share")(
    lambda s, d: matrix(s, d).groupBy(*KEYS, F.col("y_pred").alias("label")).agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS))).groupBy("condition", "label").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("std")))
add("count_distinct_posts", lambda s, d: trace(s, d).where("feature is not null").agg(F.count_distinct("id").alias("posts"), F.count_distinct("id", "concept").alias("assertions")), f"WITH {TRACE} SELECT count(DISTINCT id) AS posts, (SELECT count(*) FROM (SELECT DISTINCT id, concept FROM tm WHERE concept IS NOT NULL)) AS assertions FROM tm WHERE feature IS NOT NULL")
query(f"WITH {LAB} SELECT label, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM lab GROUP BY label", "class_weights")(lambda s, d: models.class_weights(X.labels(s, d)))

# Order.
add("pseudonym_authors", lambda s, d: tables.pseudonym_authors(X.posts(s, d)), f"WITH {POSTS} SELECT author, 'author_' || lpad(CAST(row_number() OVER (ORDER BY author) AS VARCHAR), 4, '0') AS author_id FROM (SELECT DISTINCT author FROM posts)")
ANOVA = CELLS + ", " + LAB + """, tl AS (SELECT feature, label, value FROM cells JOIN lab USING (doc_id) WHERE doc_id % 5 < 3), g AS (SELECT feature, label, count(*) AS c, avg(value) AS m, var_pop(value) * count(*) AS w FROM tl GROUP BY ALL),
gm AS (SELECT feature, avg(value) AS gm FROM tl GROUP BY 1), an AS (SELECT feature, count(*) AS k, sum(c)::BIGINT AS n, sum(c * (m - gm) ** 2) / (count(*) - 1) AS msb, sum(w) AS sw FROM g JOIN gm USING (feature) GROUP BY 1),
af AS (SELECT feature, k, n, CASE WHEN sw > 1e-12 THEN msb / (sw / (n - k)) END AS f FROM an)"""
anova = lambda s, d: measure.anova_f(labelled(s, d).where("doc_id % 5 < 3"))
query(f"WITH {ANOVA} SELECT feature, k, n, round(f, 6) AS f FROM af", "anova_f")(anova)
query(None, "anova_p")(lambda s, d: measure.anova_p(anova(s, d)))
query(None, "select_features")(lambda s, d: measure.select_features(anova(s, d)))
query(f"WITH {ANOVA} SELECT feature, row_number() OVER (ORDER BY f DESC NULLS LAST, feature) AS rank FROM af", "rank_features")(lambda s, d: anova(s, d).select("feature", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("f", 9)), "feature")).alias("rank")))
query(f"WITH {VAL}, {FREQ}, {GRID_SQL}, k AS (SELECT term, count(*) AS n FROM fq JOIN val ON token = term JOIN gr ON freq >= min_freq AND abs(valence) >= min_valence GROUP BY 1) SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM k", "rank_stability")(
    lambda s, d: QUERIES["theta_lexicon_grid"](s, d).groupBy("term").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "term"))))
add("build_vocab", lambda s, d: tables.build_vocab(tokens(s, d)), f"WITH {VOC} SELECT token, freq, index FROM vo")
add("max_len_p95", lambda s, d: docs(s, d).select(T.word_count(F.lower("text")).alias("n")).agg(F.percentile("n", F.lit(0.95)).cast("int").alias("max_len")), f"WITH {FEAT} SELECT trunc(quantile_cont(n_words, 0.95))::INTEGER AS max_len FROM feat")
add("trace_row_number", lambda s, d: (lambda t: t.select("id", "feature", (F.row_number().over(Window.partitionBy("id").orderBy("feature"))).alias("row")))(trace(s, d).where("feature is not null")), f"WITH {TRACE} SELECT id, feature, row_number() OVER (PARTITION BY id ORDER BY feature) AS row FROM tm WHERE feature IS NOT NULL")
add("limit_examples", lambda s, d: QUERIES["anti_missing_ids"](s, d).orderBy("id").limit(20), f"WITH {POSTS} SELECT id FROM posts WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) ORDER BY id LIMIT 20")

# Sets.
A_SQL, B2_SQL = "SELECT DISTINCT doc_id FROM feat WHERE ont_alpha > 0", "SELECT DISTINCT doc_id FROM feat WHERE ont_gamma > 0"
alpha = lambda s, d: features(s, d).where("ont_alpha > 0").select("doc_id")
gamma = lambda s, d: features(s, d).where("ont_gamma > 0").select("doc_id")
add("set_symmetric_diff", lambda s, d: tables.set_symmetric_diff(alpha(s, d), gamma(s, d), "doc_id"), f"WITH {FEAT} SELECT doc_id, 'left' AS side FROM ({A_SQL} EXCEPT {B2_SQL}) UNION ALL SELECT doc_id, 'right' FROM ({B2_SQL} EXCEPT {A_SQL})")
add("set_except", lambda s, d: alpha(s, d).exceptAll(gamma(s, d)), f"WITH {FEAT} {A_SQL} EXCEPT ALL {B2_SQL}")
add("union_frames", lambda s, d: files.union_rows([docs(s, d).select("doc_id", "lang"), X.labels(s, d)]), f"WITH {LAB} SELECT doc_id, lang, NULL::INTEGER AS label FROM documents UNION ALL SELECT doc_id, NULL, label FROM lab")
add("distinct_triples", lambda s, d: triples(s, d).groupBy("p").agg(F.count("*").alias("n")), f"WITH {TRIPLES} SELECT p, count(*) AS n FROM tr GROUP BY 1")

# Graph.
add("post_iri", lambda s, d: X.posts(s, d).select("id", graph.iri("post", F.col("id")).alias("iri")), f"WITH {POSTS} SELECT id, {IRI('post', 'id')} AS iri FROM posts")
add("label_iri", lambda s, d: X.labels(s, d).select("doc_id", graph.label_iri(F.col("label")).alias("iri")), f"WITH {LAB} SELECT doc_id, '{BASE}' || CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS iri FROM lab")
add("triples_from_posts", triples, f"WITH {TRIPLES} SELECT * FROM tr")
ASSERT = CELLS + ", " + MODS + f", ca AS (SELECT DISTINCT {IRI('post', 'CAST(doc_id AS VARCHAR)')} AS s, 'about' AS p, '{BASE}' || concept AS o, 'iri' AS o_kind, NULL AS o_datatype FROM cells JOIN mods USING (feature) WHERE value <> 0 AND concept IS NOT NULL)"
assertions = lambda s, d: graph.concept_assertions(id_cells(s, d))
add("concept_assertions", assertions, f"WITH {ASSERT} SELECT * FROM ca")
query(f"WITH {TRACE} SELECT id, split, post_iri, feature, module, concept, round(value, 6) AS value FROM tm", "trace_map")(trace)
add("graph_report", lambda s, d: triples(s, d).select("s", "p").union(assertions(s, d).select("s", "p")).agg(F.count("*").alias("triples"), F.count_if(F.col("p") == "about").alias("assertions"), F.count_distinct(F.when(F.col("p") == "identifier", F.col("s"))).alias("posts")),
    f"WITH {TRIPLES}, {ASSERT} SELECT (SELECT count(*) FROM tr) + (SELECT count(*) FROM ca) AS triples, (SELECT count(*) FROM ca) AS assertions, (SELECT count(DISTINCT s) FROM tr WHERE p = 'identifier') AS posts")
_iri = lambda x: f"{BASE}{x}" if x[0].isupper() else x
SCH = "sch(p, s, o) AS (VALUES " + ", ".join(f"('{p}', '{_iri(a)}', '{_iri(b)}')" for a, p, b in X.SCHEMA) + f""" UNION ALL SELECT 'rdfs:subClassOf', '{BASE}nation_' || n_nationkey, '{BASE}region_' || n_regionkey FROM nation
  UNION ALL SELECT 'rdfs:subClassOf', '{BASE}region_' || r_regionkey, '{BASE}Place' FROM region)"""
CLO = SCH + ", rule(a, b, c) AS (VALUES " + ", ".join(map(str, inference.RULES)) + "), cl AS (SELECT * FROM sch UNION SELECT c, cl.s, sch.o FROM cl JOIN rule ON a = cl.p JOIN sch ON sch.p = b AND sch.s = cl.o)"


def entailed_sql(facts: str) -> str:
    return f"""SELECT f.s, cl.o AS p, f.o, o_kind, o_datatype FROM {facts} f JOIN cl ON cl.p = 'rdfs:subPropertyOf' AND cl.s = f.p
UNION SELECT f.s, 'rdf:type', cl.o, 'iri', NULL FROM {facts} f JOIN cl ON cl.p = 'rdfs:domain' AND cl.s = f.p
UNION SELECT f.o, 'rdf:type', cl.o, 'iri', NULL FROM {facts} f JOIN cl ON cl.p = 'rdfs:range' AND cl.s = f.p WHERE o_kind = 'iri'
UNION SELECT f.s, 'rdf:type', cl.o, 'iri', NULL FROM {facts} f JOIN cl ON cl.p = 'rdfs:subClassOf' AND cl.s = f.o WHERE f.p = 'rdf:type'"""


CUSTOMERS = f"cu AS (SELECT '{BASE}customer_' || c_custkey AS s, 'rdf:type' AS p, '{BASE}nation_' || c_nationkey AS o, 'iri' AS o_kind, NULL AS o_datatype FROM customer), fa AS (SELECT * FROM tr UNION ALL SELECT * FROM cu)"
facts = lambda s, d: triples(s, d).union(X.customer_triples(s, d))
add("rdfs_subclass_closure", lambda s, d: inference.closed(X.schema(s, d)), f"WITH RECURSIVE {CLO} SELECT p, s, o FROM cl")
add("rdfs_domain_range", lambda s, d: inference.inferred(facts(s, d), X.schema(s, d).where(F.col("p") != graph.SUBCLASS), False).where(F.col("p") == graph.RDF_TYPE).select("s", "p", "o").distinct(),
    f"WITH RECURSIVE {TRIPLES}, {CUSTOMERS}, {CLO}, e AS ({entailed_sql('fa')}) SELECT DISTINCT s, p, o FROM e WHERE p = 'rdf:type'".replace("SELECT * FROM sch UNION", "SELECT * FROM sch WHERE p <> 'rdfs:subClassOf' UNION").replace("sch.p = b AND", "sch.p = b AND sch.p <> 'rdfs:subClassOf' AND"))
add("rdfs_type_inherit", lambda s, d: inference.inferred(facts(s, d), X.schema(s, d)), f"WITH RECURSIVE {TRIPLES}, {CUSTOMERS}, {CLO} SELECT * FROM fa UNION {entailed_sql('fa')}")
query(f"WITH {TRACE}, {SEL} SELECT id, feature, sel.feature IS NOT NULL AS used FROM tm LEFT JOIN sel USING (feature)", "trace_join_used")(lambda s, d: trace(s, d).join(X.selection(s).select("feature", F.lit(True).alias("used")), "feature", "left").select("id", "feature", F.coalesce("used", F.lit(False)).alias("used")))

# Constraint checks, on a graph in which each finds some that pass and some that fail.
_lab = f"CASE WHEN doc_id % 41 = 0 THEN '{BASE}Mixed' WHEN label = 0 THEN '{BASE}Negative' WHEN label = 1 THEN '{BASE}Neutral' WHEN label = 2 THEN '{BASE}Positive' END"
_every = lambda k, yes, no="NULL": f"CASE WHEN doc_id % {k} = 0 THEN {yes} ELSE {no} END"
_tenth = lambda x: f"CAST(({x}) / 10.0 AS DECIMAL(3, 1))::VARCHAR"
DAMAGED = LAB + ", dd AS (SELECT d.*, lab.label FROM documents d LEFT JOIN lab USING (doc_id)), dg AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{BASE}post_' || doc_id AS s, {p} AS p, {o} AS o, {kind} AS o_kind, {dt} AS o_datatype FROM dd" for p, o, kind, dt in [
        ("'rdf:type'", f"'{BASE}Post'", "'iri'", "NULL"), ("'identifier'", _every(31, "'0'", _every(23, "'ID ' || doc_id", "doc_id::VARCHAR")), "'literal'", "'xsd:string'"),
        ("'created'", _every(13, "NULL", "'2024-01-01T00:00:00'"), "'literal'", _every(11, "'xsd:date'", "'xsd:dateTime'")), ("'author'", f"'{BASE}author_' || (doc_id % 97)", _every(29, "'literal'", "'iri'"), _every(29, "'xsd:string'")),
        ("'topic'", _every(37, "NULL", f"'{BASE}topic_' || source"), "'iri'", "NULL"), ("'language'", "lang", "'literal'", "'xsd:string'"), ("'language'", _every(17, "'xx'"), "'literal'", "'xsd:string'"),
        ("'length'", "length(trim(text))::VARCHAR", "'literal'", _every(19, "'xsd:string'", "'xsd:integer'")), ("'label'", _lab, "'iri'", "NULL"),
        ("'probPos'", _every(43, "'1.5'", _tenth("doc_id % 5")), "'literal'", "'xsd:decimal'"), ("'probNeu'", _tenth("doc_id % 4"), "'literal'", "'xsd:decimal'"),
        ("'probNeg'", _tenth("10 - doc_id % 5 - doc_id % 4 + (doc_id % 7 = 0)::INTEGER"), "'literal'", "'xsd:decimal'"), ("'intensity'", _every(2, _every(6, "'1.2'", "'0.5'")), "'literal'", "'xsd:decimal'"),
        ("'term'", _every(3, "'x'"), "'literal'", "'xsd:string'"), (_every(2, "'about'", "'belongs'"), f"'{BASE}' || {X.CONCEPTS}[doc_id % 4 + 1]", "'iri'", "NULL"),
    ]) + f""" UNION ALL SELECT DISTINCT '{BASE}author_' || (doc_id % 97), 'rdf:type', '{BASE}Author', 'iri', NULL FROM dd UNION ALL SELECT DISTINCT '{BASE}topic_' || source, 'rdf:type', '{BASE}Topic', 'iri', NULL FROM dd WHERE length(source) % 2 = 0
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{BASE}{a}', '{p}', '{o if ':' in o else BASE + o}', '{k}', NULL)" for a, p, o, k in X.FIXED)}) v) WHERE o IS NOT NULL)"""  # fmt: skip
damaged_graph = lambda s, d: stage(s, X.damaged_triples(s, d))
SHAPES = shapes.standard()


def results_sql(g: str, shape: shapes.Shape, component: str) -> str:
    """Focus and value of each result of a check, over the triples of a table."""
    focus_, path = f"(SELECT DISTINCT s FROM {g} WHERE p = 'rdf:type' AND o = '{shape.target}')", "(" + ", ".join(f"'{p}'" for p in shape.path) + ")"
    mine = f"(SELECT * FROM {g} WHERE p IN {path} AND s IN {focus_})"
    count = f"(SELECT f.s, count(t.s) AS n FROM {focus_} f LEFT JOIN {g} t ON t.s = f.s AND t.p IN {path} GROUP BY 1)"
    typed = lambda cls: f"SELECT s FROM {g} WHERE p = 'rdf:type' AND o = '{cls}'"
    values = lambda where: f"SELECT s, o FROM {mine} m WHERE {where}"
    if component == "minCount":
        return f"SELECT s, n::VARCHAR AS o FROM {count} WHERE n < {shape.least}"
    if component == "maxCount":
        return f"SELECT s, n::VARCHAR AS o FROM {count} WHERE n > {shape.most}"
    if component == "datatype":
        return values(f"coalesce(o_datatype, '') <> '{shape.datatype}'")
    if component == "pattern":
        return values(f"NOT regexp_matches(o, '{shape.pattern}')")
    if component == "in":
        return values("o NOT IN (" + ", ".join(f"'{x}'" for x in shape.one_of) + ")")
    if component == "nodeKind":
        return values("o_kind <> 'iri'")
    if component == "range":
        low, high = ("-1e30" if shape.low is None else shape.low), ("1e30" if shape.high is None else shape.high)
        return values(f"TRY_CAST(o AS DOUBLE) IS NULL OR TRY_CAST(o AS DOUBLE) < {low} OR TRY_CAST(o AS DOUBLE) > {high}")
    if component == "class":
        return values(f"o_kind <> 'iri' OR o NOT IN ({typed(shape.cls)})")
    if component == "scheme":
        return values(f"o_kind <> 'iri' OR o NOT IN ({typed('skos:Concept')}) OR o NOT IN (SELECT s FROM {g} WHERE p = 'skos:inScheme' AND o = '{shape.scheme}')")
    if component == "unique":
        return f"SELECT DISTINCT s, o FROM {mine} WHERE o IN (SELECT o FROM {g} WHERE p IN {path} GROUP BY o HAVING count(DISTINCT s) > 1)"
    if component == "implies":
        return f"SELECT DISTINCT s, NULL AS o FROM {mine} WHERE s NOT IN (SELECT s FROM {g} WHERE p = '{shape.implies}')"
    probs = f"(SELECT s, max(o::DECIMAL(18, 6)) FILTER (p = 'probPos') AS pp, max(o::DECIMAL(18, 6)) FILTER (p = 'probNeu') AS pn, max(o::DECIMAL(18, 6)) FILTER (p = 'probNeg') AS pg, max(l) AS l FROM (SELECT s, p, CASE WHEN p LIKE 'prob%' THEN o END AS o, CASE WHEN p = 'label' THEN o END AS l FROM {g}) WHERE s IN {focus_} GROUP BY 1)"
    if component == "probSum":
        return f"SELECT s, NULL AS o FROM {probs} WHERE abs(pp + pn + pg - 1) > 0.02"
    return f"SELECT s, l AS o FROM {probs} WHERE pp IS NOT NULL AND pn IS NOT NULL AND pg IS NOT NULL AND l <> CASE WHEN pp >= pn AND pp >= pg THEN '{BASE}Positive' WHEN pn >= pp AND pn >= pg THEN '{BASE}Neutral' ELSE '{BASE}Negative' END"


def found_sql(component: str, path: str) -> str:
    """All results of one check of the standard shapes on the damaged graph."""
    shape = next(x for x in SHAPES if component in x.components and "|".join(x.path) == path)
    return f"WITH {DAMAGED} SELECT s AS focus, '{path}' AS path, o AS value, '{component}' AS component, '{shape.severity}' AS severity, '{component} of {path}' AS message FROM ({results_sql('dg', shape, component)})"


def check(name, component, path, f, cls=f"{BASE}Post"):
    add(name, lambda s, d: (lambda t: f(t, graph.targets(t, cls)))(damaged_graph(s, d)), found_sql(component, path))


check("chk_min_count", "minCount", "topic", lambda t, o: graph.chk_count(t, o, "topic", least=1))
check("chk_max_count", "maxCount", "language", lambda t, o: graph.chk_count(t, o, "language", most=1))
check("chk_datatype", "datatype", "created", lambda t, o: graph.chk_datatype(t, o, "created", "xsd:dateTime"))
check("chk_pattern", "pattern", "identifier", lambda t, o: graph.chk_pattern(t, o, "identifier", "^[0-9a-z]+$"))
check("chk_in", "in", "language", lambda t, o: graph.chk_in(t, o, "language", ["es", "en"]))
check("chk_node_kind", "nodeKind", "author", lambda t, o: graph.chk_node_kind(t, o, "author"))
check("chk_class", "class", "label", lambda t, o: graph.chk_class(t, o, "label", f"{BASE}Sentiment"))
check("chk_range", "range", "length", lambda t, o: graph.chk_range(t, o, "length", 40, severity="Warning"))
add("chk_prob_sum", lambda s, d: graph.chk_prob_sum(damaged_graph(s, d)).select("focus", "component"), f"SELECT focus, component FROM ({found_sql('probSum', 'probPos|probNeu|probNeg')})")
add("chk_label_argmax", lambda s, d: graph.chk_label_argmax(damaged_graph(s, d)).select("focus", "value"), f"SELECT focus, value FROM ({found_sql('argmax', 'probPos|probNeu|probNeg')})")
add("chk_implies", lambda s, d: graph.chk_implies(damaged_graph(s, d), "term", "label").select("focus", "component"), f"SELECT focus, component FROM ({found_sql('implies', 'term')})")
IN_DOMAIN = lambda t: graph.targets(t, "skos:Concept").join(t.where(f"p = 'skos:inScheme' and o = '{BASE}Domain'").select("s"), "s", "left_semi").select(F.col("s").alias("o"))
add("chk_concept_scheme", lambda s, d: (lambda t: graph.chk_scheme(t, ["about", "belongs"], IN_DOMAIN(t)))(damaged_graph(s, d)), found_sql("scheme", "about|belongs"))
_concept = next(x for x in SHAPES if x.target == "skos:Concept")
add("chk_concept_has_scheme", lambda s, d: (lambda t, o: graph.chk_count(t, o, "skos:inScheme", least=1).union(graph.chk_node_kind(t, o, "skos:inScheme")))(*(lambda t: (t, graph.targets(t, "skos:Concept")))(damaged_graph(s, d))),
    f"WITH {DAMAGED} " + " UNION ALL ".join(f"SELECT s AS focus, 'skos:inScheme' AS path, o AS value, '{c}' AS component, 'Violation' AS severity, '{c} of skos:inScheme' AS message FROM ({results_sql('dg', _concept, c)})" for c in _concept.components))


def conformance_report(s, d):
    """Every check on the graph of posts and on the damaged one, without and with inference."""
    sch, out = X.schema(s, d), []
    for name, t in (("posts", stage(s, triples(s, d))), ("damaged", damaged_graph(s, d))):
        out += [shapes.report(t, SHAPES, sch if on else None).withColumns({"graph": F.lit(name), "inference": F.lit(on)}) for on in (False, True)]
    return reduce(DataFrame.union, out)


add("conformance_report", conformance_report, f"WITH RECURSIVE {TRIPLES}, {DAMAGED.replace(LAB + ', ', '')}, {CLO}, tx AS (SELECT * FROM tr UNION {entailed_sql('tr')}), dx AS (SELECT * FROM dg UNION {entailed_sql('dg')}) " + " UNION ALL ".join(
    f"SELECT '{name}' AS graph, {on} AS inference, '{x.target}' AS target, '{'|'.join(x.path)}' AS path, '{c}' AS component, '{x.severity}' AS severity, (SELECT count(*) FROM ({results_sql(g, x, c)})) AS results"
    for name, on, g in (("posts", "false", "tr"), ("posts", "true", "tx"), ("damaged", "false", "dg"), ("damaged", "true", "dx")) for x in SHAPES for c in x.components))

# Audits.
query(f"WITH {FEAT}, {POS} SELECT split, pos, {', '.join(f'round({f}, 6) AS {f}' for f in X.SELECTED)} FROM feat JOIN pos USING (doc_id)", "input_matrix")(lambda s, d: features(s, d).join(positions(s, d), "doc_id").select("split", "pos", *X.SELECTED))
query(f"WITH {CELLS}, t AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM cells WHERE doc_id % 5 < 3 GROUP BY 1) SELECT doc_id, feature, round((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM cells JOIN t USING (feature)", "standardize_train")(lambda s, d: measure.standardize(cells(s, d).withColumn("split", X.split_of(F.col("doc_id")))).select("doc_id", "feature", "z"))


# Evaluation.
add("confusion_matrix", matrix, f"WITH {MATRIX} SELECT condition, seed, y_true::INTEGER AS y_true, y_pred::INTEGER AS y_pred, n FROM cm")
query(f"WITH {CLASSES} SELECT condition, seed, label::INTEGER AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM pc", "metrics_per_class")(lambda s, d: per_class(s, d).drop("said", "hit"))
query(f"WITH {OVERALL} SELECT condition, seed, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM ov", "metrics_overall")(overall)
query(f"WITH {MATRIX}, sh AS (SELECT *, coalesce(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY condition, seed, y_true), 0), 0) AS s FROM cm) SELECT y_true::INTEGER AS y_true, y_pred::INTEGER AS y_pred, round(avg(s) FILTER (condition = 'ENR') - avg(s) FILTER (condition = 'BSL'), 6) AS delta FROM sh GROUP BY 1, 2", "confusion_delta")(lambda s, d: measure.confusion_delta(matrix(s, d)))

# Sensitivity.
EXPANDED = ([2, 3, 5, 7, 10], [1, 2, 3, 5, 8], [0.25, 0.5, 1.0, 1.5, 2.0])


# Models.
def model_rows(s, d):
    """Written once, in a part for each core: fitting reads its rows many times."""
    rows = docs(s, d).select("doc_id", "text").join(X.labels(s, d), "doc_id")
    rows = enrich.concept_features(rows, X.VOCABULARY, X.COMPOUNDS, X.CONCEPTS, keep=("text", "label"))
    rows = rows.repartition(s.sparkContext.defaultParallelism)
    return stage(s, rows.withColumn("split", X.split_of(F.col("doc_id"))).withColumn("id", F.col("doc_id").cast("string")))


# Files in and out, read back.
query(f"WITH {POS} SELECT id, split, pos FROM pos", "scan_split")(lambda s, d: tables.read_split(s, tables.write_split(positions(s, d), files.scratch(s))))


@query(f"WITH {SCORES}, vo AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', {p})" for c, t, p in X.VOCABULARY) + ") v(concept, term, term_pos)) SELECT vo.concept, vo.term, vo.term_pos, count(doc_id) FILTER (hits > 0) AS texts FROM vo LEFT JOIN sc USING (concept, term) GROUP BY ALL")
def scan_vocabulary(s, d):
    """A vocabulary file, and in how many texts each of its terms stands."""
    p = files.write_csv(X.vocabulary(s), files.scratch(s))
    terms = s.read.schema("concept string, term string, term_pos int").csv(p, header=True)
    hits = dictionary.term_matches(docs(s, d), terms).where("hits > 0")
    return terms.join(hits.groupBy("concept", "term").agg(F.count("*").alias("texts")), ["concept", "term"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))


RUNS = [("rule", c, n) for c in ("BSL", "ENR") for n in (42, 123, 2024)]


@query(f"WITH {PRED} SELECT id, split, y_true, y_pred, condition, seed FROM pred")
def scan_predictions(s, d):
    """One folder for each run; every run has to be there."""
    p = files.scratch(s)
    rows = predictions(s, d).withColumn("model", F.lit("rule")).select("id", "split", "y_true", "y_pred", "model", "condition", "seed")
    rows.withColumn("run", F.concat_ws("_", "model", "condition", "seed")).write.option("header", True).partitionBy("run").csv(p)
    return files.read_predictions(s, p, RUNS).drop("model")


# Runs with faults: rows dropped (ENR, 123), labels changed (BSL, 2024), rows repeated (ENR, 2024), unknown ids (BSL, 42).
def damaged(s, d):
    p = predictions(s, d).withColumn("n", F.col("id").cast("long"))
    at = lambda c, n, r: (F.col("condition") == c) & (F.col("seed") == n) & (F.col("n") % 50 == r)
    p = p.where(~at("ENR", 123, 4)).withColumn("y_true", F.when(at("BSL", 2024, 9), (F.col("y_true") + 1) % 3).otherwise(F.col("y_true")))
    return p.union(p.where(at("ENR", 2024, 14))).withColumn("id", F.when(at("BSL", 42, 19), F.concat(F.lit("x"), "id")).otherwise(F.col("id"))).drop("n")


DPRED = PRED + """, d1 AS (SELECT id, split, CASE WHEN condition = 'BSL' AND seed = 2024 AND id::BIGINT % 50 = 9 THEN (y_true + 1) % 3 ELSE y_true END AS y_true, condition, seed, y_pred FROM pred WHERE NOT (condition = 'ENR' AND seed = 123 AND id::BIGINT % 50 = 4)),
d2 AS (SELECT * FROM d1 UNION ALL SELECT * FROM d1 WHERE condition = 'ENR' AND seed = 2024 AND id::BIGINT % 50 = 14),
dp AS (SELECT CASE WHEN condition = 'BSL' AND seed = 42 AND id::BIGINT % 50 = 19 THEN 'x' || id ELSE id END AS id, split, y_true, condition, seed, y_pred FROM d2)"""
wanted = lambda s, d: positions(s, d).select("id", "split").join(X.labels(s, d).select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
add("reconcile_predictions", lambda s, d: audit.reconcile_predictions(damaged(s, d), wanted(s, d), X.labels(s, d).select(F.col("doc_id").cast("string").alias("id"), "label")),
    f"WITH {DPRED}, tx AS (SELECT CAST(doc_id AS VARCHAR) AS id, label FROM lab WHERE doc_id % 5 = 4) SELECT condition, seed, count(*) AS rows, count(*) - count(DISTINCT dp.id) AS duplicates, count(*) FILTER (tx.id IS NULL) AS outside, count(*) FILTER (label IS DISTINCT FROM y_true) AS label_differs, (SELECT count(*) FROM tx) - count(DISTINCT tx.id) AS missing FROM dp LEFT JOIN tx ON dp.id = tx.id GROUP BY ALL")
add("support_check", lambda s, d: measure.support_check(damaged(s, d), X.labels(s, d).where("doc_id % 5 = 4").groupBy("label").agg(F.count("*").alias("n")), KEYS),
    f"WITH {DPRED}, ex AS (SELECT label, count(*) AS n FROM lab WHERE doc_id % 5 = 4 GROUP BY 1), ru AS (SELECT DISTINCT condition, seed, label, ex.n AS expected FROM dp, ex), ob AS (SELECT condition, seed, y_true AS label, count(*) AS n FROM dp GROUP BY ALL) SELECT condition, seed, label, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM ru FULL JOIN ob USING (condition, seed, label)")
add("summary_complete", lambda s, d: s.createDataFrame([(c, n) for c in ("BSL", "ENR", "FULL") for n in (42, 123, 2024)], "condition string, seed int").join(damaged(s, d).where("y_true <> y_pred").groupBy(*KEYS).agg(F.count("*").alias("errors")), KEYS, "left").withColumn("there", F.col("errors").isNotNull()),
    f"WITH {DPRED}, er AS (SELECT condition, seed, count(*) AS errors FROM dp WHERE y_true <> y_pred GROUP BY ALL), wa AS (SELECT * FROM (VALUES ('BSL'), ('ENR'), ('FULL')) a(condition), (VALUES (42), (123), (2024)) b(seed)) SELECT condition, seed, errors, errors IS NOT NULL AS there FROM wa LEFT JOIN er USING (condition, seed)")
SPLIT_SHA = "sequence of the ids, in blocks of 100000 positions"
TREE = lambda rows, by, v, block=100000: f"(SELECT {by}, sha256(string_agg(sha, chr(10) ORDER BY b)) AS sha256 FROM (SELECT {by}, pos // {block} AS b, sha256(string_agg({v}, chr(10) ORDER BY pos)) AS sha FROM {rows} GROUP BY ALL) GROUP BY {by})"
query(f"WITH {POS} SELECT split, sha256 FROM {TREE('pos', 'split', 'id')}", "sequence_sha256")(lambda s, d: audit.sequence_sha256(positions(s, d), "split", "id"))
query(f"WITH {POS} SELECT split, sha256 FROM {TREE('pos', 'split', 'id', 100)}", "sequence_sha256_blocks")(lambda s, d: audit.sequence_sha256(positions(s, d), "split", "id", block=100))
query(r"""SELECT doc_id, len(w)::BIGINT AS n, sha256(array_to_string(w, chr(10))) AS sha256 FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0""", "sequence_sha256_plain")(
    lambda s, d: fingerprint.row_sequences(docs(s, d).select("doc_id", T.words(F.lower("text")).alias("w")), "doc_id", "w"))

# Matrices with nulls, hashed as little-endian doubles: SQL works their bits out from exponent and fraction.
MATRIX_BLOCK = 100
_NULL = f"{fingerprint.NULL_BITS['<f8']}::HUGEINT"
_abs_e = "floor(log2(abs(x)))"
_e = f"({_abs_e} - CASE WHEN pow(2.0::DOUBLE, {_abs_e}) > abs(x) THEN 1 WHEN pow(2.0::DOUBLE, {_abs_e} + 1) <= abs(x) THEN -1 ELSE 0 END)"
_bits = f"CASE WHEN x IS NULL THEN {_NULL} WHEN x = 0 THEN 0::HUGEINT ELSE (CASE WHEN x < 0 THEN 9223372036854775808::HUGEINT ELSE 0 END) + ({_e} + 1023)::HUGEINT * 4503599627370496 + ((abs(x) / pow(2.0::DOUBLE, {_e}) - 1) * 4503599627370496)::HUGEINT END"
_le = " || ".join(f"h[{i}:{i + 1}]" for i in range(15, 0, -2))


def leaves_sql(name: str, cells: str) -> str:
    """CTEs name_h, name: the leaves of the matrix in cells (split, pos, k, x)."""
    return f"""{name}_h AS (SELECT split, pos, pos // {MATRIX_BLOCK} AS block, k, {_le} AS le FROM (SELECT split, pos, k, format('{{:016x}}', ({_bits})::UBIGINT) AS h FROM {cells})),
{name}_b AS (SELECT split, block, count(DISTINCT pos) AS n_rows, min(pos) AS first, max(pos) AS last, string_agg(le, '' ORDER BY pos, k) AS body FROM {name}_h GROUP BY ALL),
{name} AS (SELECT split, block, n_rows, first, last, sha256(('{{"block":' || block || ',"dtype":"<f8","shape":[' || n_rows || ',{len(X.FEATURES)}]}}' || chr(10))::BLOB || unhex(body)) AS sha256 FROM {name}_b)"""


def root_sql(name: str) -> str:
    up = f"(SELECT split, block AS nd, sha256 FROM {name})"
    for _ in range(fingerprint.LEVELS):
        up = f"(SELECT split, nd // {fingerprint.FAN} AS nd, sha256(string_agg(sha256, chr(10) ORDER BY nd)) AS sha256 FROM {up} GROUP BY ALL)"
    head = f"""'{{"block":{MATRIX_BLOCK},"columns":[{",".join(f'"{f}"' for f in X.FEATURES)}],"dtype":"<f8","rows":' || n_rows || '}}' || chr(10)"""
    return f"""SELECT split, n_rows, shape_ok, sha256({head} || top) AS sha256 FROM (SELECT split, string_agg(sha256, chr(10) ORDER BY nd) AS top FROM {up} GROUP BY 1)
  JOIN (SELECT split, sum(n_rows)::BIGINT AS n_rows, min(first) = 0 AND max(last) = sum(n_rows) - 1 AS shape_ok FROM {name} GROUP BY 1) USING (split)"""


_missing = lambda f: f"CASE WHEN doc_id % 11 = {X.FEATURES.index(f)} THEN NULL ELSE {f}::DOUBLE END"
CELLS_FP = FEAT + ", " + POS + ", mc AS (" + " UNION ALL ".join(f"SELECT split, pos, {k} AS k, {_missing(f)} AS x FROM feat JOIN pos USING (doc_id)" for k, f in enumerate(X.FEATURES)) + ")"
# The other matrix: one cell moved by a few bits, two neighbours' places changed, one null where there was a zero.
OTHER_FP = ", oc AS (SELECT split, pos, k, CASE WHEN split = 'train' AND pos = 150 AND k = 5 THEN coalesce(x, 0) + 0.0000003::DOUBLE WHEN split = 'val' AND pos = 20 AND k < 2 THEN y WHEN split = 'test' AND pos = 3 AND k = 4 THEN NULL ELSE x END AS x FROM (SELECT *, max(x) OVER (PARTITION BY split, pos, k // 2) + CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS y FROM mc))"


def fp_matrix(s, d):
    f = features(s, d).select("doc_id", *[F.when(F.col("doc_id") % 11 != i, F.col(n)).alias(n) for i, n in enumerate(X.FEATURES)])
    return f.join(positions(s, d).select("doc_id", "split", "pos"), "doc_id")


def fp_other(s, d):
    m, (a, b, *_) = stage(s, fp_matrix(s, d)), X.FEATURES
    at = lambda part, pos: (F.col("split") == part) & (F.col("pos") == pos)
    last, fifth, most = X.FEATURES[5], X.FEATURES[4], F.greatest(a, b)
    return m.withColumns({last: F.when(at("train", 150), F.coalesce(last, F.lit(0.0)) + 0.0000003).otherwise(F.col(last)), a: F.when(at("val", 20), most + 0.5).otherwise(F.col(a)),
                          b: F.when(at("val", 20), most + 0.25).otherwise(F.col(b)), fifth: F.when(~at("test", 3), F.col(fifth))})


fp_leaves = lambda m: fingerprint.leaves(m, X.FEATURES, "split", block=MATRIX_BLOCK)
prints = lambda s, d: fingerprint.matrix_fingerprint(fp_matrix(s, d), X.FEATURES, "split", block=MATRIX_BLOCK)
query(f"WITH {CELLS_FP}, {leaves_sql('lv', 'mc')} {root_sql('lv')}", "matrix_fingerprint")(prints)
add("matrix_differences", lambda s, d: fingerprint.differing(fp_leaves(fp_matrix(s, d)), fp_leaves(fp_other(s, d)), "split"),
    f"WITH {CELLS_FP}{OTHER_FP}, {leaves_sql('lv', 'mc')}, {leaves_sql('lo', 'oc')} SELECT split, block, coalesce(lv.n_rows, 0) AS n_rows, coalesce(lo.n_rows, 0) AS other_rows FROM lv FULL JOIN lo USING (split, block) WHERE lv.sha256 IS DISTINCT FROM lo.sha256")


def metric_docs(s, d, runs=None):
    """A metric document for each damaged run, written and read. The one of (BSL, 123) has another dataset's hash, the one
    of (ENR, 42) its features in another order, that of (ENR, 2024) one row too many in its support."""
    m = measure.confusion_matrix(damaged(s, d) if runs is None else runs, KEYS)
    c = measure.metrics_per_class(m, KEYS)
    grid = m.groupBy(*KEYS, "y_true").agg(F.array_sort(F.collect_list(F.struct("y_pred", "n"))).alias("r")).select(*KEYS, "y_true", F.transform("r", lambda x: x.n).alias("r"))
    grid = grid.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("y_true", "r"))), lambda x: x.r).alias("confusion_matrix"))
    report = c.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("string"), F.struct("precision", "recall", "f1")))).alias("report"),
                                  F.transform(F.array_sort(F.collect_list(F.struct("label", "support"))), lambda x: x.support).alias("support"))
    sha = prints(s, d).where("split = 'test'").select(F.col("sha256").alias("sha"))
    rows = measure.metrics_overall(c, KEYS).drop("weighted_f1").join(grid, KEYS).join(report, KEYS).join(F.broadcast(sha), F.lit(True))  # one row
    other, turned = (F.col("condition") == "BSL") & (F.col("seed") == 123), (F.col("condition") == "ENR") & (F.col("seed") == 42)
    rows = rows.withColumn("provenance", F.create_map(F.lit("dataset_sha256"), F.when(other, F.lit("0" * 64)).otherwise(F.col("sha")), F.lit("split"), F.lit("test"))).drop("sha")
    names = [F.lit(f) for f in X.SELECTED]
    rows = rows.withColumn("support", F.when((F.col("condition") == "ENR") & (F.col("seed") == 2024), F.transform("support", lambda x, i: x + F.when(i == 1, 1).otherwise(0))).otherwise(F.col("support")))
    rows = rows.withColumn("feature_order", F.when(turned, F.array(*names[::-1])).otherwise(F.array(*names))).withColumn("model", F.lit("rule"))
    p = files.scratch(s)
    rows.withColumn("run", F.concat_ws("_", "model", *KEYS)).write.partitionBy("run").json(p)
    return files.read_metric_docs(s, p)


DCLASS = DPRED + """, g2 AS (SELECT a AS y_true, b AS y_pred FROM range(3) x(a), range(3) y(b)), dm AS (SELECT r.condition, r.seed, g2.y_true, g2.y_pred, count(p.id) AS n FROM (SELECT DISTINCT condition, seed FROM dp) r CROSS JOIN g2
  LEFT JOIN dp p ON p.condition = r.condition AND p.seed = r.seed AND p.y_true = g2.y_true AND p.y_pred = g2.y_pred GROUP BY ALL),
dc AS (SELECT condition, seed, l AS label, coalesce(sum(n) FILTER (y_true = l AND y_pred = l), 0) AS hit, coalesce(sum(n) FILTER (y_true = l), 0) AS support, coalesce(sum(n) FILTER (y_pred = l), 0) AS said FROM dm, range(3) x(l) GROUP BY ALL)"""
query(f"WITH {DCLASS}, rc AS (SELECT *, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS recall FROM dc) SELECT dm.condition, dm.seed, y_true::INTEGER AS y_true, y_pred::INTEGER AS y_pred, n::BIGINT AS n, (support + CASE WHEN rc.condition = 'ENR' AND rc.seed = 2024 AND rc.label = 1 THEN 1 ELSE 0 END)::BIGINT AS support, round(recall, 6) AS recall, 'rule_' || dm.condition || '_' || dm.seed AS run FROM dm JOIN rc ON rc.condition = dm.condition AND rc.seed = dm.seed AND rc.label = y_true", "scan_metric_docs")(
    lambda s, d: metric_docs(s, d).select(*KEYS, "support", "report", F.regexp_extract("path", "run=([^/]+)", 1).alias("run"), F.posexplode("confusion_matrix").alias("y_true", "r")).select(*KEYS, "support", "report", "run", "y_true", F.posexplode("r").alias("y_pred", "n")).select(
        *KEYS, "y_true", "y_pred", "n", F.get("support", F.col("y_true")).alias("support"), F.try_element_at("report", F.col("y_true").cast("string"))["recall"].alias("recall"), "run"))
# The order of a run's rows in its file: by id, as the test list has them.
def in_file(s, runs):
    """Places are sums over ranges of (run, id), less those before the run: no task holds a run."""
    number = F.regexp_replace("id", "x", "").cast("long")
    rows = tables.placed(runs.withColumn("n", number), [*KEYS, "n", "id"], name="pos")
    first = rows.groupBy(*KEYS).agg(F.min("pos").alias("first"))  # one row a run
    return rows.join(F.broadcast(first), KEYS).withColumn("pos", F.col("pos") - F.col("first")).drop("n", "first")


labelled_positions = lambda s, d: tables.split_positions(X.posts(s, d).join(X.labels(s, d).select("doc_id"), "doc_id", "left_semi"))
LINKED = DPRED + """, ip AS (SELECT *, row_number() OVER (PARTITION BY condition, seed ORDER BY replace(id, 'x', '')::BIGINT, id) - 1 AS pos FROM dp),
tl AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY doc_id) - 1 AS want FROM lab WHERE doc_id % 5 = 4),
lr AS (SELECT condition, seed, count(*) AS rows, count(*) FILTER (want IS NOT DISTINCT FROM pos) AS hit, (SELECT count(*) FROM tl) AS total FROM ip LEFT JOIN tl USING (id) GROUP BY ALL)"""
# What the documents say, and what it should be: the matrix' fingerprint, the selected features, the counts of the rows.
LINKS = LINKED + DCLASS[len(DPRED):] + ", " + CELLS_FP[len(FEAT) + 2 :] + f""", {leaves_sql('lv', 'mc')}, fp AS ({root_sql('lv')}),
said AS (SELECT condition, seed, CASE WHEN condition = 'BSL' AND seed = 123 THEN repeat('0', 64) ELSE fp.sha256 END AS sha, CASE WHEN condition = 'ENR' AND seed = 42 THEN {X.SELECTED[::-1]} ELSE {X.SELECTED} END AS features,
  list((support + CASE WHEN condition = 'ENR' AND seed = 2024 AND label = 1 THEN 1 ELSE 0 END)::BIGINT ORDER BY label) AS support FROM dc, fp WHERE fp.split = 'test' GROUP BY ALL),
true_s AS (SELECT condition, seed, [count(*) FILTER (y_true = 0), count(*) FILTER (y_true = 1), count(*) FILTER (y_true = 2)] AS support FROM dp GROUP BY ALL)"""
query(f"WITH {LINKS} SELECT condition, seed, rows, sha = (SELECT sha256 FROM fp WHERE split = 'test') AS dataset_match, features = {X.SELECTED} AS features_match, rows = total AND hit = total AS order_match, said.support = true_s.support AS support_match FROM lr JOIN said USING (condition, seed) JOIN true_s USING (condition, seed)", "link_runs")(
    lambda s, d: (lambda p: audit.link_runs(metric_docs(s, d, p), in_file(s, p), labelled_positions(s, d), prints(s, d), X.SELECTED))(stage(s, damaged(s, d))))
query(f"WITH {LINKED} SELECT condition, seed, pos, ip.id, tl.id AS expected, ip.id IS NOT DISTINCT FROM tl.id AS same FROM ip LEFT JOIN tl ON tl.want = ip.pos", "join_run_predictions")(
    lambda s, d: (lambda p: p.join(labelled_positions(s, d).where("split = 'test'").select(F.col("id").alias("expected"), "pos"), "pos", "left").select(*KEYS, "pos", "id", "expected", F.col("id").eqNullSafe(F.col("expected")).alias("same")))(
        (lambda p: in_file(s, p).join(metric_docs(s, d, p).select(*KEYS), KEYS, "left_semi"))(stage(s, damaged(s, d)))))


# The chain from posts to predictions. Its trace lacks some cells and a post, has a wrong address, and says others twice.
CHAIN = TRACE + ", " + SEL + ", " + DPRED[len(FEAT) + 2 :] + ", " + TRIPLES[len(POSTS) + len(LAB) + 4 :] + """, rt AS (SELECT id, CASE WHEN id::BIGINT % 61 = 3 THEN post_iri || 'x' ELSE post_iri END AS post_iri, feature, CASE WHEN id::BIGINT % 53 <> 5 THEN module END AS module, value
  FROM (SELECT * FROM tm UNION ALL SELECT * FROM tm WHERE id::BIGINT % 47 = 1 AND feature IS NOT NULL) WHERE id <> '8' AND NOT coalesce(feature = 'ont_gamma' AND id::BIGINT % 59 = 2, false)),
ci AS (SELECT id, max(post_iri) AS iri FROM rt GROUP BY 1), cx AS (SELECT CAST(doc_id AS VARCHAR) AS id, feature, value FROM cells SEMI JOIN sel USING (feature)),
ck AS (SELECT id, feature, count(*) AS n, max(value) AS v FROM rt WHERE feature IS NOT NULL GROUP BY ALL),
cc AS (SELECT cx.id, CASE WHEN cx.value <> 0 THEN coalesce(abs(cx.value - ck.v) <= 1e-12, false) ELSE ck.v IS NULL END AS ok FROM cx LEFT JOIN ck USING (id, feature)),
ts AS (SELECT CAST(doc_id AS VARCHAR) AS id, label FROM lab WHERE doc_id % 5 = 4), ru AS (SELECT DISTINCT condition, seed FROM dp),
pe AS (SELECT condition, seed, count(*) - count(DISTINCT dp.id) + count(DISTINCT dp.id) FILTER (ts.id IS NULL) + (SELECT count(*) FROM ts) - count(DISTINCT ts.id) + count(*) FILTER (label IS DISTINCT FROM y_true) AS x FROM dp LEFT JOIN ts ON dp.id = ts.id GROUP BY ALL)"""
_bad = " + ".join(f"(SELECT count(*) FROM ({results_sql('tr', x, c)}))" for x in SHAPES for c in x.components)
CHAIN += f""", ch(relation, expected, verified, exceptions) AS (
  SELECT 'posts', (SELECT count(*) FROM posts), (SELECT count(*) FROM posts SEMI JOIN ci USING (id)), (SELECT count(*) FROM (SELECT id, {IRI('post', 'id')} AS want FROM posts) LEFT JOIN ci USING (id) WHERE iri IS DISTINCT FROM want)
  UNION ALL SELECT 'activations', (SELECT count(*) FROM cx WHERE value <> 0), (SELECT count(*) FROM rt SEMI JOIN sel USING (feature) WHERE value <> 0), (SELECT count(*) FILTER (id IS NULL) + count(*) FILTER (module IS NULL) + count(*) FILTER (post_iri IS NULL) FROM rt SEMI JOIN sel USING (feature) WHERE value <> 0)
  UNION ALL SELECT 'cells', (SELECT count(*) FROM cx), (SELECT count(*) FROM cc WHERE ok), (SELECT count(*) FROM cc WHERE NOT ok) + (SELECT count(*) FROM ck SEMI JOIN sel USING (feature) WHERE n > 1)
  UNION ALL SELECT 'constraints', 1, ({_bad} = 0)::INTEGER, ({_bad} > 0)::INTEGER + {_bad}
  UNION ALL SELECT 'predictions', (SELECT count(*) FROM ts) * (SELECT count(*) FROM ru), (SELECT count(*) FROM dp), (SELECT sum(x) FROM pe))"""


def chain_trace(s, d):
    t, n = trace(s, d), F.col("id").cast("long")
    t = t.union(t.where((n % 47 == 1) & F.col("feature").isNotNull())).where((F.col("id") != "8") & ~F.coalesce((F.col("feature") == "ont_gamma") & (n % 59 == 2), F.lit(False)))
    return t.withColumns({"post_iri": F.when(n % 61 == 3, F.concat("post_iri", F.lit("x"))).otherwise(F.col("post_iri")), "module": F.when(n % 53 != 5, F.col("module"))})


@query(f"WITH {CHAIN} SELECT relation, expected::BIGINT AS expected, verified::BIGINT AS verified, exceptions::BIGINT AS exceptions, CASE WHEN exceptions = 0 AND expected = verified THEN 'passed' ELSE 'attention required' END AS status FROM ch")
def reconcile_chain(s, d):
    ids = X.labels(s, d).select(F.col("doc_id").cast("string").alias("id"), "label")
    return audit.reconcile_chain(X.posts(s, d).select("id", graph.iri("post", F.col("id")).alias("iri")), stage(s, chain_trace(s, d)), id_cells(s, d), X.selection(s), shapes.summary(shapes.report(stage(s, triples(s, d)), SHAPES)),
                                 stage(s, damaged(s, d)), ids.where("cast(id as long) % 5 = 4"))


@query(f"WITH {TRACE}, t1 AS (SELECT id, feature, value FROM tm UNION ALL SELECT id, feature, value FROM tm WHERE feature = 'ont_count' AND id::BIGINT % 50 = 0), t2 AS (SELECT *, row_number() OVER (ORDER BY id, feature NULLS FIRST) + 1 AS row, count(*) OVER (PARTITION BY id, feature) AS same FROM t1) SELECT id, feature, round(value, 6) AS value, row, same FROM t2")
def scan_trace(s, d):
    """The trace as CSV with its physical row numbers (the header is row 1), and how many rows share a key; some are
    written twice."""
    t = trace(s, d).select("id", "feature", "value")
    t = t.union(t.where((F.col("feature") == "ont_count") & (F.col("id").cast("long") % 50 == 0)))
    p = files.write_csv(tables.placed(t, ["id", F.asc_nulls_first("feature")], name="row").withColumn("row", F.col("row") + 2), files.scratch(s))
    rows = s.read.schema("id string, feature string, value double, row long").csv(p, header=True)
    same = rows.groupBy(F.col("id").alias("i"), F.col("feature").alias("f")).agg(F.count("*").alias("same"))
    return rows.join(same, F.col("id").eqNullSafe(F.col("i")) & F.col("feature").eqNullSafe(F.col("f"))).drop("i", "f")


def source_files(s, d):
    """A file of ids for each source, below source=NAME."""
    p = files.scratch(s)
    docs(s, d).select("source", F.col("doc_id").cast("string").alias("value"), "doc_id").repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(p)
    return audit.scan_files(s, p, ".txt", exclude=("source=[^/]*0/",)).withColumn("folder", F.substring_index("path", "/", 1))


FILES = "sf AS (SELECT 'source=' || source AS folder, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes, sha256(string_agg(doc_id::VARCHAR || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents WHERE source NOT LIKE '%0' GROUP BY source)"
add("scan_files", lambda s, d: source_files(s, d).select("folder", "bytes", "sha256"), f"WITH {FILES} SELECT folder, bytes, sha256 FROM sf")
add("file_hashes", lambda s, d: source_files(s, d).select(F.concat("sha256", F.lit("  "), "folder").alias("line"), (F.col("bytes") == 0).alias("empty")), f"WITH {FILES} SELECT sha256 || '  ' || folder AS line, bytes = 0 AS empty FROM sf")


@query(f"WITH {FILES}, st AS (SELECT folder AS name, CASE WHEN folder LIKE '%3' THEN 'undeclared' WHEN folder LIKE '%7' THEN 'mismatch' ELSE 'ok' END AS status FROM sf) SELECT name, status FROM st UNION ALL SELECT 'gone', 'missing' UNION ALL SELECT 'no hash', 'malformed'")
def manifest_verify(s, d):
    """A manifest that leaves out the files of sources that end in 3, has wrong hashes for those in 7, and two bad lines."""
    actual = source_files(s, d).select(F.col("folder").alias("name"), "sha256")
    line = F.concat(F.when(F.col("name").endswith("7"), F.reverse("sha256")).otherwise(F.col("sha256")), F.lit("  "), "name")
    declared = actual.where(~F.col("name").endswith("3")).select(line.alias("line")).union(s.createDataFrame([("0" * 64 + "  gone",), ("no hash",)], "line string"))
    return audit.manifest_verify(declared, actual)


LEXW = f"{VAL}, {FREQ}, lx AS (SELECT * FROM fq JOIN val ON token = term WHERE freq >= 3 AND abs(valence) >= 1)"


@query(f"WITH {LEXW} SELECT term, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, valence)) AS weight FROM lx")
def scan_frozen_lexicon(s, d):
    """The lexicon as a JSON document with one map for each side, read back to rows; neither may be empty."""
    lex = lexicon.induce_lexicon(tokens(s, d), valence(s))
    side = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("polarity") == k, F.struct("term", "weight")))).alias(k)
    return files.read_frozen_lexicon(s, files.write_report(lex.agg(side("positive"), side("negative")), files.scratch(s)))


# Authors that are missing in the source.
orphans = lambda s, d: X.posts(s, d).withColumn("author", F.when(F.col("doc_id") % 97 != 5, F.col("author")))
add("project_release", lambda s, d: tables.project_release(orphans(s, d), tables.pseudonym_authors(orphans(s, d))),
    f"WITH {POSTS}, pa AS (SELECT * REPLACE (CASE WHEN doc_id % 97 = 5 THEN 'unknown' ELSE author END AS author) FROM posts), a AS (SELECT author, 'author_' || lpad(CAST(row_number() OVER (ORDER BY author) AS VARCHAR), 4, '0') AS author_id FROM (SELECT DISTINCT author FROM pa)) SELECT id, author_id, body, topic, created, split FROM pa JOIN a USING (author)")


# Windows around anchors.
def windowed(where, sizes):
    """SQL: cw (w, doc_id, token)."""
    anchors = ", ".join(f"('{a}')" for a in X.ANCHORS)
    return rf"""cw0 AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents WHERE {where}), anc(p) AS (VALUES {anchors}), wins(w) AS (VALUES {", ".join(f"({w})" for w in sizes)}),
cw1 AS (SELECT doc_id, regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+') AS toks, regexp_replace(trim(regexp_replace(low, '\s+', ' ', 'g')), '([^\p{{L}}\p{{N}}_])', chr(4) || '\1' || chr(3), 'g') AS l FROM cw0),
cw2 AS (SELECT doc_id, toks, string_split(replace(replace(regexp_replace(l, '(^|' || chr(3) || ')' || p || '(' || chr(4) || '|$)', '\1' || chr(1) || p || '\2', 'g'), chr(3), ''), chr(4), ''), chr(1)) AS ps FROM cw1, anc),
cw3 AS (SELECT doc_id, toks, greatest(len(list_filter(string_split(array_to_string(ps[1:k], ''), ' '), lambda x: x <> '')) - 1, 0) AS c FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM cw2)),
cw AS (SELECT w, doc_id, token FROM (SELECT w, doc_id, unnest(toks[greatest(c - w, 0) + 1:c + w + 1]) AS token FROM cw3, wins) WHERE length(token) > 2 AND token NOT IN ({", ".join(f"'{x}'" for x in X.STOPWORDS)}))"""


WIN = windowed("doc_id % 5 < 3", [5])
query(f"WITH {WIN} SELECT token, count(*) AS n FROM cw GROUP BY 1", "concept_windows")(lambda s, d: windows(s, d).groupBy("token").agg(F.count("*").alias("n")))
query(f"WITH {WIN}, {VAL}, wf AS (SELECT token AS term, count(*) AS freq FROM cw GROUP BY 1) SELECT term, freq, valence, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, valence)) AS weight, CASE WHEN valence > 0 THEN 'positive' ELSE 'negative' END AS polarity FROM wf JOIN val USING (term) WHERE freq >= 3 AND abs(valence) >= 1", "induce_lexicon_windows")(
    lambda s, d: lexicon.induce_lexicon(windows(s, d), valence(s)))
# The induction set of a careless run: the training texts and some of the validation texts that have windows.
careless = lambda s, d: lexicon.concept_windows(docs(s, d).where((F.col("doc_id") % 5 < 3) | (F.col("doc_id") % 50 == 3)), X.ANCHORS, X.STOPWORDS).select(F.col("doc_id").cast("string").alias("id"))
query(f"WITH {windowed('doc_id % 5 < 3 OR doc_id % 50 = 3', [5])} SELECT 'val' AS split, count(DISTINCT doc_id) AS n FROM cw WHERE doc_id % 5 = 3 HAVING count(*) > 0", "induction_leak_check")(lambda s, d: lexicon.leaked(careless(s, d), X.posts(s, d)))


# Texts without tokens are padded too; the length is the corpus' 95th percentile.
@query(f"WITH {VOC}, ml AS (SELECT greatest(trunc(quantile_cont(n, 0.95))::INTEGER, 1) AS m FROM (SELECT count(token) AS n FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id)), e AS (SELECT doc_id, list(coalesce(index, 1) ORDER BY pos) AS l FROM tok LEFT JOIN vo USING (token), ml WHERE pos < m GROUP BY 1) SELECT doc_id, md5(array_to_string(list_concat(coalesce(l, []), list_transform(range(m - len(coalesce(l, []))), lambda x: 0)), ' ')) AS ids, m AS length FROM documents LEFT JOIN e USING (doc_id), ml")
def encode_tokens(s, d):
    sizes = docs(s, d).select(F.lit(1).alias("all"), T.word_count(F.lower(F.coalesce("text", F.lit("")))).alias("n"))
    length = max(1, int(measure.quantiles(sizes, ["all"], "n", {"q": 0.95}).first().q))
    words = docs(s, d).select("doc_id", T.words(F.lower("text")).alias("words"))
    out = tables.encode_tokens(words, tables.build_vocab(tokens(s, d)), length)
    return out.select("doc_id", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids"), F.lit(length).alias("length"))


# Sets.
query(f"WITH {TRACE}, {LAB}, ex AS (SELECT '{BASE}post_' || doc_id AS i FROM lab EXCEPT SELECT post_iri FROM tm WHERE feature IS NOT NULL) SELECT count(*) = 0 AS subset, count(*) AS missing FROM ex", "set_subset")(
    lambda s, d: tables.subset(X.labels(s, d).select(graph.iri("post", F.col("doc_id").cast("string")).alias("iri")), trace(s, d).where("feature is not null").select(F.col("post_iri").alias("iri")), "iri"))
query(f"WITH {CELLS}, x AS (SELECT source, list(DISTINCT feature) FILTER (doc_id % 5 < 3) AS a, list(DISTINCT feature) FILTER (doc_id % 5 = 4) AS b FROM cells JOIN documents USING (doc_id) WHERE value <> 0 GROUP BY 1), y AS (SELECT source, coalesce(a, []) AS a, coalesce(b, []) AS b FROM x) SELECT source, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM y", "set_jaccard")(
    lambda s, d: cells(s, d).where("value <> 0").join(docs(s, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(  # sets of at most six features
        F.collect_set(F.when(F.col("doc_id") % 5 < 3, F.col("feature"))).alias("a"), F.collect_set(F.when(F.col("doc_id") % 5 == 4, F.col("feature"))).alias("b")).select("source", tables.jaccard(F.col("a"), F.col("b")).alias("jaccard")))
query(f"WITH {ABLATED} SELECT module, round(max(contribution) FILTER (model = 'rule'), 6) AS rule, round(max(contribution) FILTER (model = 'vote'), 6) AS vote FROM ar GROUP BY 1", "pivot_delta")(
    lambda s, d: tables.pivot_complete(ablation.module_ranks(ablation_summary(s, d)), "module", "model", ["rule", "vote"], "contribution"))

# Literals.
query(f"SELECT doc_id, md5({SAN.format('text')}) AS fragment FROM documents", "sanitize_iri")(lambda s, d: docs(s, d).select("doc_id", F.md5(graph.sanitize_iri(F.col("text"))).alias("fragment")))
# Times as text in several forms, some of which are none.
TIMES = """CASE doc_id % 6 WHEN 0 THEN strftime(created, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(created, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN strftime(created, '%Y-%m-%d') WHEN 3 THEN 'yesterday' WHEN 4 THEN strftime(created, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE '' END"""
query(f"WITH {POSTS} SELECT id, strftime(coalesce(CASE doc_id % 6 WHEN 0 THEN created WHEN 1 THEN created WHEN 2 THEN date_trunc('day', created) WHEN 4 THEN created - INTERVAL 2 HOURS END, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S') AS t FROM posts", "datetime_literal")(
    lambda s, d: (lambda p: p.select("id", graph.datetime_literal(graph.parsed_time(p["said"])).alias("t")))(X.posts(s, d).withColumn("said", F.when(F.col("doc_id") % 6 == 0, F.date_format("created", "yyyy-MM-dd HH:mm:ss")).when(F.col("doc_id") % 6 == 1, F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("doc_id") % 6 == 2, F.date_format("created", "yyyy-MM-dd")).when(F.col("doc_id") % 6 == 3, "yesterday").when(F.col("doc_id") % 6 == 4, F.concat(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(""))))

# Audits of damaged traces: posts that are divisible by 50 are missing, those by 35 have rows under an unknown id.
DTRACE = TRACE + ", dt AS (SELECT CASE WHEN id::BIGINT % 35 = 0 THEN 'z' || id ELSE id END AS id, feature, value FROM tm WHERE id::BIGINT % 50 <> 0)"
gaps = lambda s, d: trace(s, d).where(F.col("id").cast("long") % 50 != 0).withColumn("id", F.when(F.col("id").cast("long") % 35 == 0, F.concat(F.lit("z"), "id")).otherwise(F.col("id")))
query(f"WITH {DTRACE} SELECT (SELECT count(*) FROM posts) AS posts, count(feature) AS traced_cells, count(DISTINCT id) AS posts_traced, (SELECT count(*) FROM posts WHERE id NOT IN (SELECT id FROM dt)) AS posts_untraced, count(*) FILTER (id NOT IN (SELECT id FROM posts)) AS rows_without_post, round(100.0::DOUBLE * count(DISTINCT id) / (SELECT count(*) FROM posts), 6) AS percent FROM dt", "audit_traceability")(
    lambda s, d: audit.traceability(X.posts(s, d), stage(s, gaps(s, d))))
query(f"WITH {DTRACE}, sl(feature) AS (VALUES ('ont_alpha'), ('ont_gamma'), ('ont_density'), ('ont_gone')), cv AS (SELECT feature, count(*) FILTER (value <> 0) AS nonzero FROM cells GROUP BY 1), tc AS (SELECT feature, count(*) AS traced FROM dt GROUP BY 1) SELECT sl.feature, cv.feature IS NOT NULL AS exists, coalesce(nonzero, 0) AS nonzero, coalesce(traced, 0) AS traced, coalesce(nonzero, 0) = coalesce(traced, 0) AS complete, sl.feature IN ('ont_alpha', 'ont_density') AS in_train FROM sl LEFT JOIN cv USING (feature) LEFT JOIN tc USING (feature)", "audit_model_inputs")(
    lambda s, d: audit.model_inputs(s.createDataFrame([(f,) for f in (*X.SELECTED, "ont_gone")], "feature string"), cells(s, d).groupBy("feature").agg(F.count_if(F.col("value") != 0).alias("nonzero")), gaps(s, d),
        with_split(s, d).where((F.col("split") == "train") | ((F.col("feature") == "ont_gamma") & (F.col("split") == "val"))).select("feature", "split").distinct()))
EXPECT = {"null_ids": 0, "null_texts": 0, "languages": 5, "sources": 50, "duplicate_ids": 0, "unlabelled": 0, "test_share_percent": 20, "empty_texts": 0, "wrong_lengths": 0, "unknown_labels": 0}
query("WITH o AS (SELECT count(*) - count(doc_id) AS null_ids, count(*) - count(text) AS null_texts, count(DISTINCT lang) AS languages, count(DISTINCT source) AS sources, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, 100 * count(*) FILTER (doc_id % 5 = 4) // count(*) AS test_share_percent, count(*) FILTER (text = '') AS empty_texts, count(*) FILTER (n_chars <> length(text)) AS wrong_lengths, (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1)) AS unknown_labels FROM documents) "
      + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {v}::BIGINT AS expected, {k}::BIGINT AS observed, {k} = {v} AS passed, CASE WHEN {k} = {v} THEN '{k}: as expected' ELSE '{k}: ' || {k} || ' instead of {v}' END AS message FROM o" for k, v in EXPECT.items()), "expectation_suite")(
    lambda s, d: audit.expectations(docs(s, d).join(X.table(s, d, "labels").select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left").agg(
        F.count_if(F.col("doc_id").isNull()).alias("null_ids"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_distinct("lang").alias("languages"), F.count_distinct("source").alias("sources"),
        (F.count("*") - F.count_distinct("doc_id")).alias("duplicate_ids"), F.count_if(F.col("l").isNull()).alias("unlabelled"), F.floor(100 * F.count_if(F.col("doc_id") % 5 == 4) / F.count("*")).alias("test_share_percent"),
        F.count_if(F.col("text") == "").alias("empty_texts"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_lengths")).join(X.table(s, d, "labels").agg(F.count_if(~F.col("quality").isin(0, 1)).alias("unknown_labels")), F.lit(True)), EXPECT))

# Sensitivity: every variant of a grid, window included.
_w, _f, _v = EXPANDED
CANONICAL = "w5_f3_v1.0"
_m = ", ".join
_clean = r"regexp_replace(x, '[^\p{L}\p{N}_\s]', '', 'g')"
_weight = "CASE " + _clean + " " + " ".join(f"WHEN '{t}' THEN {max(-2.0, min(2.0, v))}::DOUBLE" for t, v in X.VALENCE.items()) + " ELSE 0 END"
_gx = lambda rows: "gx AS (SELECT *, 'w' || w || '_f' || mf || '_v' || mv AS variant FROM (" + rows + "))"
_product = lambda w, f, v: f"SELECT * FROM (SELECT unnest({w})::INTEGER AS w), (SELECT unnest({f})::INTEGER AS mf), (SELECT unnest({v})::DOUBLE AS mv)"


def lexicons_sql(gx: str) -> str:
    return windowed("doc_id % 5 < 3", sorted({*_w, *(w for w, _, _ in sensitivity.SMALL)})) + f""", {VAL}, {LAB}, {gx},
kx AS (SELECT variant, list(term ORDER BY term) AS terms, count(*) AS size, count(*) FILTER (valence > 0) AS np, count(*) FILTER (valence < 0) AS nn FROM (SELECT w, token AS term, count(*) AS freq FROM cw GROUP BY ALL) c JOIN val USING (term) JOIN gx ON gx.w = c.w AND freq >= mf AND abs(valence) >= mv GROUP BY 1),
vx AS (SELECT gx.*, coalesce(size, 0) AS size, coalesce(np, 0) AS np, coalesce(nn, 0) AS nn, coalesce(terms, []) AS terms, CASE WHEN np > 0 AND nn > 0 THEN 'valid' ELSE 'invalid' END AS status FROM gx LEFT JOIN kx USING (variant))"""


# p: the tail of the F distribution for three labels, (1 + 2 f / d) ^ (-d / 2).
def variants_sql(gx: str) -> str:
    own = {"active_docs": "active_docs", "activation": "100.0::DOUBLE * coalesce(active_docs, 0) / (SELECT count(*) FROM documents)", "covered": "covered", "positive_mentions": "positive_mentions", "negative_mentions": "negative_mentions",
           "assertions": "assertions", "cells": "cells", "selected": "selected", "selected_active": "selected_active"}
    return MENTIONS + ", " + lexicons_sql(gx) + f""",
lex AS (SELECT DISTINCT terms FROM vx WHERE status = 'valid'),
lp AS (SELECT terms, doc_id, concept, list_sum(list_transform(words, lambda x: CASE WHEN list_contains(terms, {_clean}) THEN {_weight} ELSE 0 END)) AS p FROM mw, lex),
pd AS (SELECT terms, concept, doc_id, count(*) FILTER (p > 0.5) AS a, count(*) FILTER (p < -0.5) AS b FROM lp WHERE abs(p) > 0.5 GROUP BY ALL),
ac AS (SELECT terms, count(DISTINCT doc_id) AS active_docs, sum(a)::BIGINT AS positive_mentions, sum(b)::BIGINT AS negative_mentions, count(*) AS assertions FROM pd GROUP BY 1),
px AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT terms, doc_id, concept || '_{n}' AS feature, {x} AS x FROM pd" for n, x in (("positive", "a"), ("negative", "b"), ("net", "a - b")))}) WHERE x <> 0),
ax AS (SELECT terms, count(*) AS cells, count(DISTINCT feature) AS covered FROM px GROUP BY 1),
cl AS (SELECT label, count(*) AS c FROM lab WHERE doc_id % 5 < 3 GROUP BY 1),
sm AS (SELECT terms, feature, label, sum(x)::DOUBLE AS s, sum(x * x)::DOUBLE AS q FROM px JOIN lab USING (doc_id) WHERE doc_id % 5 < 3 GROUP BY ALL),
fx AS (SELECT terms, feature, sum(s) AS s, sum(q) AS q, sum(s * s / c) AS b FROM sm JOIN cl USING (label) GROUP BY ALL),
fv AS (SELECT terms, feature, n - k AS d, CASE WHEN abs(q - b) > 1e-12 THEN ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) END AS f FROM fx, (SELECT sum(c) AS n, count(*) AS k FROM cl)),
sf AS (SELECT terms, feature FROM fv WHERE power(1 + 2 * f / d, -d / 2.0::DOUBLE) < 0.05),
se AS (SELECT terms, count(DISTINCT feature) AS selected, count(DISTINCT doc_id) AS selected_active FROM sf JOIN px USING (terms, feature) GROUP BY 1),
rx AS (SELECT vx.*, {_m(f"CASE WHEN status = 'valid' THEN coalesce({x}, 0) END AS {m}" for m, x in own.items())} FROM vx LEFT JOIN ac USING (terms) LEFT JOIN ax USING (terms) LEFT JOIN se USING (terms))"""


VARIANTS = variants_sql(_gx(_product(_w, _f, _v)))
BASE_ROW = "ba AS (SELECT " + _m(f"{m} AS b_{m}" for m in sensitivity.METRICS) + f", terms AS b_terms FROM rx WHERE variant = '{CANONICAL}')"
JAC = "round(CASE WHEN len(list_distinct(list_concat(terms, b_terms))) = 0 THEN 1 ELSE len(list_intersect(terms, b_terms))::DOUBLE / len(list_distinct(list_concat(terms, b_terms))) END, 6)"
expanded = lambda s: measure.grid(s, _w, _f, _v)
_rounded = lambda m: f"round({m}, 6)" if m == "activation" else m


def small(s):
    rows = s.createDataFrame(sensitivity.SMALL, "window int, min_freq int, min_valence double")
    return rows.withColumn("variant", F.format_string("w%d_f%d_v%s", "window", "min_freq", F.col("min_valence").cast("string")))


def grid_counts(s, d, windows):
    train = docs(s, d).where(X.split_of(F.col("doc_id")) == "train")
    return stage(s, lexicon.window_counts(train, X.ANCHORS, X.STOPWORDS, windows))


def grid_results(s, d, grid=None, axes=EXPANDED):
    counts = grid_counts(s, d, axes[0])
    found = stage(s, sensitivity.lexicons(counts, valence(s), expanded(s) if grid is None else grid))
    rows, names = enrich.in_row(docs(s, d), X.VOCABULARY, X.COMPOUNDS, X.lexicon(s))
    places = {c: f"at{k}" for k, c in enumerate(names)}
    texts = rows.select("doc_id", "single", *places.values())
    return stage(s, sensitivity.run_grid(found, sensitivity.lattice(counts, valence(s), *axes), texts, places, X.labels(s, d).where("doc_id % 5 < 3"), axes))


GRID_COLUMNS = ["variant", "status", *sensitivity.METRICS]
_AXES = tuple(sorted({g[i] for g in sensitivity.SMALL}) for i in range(3))
query(f"WITH {variants_sql(_gx('SELECT * FROM (VALUES ' + _m(f'({w}, {f}, {v}::DOUBLE)' for w, f, v in sensitivity.SMALL) + ') g(w, mf, mv)'))} SELECT {_m(f'{_rounded(m)} AS {m}' for m in GRID_COLUMNS)} FROM rx", "grid_small")(
    lambda s, d: grid_results(s, d, small(s), _AXES).select(*GRID_COLUMNS))
query(f"WITH {lexicons_sql(_gx(_product(_w, _f, _v)))} SELECT variant, w AS \"window\", mf AS min_freq, mv AS min_valence, size, np AS positive, nn AS negative, status FROM vx", "grid_expanded")(
    lambda s, d: sensitivity.lexicons(grid_counts(s, d, _w), valence(s), expanded(s)).drop("terms"))
query(f"WITH {VARIANTS} SELECT {_m(f'{_rounded(m)} AS {m}' for m in GRID_COLUMNS)} FROM rx", "run_grid")(lambda s, d: grid_results(s, d).select(*GRID_COLUMNS))
query(f"WITH {VARIANTS}, {BASE_ROW} SELECT variant, {_m(f'round({m} - b_{m}, 6) AS delta_{m}' if m == 'activation' else f'{m} - b_{m} AS delta_{m}' for m in sensitivity.METRICS)}, {JAC} AS jaccard FROM rx, ba", "grid_compare")(lambda s, d: sensitivity.compare(grid_results(s, d), CANONICAL).drop("window", "min_freq", "min_valence"))
LONG = "lo AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM rx WHERE status = 'valid'" for m in sensitivity.METRICS) + ")"
query(f"""WITH {VARIANTS}, {LONG} SELECT metric, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(mean, 6) AS mean, round(q3, 6) AS q3, round(max, 6) AS max, round(std, 6) AS std, variants, passed, invalid FROM (SELECT metric, {NUM.format('value')} FROM lo GROUP BY 1),
  (SELECT count(*) AS variants, count(*) FILTER (status = 'valid') AS passed, coalesce(string_agg(variant, ',' ORDER BY variant) FILTER (status <> 'valid'), '') AS invalid FROM rx)""", "grid_aggregate")(lambda s, d: sensitivity.aggregate(grid_results(s, d)))


@query(f"WITH {VARIANTS} SELECT variant, CASE WHEN w = 2 AND mf = 8 THEN 'missing' WHEN w = 3 AND mf = 8 THEN 'repeated' ELSE status END AS status, {_m(f'CASE WHEN w <> 2 OR mf <> 8 THEN {_rounded(m)} END AS {m}' for m in sensitivity.METRICS)} FROM rx")
def grid_collect(s, d):
    """A report for each variant; those of window 2 and frequency 8 are lost, those of window 3 and frequency 8 are there
    twice."""
    rows, p = grid_results(s, d).where("not (window = 2 and min_freq = 8)"), files.scratch(s)
    rows = rows.withColumn("n", F.explode(F.when((F.col("window") == 3) & (F.col("min_freq") == 8), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows.select("variant", "status", *sensitivity.METRICS, F.concat_ws("_", "variant", "n").alias("run")).write.partitionBy("run").json(p)
    return sensitivity.collected(s, p, expanded(s))


query(f"WITH {VARIANTS}, {BASE_ROW}, jx AS (SELECT w, mf, {JAC} AS j FROM rx, ba) SELECT w AS \"window\", {_m(f'round(quantile_cont(j, 0.5) FILTER (mf = {k}), 6) AS "{k}"' for k in _f)} FROM jx GROUP BY 1", "pivot_median_jaccard")(
    lambda s, d: sensitivity.compare(grid_results(s, d), CANONICAL).groupBy("window").pivot("min_freq", _f).agg(F.percentile("jaccard", F.lit(0.5))))  # 125 rows

# Models, of their stated sizes (models.SIZES) and terms (models.TERMS).
def fitted(kind):
    return lambda s, d: models.ablation_grid(model_rows(s, d), {"selected": X.SELECTED}, (kind,), (42,))


N_TERMS = 5000
TERMS = r"""tt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\p{M}]{2,}') AS t FROM documents), tg AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gs FROM tt),
gr AS (SELECT doc_id, unnest(gs) AS g FROM tg WHERE doc_id % 5 < 3), gc AS (SELECT g, count(*) AS tf, count(DISTINCT doc_id) AS df FROM gr GROUP BY 1),
vo AS (SELECT *, ln((1 + (SELECT count(*) FROM tg WHERE doc_id % 5 < 3)) / (1 + df)::DOUBLE) + 1 AS idf, (row_number() OVER (ORDER BY tf DESC, g) - 1)::INTEGER AS place FROM gc ORDER BY tf DESC, g LIMIT """ + f"{N_TERMS})"
train_texts = lambda s, d: docs(s, d).where("doc_id % 5 < 3")
query(f"WITH {TERMS} SELECT g, tf, df, round(idf, 6) AS idf, place FROM vo", "tfidf_terms")(lambda s, d: terms.vocabulary(train_texts(s, d), N_TERMS))
query(f"""WITH {TERMS}, ow AS (SELECT doc_id, g, place, count(*) * any_value(idf) AS w FROM (SELECT doc_id, unnest(gs) AS g FROM tg) JOIN vo USING (g) GROUP BY ALL)
SELECT doc_id, place, g, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM ow""", "tfidf")(lambda s, d: terms.weights(docs(s, d), terms.vocabulary(train_texts(s, d), N_TERMS)))


@query(f"WITH {FEAT}, {LAB}, {TERMS.replace(str(N_TERMS), '200').replace('FROM documents)', 'FROM documents JOIN lab USING (doc_id))')}, ow AS (SELECT doc_id, g, count(*) * any_value(idf) AS w FROM (SELECT doc_id, unnest(gs) AS g FROM tg) JOIN vo USING (g) GROUP BY ALL), "
       f"nw AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, count(*) AS n FROM ow GROUP BY 1) SELECT doc_id::VARCHAR AS id, coalesce(n, 0)::INTEGER AS n_terms, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, {', '.join(f'round({f}, 6) AS {f}' for f in X.SELECTED)} FROM feat JOIN lab USING (doc_id) LEFT JOIN nw USING (doc_id)")
def stack_semantic(s, d):
    from pyspark.ml.functions import vector_to_array

    rows = model_rows(s, d)
    vocabulary = terms.vocabulary(rows.where("split = 'train'"), 200)
    own = models.stack_semantic(models.tfidf(rows, vocabulary), X.SELECTED).withColumn("a", vector_to_array("features"))
    text = F.slice("a", 1, F.size("a") - len(X.SELECTED))
    out = own.select("id", F.size(F.filter(text, lambda x: x > 0)).alias("n_terms"), F.sqrt(F.aggregate(text, F.lit(0.0), lambda t, x: t + x * x)).alias("norm"), *[F.get("a", F.size("a") - len(X.SELECTED) + i).alias(f) for i, f in enumerate(X.SELECTED)])
    return out


for _k in ("lr", "rf", "gbt"):
    query(None, f"fit_{_k}")(lambda s, d, k=_k: (lambda p: measure.metrics_overall(measure.metrics_per_class(measure.confusion_matrix(p, ["model", *KEYS]), ["model", *KEYS]), ["model", *KEYS]))(fitted(k)(s, d)))
query(None, "predict_table")(fitted("lr"))
query(None, "ablation_grid")(lambda s, d: models.ablation_grid(model_rows(s, d), conditions(), ("lr",)))
