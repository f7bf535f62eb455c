"""The driver's tables as posts, labels and splits, and the dictionaries that match their invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelex.operators.graph import BASE

VOCABULARY = [
    ("Alpha", "ai", 0), ("Alpha", "ing", 1), ("Alpha", "tion", 2), ("Beta", "ble", 3), ("Beta", "that", 4), ("Beta", "this", 5),
    ("Gamma", "thing", 6), ("Gamma", "from", 7), ("Delta", "than", 8), ("Delta", "then", 9), ("Delta", "with", 10),
]
CONCEPTS = ["Alpha", "Beta", "Gamma", "Delta"]
COMPOUNDS = {"Alpha": ["tionha", "inoran"], "Gamma": ["thing on"]}
VALENCE = {"thing": 1.7, "thon": -1.4, "thou": 2.6, "ered": -2.1, "thin": 1.0, "erin": 0.6, "then": -1.1, "absentword": 1.5}
LEXICON = {"thing": 1.7, "thon": -1.4, "thou": 2.0, "ered": -2.0, "thin": 1.0, "then": -1.1}
ANCHORS = ["that", "with", "from", "this", "than", "then", "thing"]
STOPWORDS = ["the", "and", "for", "was", "are"]
MODIFIERS = {"intensifier": ["the", "all"], "negation": ["no", "nicht", "pas", "not"], "attenuator": ["of", "un"]}
FACTORS = {"intensifier": 1.3, "negation": -0.8, "attenuator": 0.7}
EMOTION_VALENCE = {"joy": 1, "anger": -1, "fear": -1, "trust": 1}
EMOTIONS = {"joy": {"thou": 1.0, "heon": 0.5}, "anger": {"ered": 1.2, "trash": 2.0}, "fear": {"enth": 0.7}, "trust": {"from": 0.3, "with": 0.4}}
FEATURES = [f"ont_{c.lower()}" for c in CONCEPTS] + ["ont_count", "ont_density"]
MODULES = {f"ont_{c.lower()}": (c.lower(), c) for c in CONCEPTS} | {"ont_count": ("global_counts", None), "ont_density": ("global_counts", None)}
SELECTED = ["ont_alpha", "ont_gamma", "ont_density"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, author_id, titulo, texto, topic, lang, created, split."""
    d = table(spark, sf_dir, "documents")
    created = F.when(F.col("doc_id") % 10 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60))
    return d.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("author"),
        F.lit("").alias("title"), F.col("text").alias("body"), F.col("source").alias("topic"), "lang", created.alias("created"), split_of(F.col("doc_id")).alias("split"),
    )


def split_of(doc_id):
    return F.when(doc_id % 5 == 3, "val").when(doc_id % 5 == 4, "test").otherwise("train")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label in {0, 1, 2}."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return table(spark, sf_dir, "labels").select("doc_id", label.alias("label"))


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCABULARY, "concept string, term string, term_pos int")


def compounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, x) for c, xs in COMPOUNDS.items() for x in xs], "concept string, compound string")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "term string, valence double")


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept, term, term_pos: every word, word pair and word triple of the benchmark's texts, a vocabulary of some
    thousand terms; the concept is the first letter, the place the length."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    run = lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    grams = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(F.concat(*[run(n) for n in (1, 2, 3)])).alias("term")).distinct()
    return grams.select(F.substring("term", 1, 1).alias("concept"), "term", F.length("term").alias("term_pos"))


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, m, c) for f, (m, c) in MODULES.items()], "feature string, module string, concept string")


def selection(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, i) for i, f in enumerate(SELECTED)], "feature string, ord int")


#: What the schema of posts states; classes of places come from the tables.
SCHEMA = [
    ("Post", "rdfs:subClassOf", "Document"), ("Document", "rdfs:subClassOf", "Resource"), ("Author", "rdfs:subClassOf", "Agent"), ("Agent", "rdfs:subClassOf", "Resource"),
    ("author", "rdfs:subPropertyOf", "creator"), ("creator", "rdfs:subPropertyOf", "contributor"), ("contributor", "rdfs:range", "Agent"), ("author", "rdfs:range", "Author"),
    ("creator", "rdfs:domain", "Document"), ("topic", "rdfs:subPropertyOf", "relation"), ("topic", "rdfs:range", "Topic"), ("label", "rdfs:range", "Sentiment"),
]


def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, o: the statements above, and a class for each nation and region, nations below regions, regions below Place."""
    cls = lambda x: F.when(F.col(x).rlike("^[A-Z]"), F.concat(F.lit(BASE), x)).otherwise(F.col(x)).alias(x)
    stated = spark.createDataFrame(SCHEMA, "s string, p string, o string").select(cls("s"), "p", cls("o"))
    place = lambda kind, x: F.concat(F.lit(f"{BASE}{kind}_"), F.col(x).cast("string"))
    nations = table(spark, sf_dir, "nation").select(place("nation", "n_nationkey"), F.lit("rdfs:subClassOf"), place("region", "n_regionkey"))
    regions = table(spark, sf_dir, "region").select(place("region", "r_regionkey"), F.lit("rdfs:subClassOf"), F.lit(f"{BASE}Place"))
    return stated.union(nations).union(regions)


def customer_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers typed by their nation."""
    name = lambda kind, x: F.concat(F.lit(f"{BASE}{kind}_"), F.col(x).cast("string"))
    return table(spark, sf_dir, "customer").select(
        name("customer", "c_custkey").alias("s"), F.lit("rdf:type").alias("p"), name("nation", "c_nationkey").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")
    )


def damaged_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of all documents in which every kind of check finds some that pass and some that fail."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels(spark, sf_dir), "doc_id", "left")
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    every = lambda k: n % k == 0
    post, author, topic = (F.concat(F.lit(f"{BASE}{kind}_"), x) for kind, x in (("post", text), ("author", (n % 97).cast("string")), ("topic", F.col("source"))))
    tenth = lambda x: (x / 10).cast("decimal(3,1)").cast("string")
    a, b = n % 5, n % 4

    def row(p, o, kind="iri", dt=None):
        dt = dt if not isinstance(dt, str) and dt is not None else F.lit(dt).cast("string")
        return F.struct(post.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), o.alias("o"), (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"), dt.alias("o_datatype"))

    lit = "literal"
    made = F.array(
        row("rdf:type", F.lit(f"{BASE}Post")),
        row("identifier", F.when(every(31), "0").when(every(23), F.concat(F.lit("ID "), text)).otherwise(text), lit, "xsd:string"),
        row("created", F.when(~every(13), F.lit("2024-01-01T00:00:00")), lit, F.when(every(11), "xsd:date").otherwise("xsd:dateTime")),
        row("author", author, F.when(every(29), lit).otherwise("iri"), F.when(every(29), "xsd:string")),
        row("topic", F.when(~every(37), topic)),
        row("language", F.col("lang"), lit, "xsd:string"), row("language", F.when(every(17), F.lit("xx")), lit, "xsd:string"),
        row("length", F.length(F.trim("text")).cast("string"), lit, F.when(every(19), "xsd:string").otherwise("xsd:integer")),
        row("label", F.when(every(41), f"{BASE}Mixed").when(F.col("label") == 0, f"{BASE}Negative").when(F.col("label") == 1, f"{BASE}Neutral").when(F.col("label") == 2, f"{BASE}Positive")),
        row("probPos", F.when(every(43), F.lit("1.5")).otherwise(tenth(a)), lit, "xsd:decimal"), row("probNeu", tenth(b), lit, "xsd:decimal"),
        row("probNeg", tenth(F.when(every(7), 11 - a - b).otherwise(10 - a - b)), lit, "xsd:decimal"),
        row("intensity", F.when(every(2), F.when(every(6), F.lit("1.2")).otherwise("0.5")), lit, "xsd:decimal"),
        row("term", F.when(every(3), F.lit("x")), lit, "xsd:string"),
        row(F.when(every(2), "about").otherwise("belongs"), F.get(F.array(*[F.lit(f"{BASE}{c}") for c in CONCEPTS]), (n % 4).cast("int"))),
    )
    own = d.select(F.explode(made).alias("t")).select("t.*").where("o is not null")
    types = d.select(F.explode(F.array(F.struct(author.alias("s"), F.lit(f"{BASE}Author").alias("o")), F.struct(F.when(F.length("source") % 2 == 0, topic).alias("s"), F.lit(f"{BASE}Topic").alias("o")))).alias("t")).select("t.*").where("s is not null").distinct()
    none = F.lit(None).cast("string")
    shared = types.select("s", F.lit("rdf:type"), "o", F.lit("iri"), none)
    fixed = spark.createDataFrame([(f"{BASE}{s}", p, o if ":" in o else f"{BASE}{o}", kind, None) for s, p, o, kind in FIXED], own.schema)
    return own.union(shared).union(fixed)


#: Feelings of which one has no type, and concepts: in the scheme, in a literal, in none, and in it but no concept.
FIXED = [
    ("Positive", "rdf:type", "Sentiment", "iri"), ("Neutral", "rdf:type", "Sentiment", "iri"), ("Alpha", "rdf:type", "skos:Concept", "iri"), ("Beta", "rdf:type", "skos:Concept", "iri"),
    ("Gamma", "rdf:type", "skos:Concept", "iri"), ("Alpha", "skos:inScheme", "Domain", "iri"), ("Beta", "skos:inScheme", "Domain", "literal"), ("Delta", "skos:inScheme", "Domain", "iri"),
]
