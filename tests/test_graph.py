"""Inference, shapes and N-Triples against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracelex.operators import graph, inference, shapes
from tracelex.sources import files

B = graph.BASE
TRIPLE = "s string, p string, o string, o_kind string, o_datatype string"
SCHEMA = "s string, p string, o string"


def plain_closure(rows):
    known = set(rows)
    while True:
        more = {(s, r[2], o2) for s, p, o in known for s2, p2, o2 in known if o == s2 for r in inference.RULES if (r[0], r[1]) == (p, p2)} - known
        if not more:
            return known
        known |= more


def plain_entailed(triples, schema):
    """Every rule over and over until nothing is new."""
    known = set(triples)
    closed = plain_closure(schema)
    while True:
        more = set()
        for s, p, o, kind, dt in known:
            for a, rel, b in closed:
                if rel == graph.SUBPROPERTY and a == p:
                    more.add((s, b, o, kind, dt))
                if rel == graph.DOMAIN and a == p:
                    more.add((s, graph.RDF_TYPE, b, "iri", None))
                if rel == graph.RANGE and a == p and kind == "iri":
                    more.add((o, graph.RDF_TYPE, b, "iri", None))
                if rel == graph.SUBCLASS and p == graph.RDF_TYPE and a == o:
                    more.add((s, graph.RDF_TYPE, b, "iri", None))
        if more <= known:
            return known
        known |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_inference_is_the_fixpoint(spark, seed):
    """Random schemas with chains and cycles, over random triples: one pass gives what all rules give together."""
    rng = random.Random(seed)
    classes, props = [f"C{i}" for i in range(7)], [f"p{i}" for i in range(5)]
    schema = {(rng.choice(classes), graph.SUBCLASS, rng.choice(classes)) for _ in range(7)} | {(rng.choice(props), graph.SUBPROPERTY, rng.choice(props)) for _ in range(5)}
    schema |= {(rng.choice(props), rng.choice([graph.DOMAIN, graph.RANGE]), rng.choice(classes)) for _ in range(4)}
    nodes = [f"n{i}" for i in range(6)]
    triples = {(rng.choice(nodes), rng.choice(props), rng.choice(nodes), rng.choice(["iri", "literal"]), None) for _ in range(15)} | {(rng.choice(nodes), graph.RDF_TYPE, rng.choice(classes), "iri", None) for _ in range(4)}
    frame = spark.createDataFrame([*schema, (None, graph.SUBCLASS, "C1"), ("C1", "other", "C2")], SCHEMA)
    assert {(r.s, r.p, r.o) for r in inference.closed(frame).collect()} == plain_closure(schema)
    data = spark.createDataFrame(list(triples), TRIPLE).withColumn("c", F.lit(1))
    got = [tuple(r) for r in inference.inferred(data, frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_entailed(triples, schema)


def test_inference_of_nothing(spark):
    none, data = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", "p", "b", "iri", None)], TRIPLE)
    assert inference.closed(none).count() == 0 and [tuple(r) for r in inference.inferred(data, none).collect()] == [("a", "p", "b", "iri", None)]
    assert inference.inferred(data, none, False).count() == 0


def post(name, **changed):
    said = {"identifier": (name, "literal", "xsd:string"), "created": ("2024-01-01T00:00:00", "literal", "xsd:dateTime"), "author": (f"{B}author_1", "iri", None), "topic": (f"{B}topic_1", "iri", None),
            "language": ("en", "literal", "xsd:string"), "length": ("80", "literal", "xsd:integer"), "label": (f"{B}Positive", "iri", None), "probPos": ("0.6", "literal", "xsd:decimal"),
            "probNeu": ("0.3", "literal", "xsd:decimal"), "probNeg": ("0.1", "literal", "xsd:decimal"), "about": (f"{B}Alpha", "iri", None)}
    said |= changed
    return [(f"{B}post_{name}", "rdf:type", f"{B}Post", "iri", None)] + [(f"{B}post_{name}", p, *v) for p, vs in said.items() if vs for v in (vs if isinstance(vs, list) else [vs])]


COMMON = [(f"{B}author_1", "rdf:type", f"{B}Author", "iri", None), (f"{B}topic_1", "rdf:type", f"{B}Topic", "iri", None), (f"{B}Positive", "rdf:type", f"{B}Sentiment", "iri", None),
          (f"{B}Alpha", "rdf:type", "skos:Concept", "iri", None), (f"{B}Alpha", "skos:inScheme", f"{B}Domain", "iri", None)]


def results(spark, rows, schema=None):
    found = shapes.report(spark.createDataFrame(rows, TRIPLE).repartition(3), shapes.standard(), schema)
    return {(r.path, r.component): r.results for r in found.collect() if r.results}, shapes.summary(found).first()


def test_a_good_graph_conforms(spark):
    got, total = results(spark, COMMON + post("a1") + post("b2", term=("x", "literal", None)))
    assert got == {} and (total.conforms, total.results) == (True, 0)


def test_a_post_without_required_fields(spark):
    """The bad fixture: created, author and topic are missing, the language isn't allowed, the text is short."""
    got, total = results(spark, COMMON + post("bad", created=None, author=None, topic=None, language=("fr", "literal", "xsd:string"), length=("8", "literal", "xsd:integer")))
    assert got == {("created", "minCount"): 1, ("author", "minCount"): 1, ("topic", "minCount"): 1, ("language", "in"): 1, ("length", "range"): 1}
    assert (total.conforms, total.results, total.violations, total.warnings) == (False, 5, 4, 1)


@pytest.mark.parametrize(
    "changed,wanted",
    [
        ({"identifier": ("NOT OK", "literal", "xsd:string")}, {("identifier", "pattern"): 1}),
        ({"identifier": ("good", "literal", "xsd:string")}, {("identifier", "unique"): 2}),
        ({"created": [("2024-01-01T00:00:00", "literal", "xsd:date"), ("2024-01-02T00:00:00", "literal", "xsd:dateTime")]}, {("created", "datatype"): 1, ("created", "maxCount"): 1}),
        ({"author": (f"{B}author_1", "literal", None)}, {("author", "nodeKind"): 1, ("author", "class"): 1}),
        ({"topic": [(f"{B}topic_1", "iri", None), (f"{B}topic_2", "iri", None)]}, {("topic", "class"): 1}),
        ({"label": (f"{B}Mixed", "iri", None)}, {("label", "in"): 1, ("label", "class"): 1, ("probPos|probNeu|probNeg", "argmax"): 1}),
        ({"probPos": ("1.6", "literal", "xsd:decimal")}, {("probPos", "range"): 1, ("probPos|probNeu|probNeg", "probSum"): 1}),
        ({"probNeu": ("much", "literal", "xsd:string")}, {("probNeu", "range"): 1, ("probNeu", "datatype"): 1}),
        ({"probPos": ("0.3", "literal", "xsd:decimal"), "probNeg": ("0.4", "literal", "xsd:decimal")}, {("probPos|probNeu|probNeg", "argmax"): 1}),
        ({"label": None, "term": ("x", "literal", None)}, {("term", "implies"): 1}),
        ({"belongs": (f"{B}Beta", "iri", None)}, {("about|belongs", "scheme"): 1}),
        ({"about": (f"{B}Alpha", "literal", None)}, {("about|belongs", "scheme"): 1}),
    ],
)
def test_each_check_finds_its_fault(spark, changed, wanted):
    got, _ = results(spark, COMMON + post("good") + post("other", **changed))
    assert got == wanted


def test_inference_types_what_the_schema_says(spark):
    rows = COMMON[1:] + post("a1", label=(f"{B}Neutral", "iri", None), probPos=None)
    schema = spark.createDataFrame([("author", graph.RANGE, f"{B}Author"), ("label", graph.RANGE, f"{B}Sentiment")], SCHEMA)
    assert results(spark, rows)[0] == {("author", "class"): 1, ("label", "class"): 1} and results(spark, rows, schema)[0] == {}


def test_no_triples_conform(spark):
    assert results(spark, [])[1].conforms


ODD = ["", "plain", 'say "hi"', "line\nbreak\r\n\ttab", "back\\slash", "\\n is no break", "\\\\u0041", "ends in \\", "é 日本 🙂", "\b\f", "a . <b> \"@en", "'single'"]


def test_ntriples_come_back(spark, tmp_path):
    rows = [(f"{B}x_{i}", "text", t, "literal", dt, lang) for i, t in enumerate(ODD) for dt, lang in (("xsd:string", None), ("xsd:token", None), ("rdf:langString", "en-GB"))]
    rows += [(f"{B}x", "rdf:type", f"{B}Post", "iri", None, None), ("_:b0", "topic", "_:b1", "iri", None, None), ("http://other.org/a", "http://other.org/p", "http://other.org/b?c=d", "iri", None, None)]
    rows += [(f"{B}x", "length", "12", "literal", "xsd:integer", None), (f"{B}x", "odd", "1", "literal", "http://other.org/type", None)]
    df = spark.createDataFrame(rows, TRIPLE + ", o_lang string")
    path = files.write_lines(graph.ntriples(df), str(tmp_path / "nt"))
    assert sorted(map(str, files.read_ntriples(spark, path).collect())) == sorted(map(str, df.collect()))
    assert spark.read.text(path).count() == len(rows)


def test_ntriples_of_others(spark):
    lines = ['<http://a/s> <http://a/p> "caf\\u00E9 \\U0001F642 \\\\u0041"@fr . # said', "", "  # a comment", "\t_:x<http://a/p>_:y.", '<http://a/s> <http://a/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer>.', "no statement"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r.s, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in graph.parsed(df, strict=False).collect()}
    assert got == {("http://a/s", "café 🙂 \\u0041", "literal", "rdf:langString", "fr"), ("_:x", "_:y", "iri", None, None), ("http://a/s", "1", "literal", "xsd:integer", None)}
    with pytest.raises(Exception, match="no statement"):
        graph.parsed(df).collect()


def test_local_names_are_cleaned_once(spark, capsys):
    """A character of any width becomes one underscore; nulls and empty values are missing; the pattern runs once a row."""
    values = [None, "", "a b", "é\U0001f600-_\\", " ", "plain"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, v string").select("n", graph.sanitize_iri(F.col("v")).alias("s"))
    assert [r.s for r in df.orderBy("n").collect()] == ["missing", "missing", "a_b", "__-_\\", "_", "plain"]
    df.explain(True)
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("regexp_replace") == 1
