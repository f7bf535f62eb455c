"""Triples from posts and features, inference over a schema, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = "http://example.org/tracelex#"
RDF_TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
TRIPLE = ["s", "p", "o", "o_kind", "o_datatype"]


# The characters that an IRI's local name keeps.
LOCAL = r"[^A-Za-z0-9_\\-]"


def sanitize_iri(value: Column) -> Column:
    """One underscore for each character that is no ASCII letter, digit, underscore, backslash or hyphen."""
    # A character becomes a character, so the value says whether nothing is left, and the pattern runs once.
    return F.when(F.coalesce(value, F.lit("")) == "", "missing").otherwise(F.regexp_replace(value, LOCAL, "_"))


def iri(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}_"), sanitize_iri(value))


def label_iri(label: Column) -> Column:
    return F.when(label == 0, f"{BASE}Negative").when(label == 1, f"{BASE}Neutral").when(label == 2, f"{BASE}Positive")


def parsed_time(text: Column) -> Column:
    """A time from text, with or without an offset, T or fraction, or from a date; null if it can't be read."""
    return F.try_to_timestamp(F.trim(text))


def datetime_literal(created: Column) -> Column:
    """ISO text of a time in UTC; the epoch for null."""
    return F.date_format(F.coalesce(created, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss")


def post_triples(posts: DataFrame) -> DataFrame:
    """Eight triples for each post, and the types of authors and topics. posts: id (a key), author, topic, lang, body,
    created, label; nulls have no triple, but for the time (the epoch), and author and topic (`unknown`)."""
    post, author = iri("post", F.col("id")), iri("author", F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")))
    topic = iri("topic", F.coalesce(F.nullif("topic", F.lit("")), F.lit("unknown")))
    row = lambda s, p, o, kind, dt=None: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_datatype"))
    made = F.array(
        row(post, RDF_TYPE, F.lit(f"{BASE}Post"), "iri"), row(post, "identifier", F.col("id"), "literal", "xsd:string"), row(post, "author", author, "iri"),
        row(post, "topic", topic, "iri"), row(post, "language", F.col("lang"), "literal", "xsd:string"), row(post, "created", datetime_literal(F.col("created")), "literal", "xsd:dateTime"),
        row(post, "length", F.length(F.trim("body")).cast("string"), "literal", "xsd:integer"), row(post, "label", label_iri(F.col("label")), "iri"),
    )
    shared_types = F.array(row(author, RDF_TYPE, F.lit(f"{BASE}Author"), "iri"), row(topic, RDF_TYPE, F.lit(f"{BASE}Topic"), "iri"))
    # Eight of the ten begin with the post, whose id is a key; only the types of authors and topics can repeat.
    own = posts.select(F.explode(made).alias("t")).select("t.*").where("o is not null")
    shared = posts.select("author", "topic").distinct().select(F.explode(shared_types).alias("t")).select("t.*").distinct()
    return own.union(shared)


def concept_assertions(rows: DataFrame) -> DataFrame:
    """rows: id, concept, value. One `about` triple for each active concept."""
    on = rows.where("value <> 0 and concept is not null")
    return on.select(iri("post", F.col("id")).alias("s"), F.lit("about").alias("p"), F.concat(F.lit(BASE), "concept").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")).distinct()


def trace_map(posts: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each active cell, and one placeholder for a post without any. rows: id, feature, module, concept, value."""
    out = posts.select("id", "split").join(rows.where("value <> 0"), "id", "left")
    return out.select("id", "split", iri("post", F.col("id")).alias("post_iri"), "feature", "module", "concept", "value")


def trace_rows(features: DataFrame, names: list[str], modules: DataFrame) -> DataFrame:
    """The same from feature columns (with id and split) and the modules of features, a small table, in the row of the post:
    nothing is joined but the modules' names."""
    cells = F.filter(F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value")) for n in names]), lambda c: c.value != 0)
    out = features.select("id", "split", F.explode_outer(cells).alias("c")).select("id", "split", iri("post", F.col("id")).alias("post_iri"), "c.feature", "c.value")
    module = F.when(F.col("feature").isNotNull(), F.coalesce("module", F.lit("unmapped"))).alias("module")
    return out.join(modules, "feature", "left").select("id", "split", "post_iri", "feature", module, "concept", "value")


# The vocabularies that short names stand for.
PREFIXES = {
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd:": "http://www.w3.org/2001/XMLSchema#",
    "skos:": "http://www.w3.org/2004/02/skos/core#",
}

#: What a literal escapes, and how it is written.
ESCAPES = [("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f"), ('"', '"')]


def long_name(name: Column) -> Column:
    """The IRI of a short name; a name without a prefix is one of BASE, and IRIs stay."""
    out = F.when(name.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), name).otherwise(F.concat(F.lit(BASE), name))
    for short, full in PREFIXES.items():
        out = F.when(F.startswith(name, F.lit(short)), F.concat(F.lit(full), F.substr(name, F.lit(len(short) + 1)))).otherwise(out)
    return out


def short_name(iri_: Column, local: bool) -> Column:
    """The inverse; local: names of BASE lose it too, as predicates do."""
    out = F.when(F.startswith(iri_, F.lit(BASE)), F.substr(iri_, F.lit(len(BASE) + 1))).otherwise(iri_) if local else iri_
    for short, full in PREFIXES.items():
        out = F.when(F.startswith(iri_, F.lit(full)), F.concat(F.lit(short), F.substr(iri_, F.lit(len(full) + 1)))).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(f"\\{letter}"))
    return out


def unescaped(text: Column) -> Column:
    """Escapes of a literal undone. Escaped backslashes part the text first, so that what follows one is no escape."""

    def coded(part: Column, mark: str, digits: int, charset: str) -> Column:
        first = lambda x: F.decode(F.unhex(F.substr(x, F.lit(1), F.lit(digits))), charset)
        return F.array_join(F.transform(F.split(part, rf"\\{mark}"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(first(x), F.substr(x, F.lit(digits + 1))))), "")

    def plain(part: Column) -> Column:
        out = coded(coded(part, "u", 4, "UTF-16BE"), "U", 8, "UTF-32")
        for char, letter in [*ESCAPES, ("'", "'")]:
            out = F.replace(out, F.lit(f"\\{letter}"), F.lit(char))
        return out

    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda part: plain(part)), "\\")


def ntriples(triples: DataFrame) -> DataFrame:
    """line: each triple in N-Triples, literals escaped, with their datatype, or their language where there is a column
    o_lang and it isn't null. Strings are written plainly."""
    lang = F.concat(F.lit("@"), F.col("o_lang")) if "o_lang" in triples.columns else F.lit(None).cast("string")
    kind = F.when(F.col("o_datatype") != "xsd:string", F.concat(F.lit("^^<"), long_name(F.col("o_datatype")), F.lit(">")))
    text = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.coalesce(lang, kind, F.lit("")))
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), long_name(c), F.lit(">")))
    obj = F.when(F.col("o_kind") == "iri", node(F.col("o"))).otherwise(text)
    return triples.select(F.concat(node(F.col("s")), F.lit(" <"), long_name(F.col("p")), F.lit("> "), obj, F.lit(" .")).alias("line"))


# A statement of N-Triples; subject, predicate, then an IRI or node, or a literal with datatype or language.
STATEMENT = r'^\s*(<[^>]*>|_:\S+)\s*<([^>]*)>\s*(?:(<[^>]*>|_:[^\s"]*[^\s".])|"((?:[^"\\]|\\.)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'


def parsed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang of the statements among the lines of a column `value`; blank lines and comments
    are skipped. A line stands for itself, so files are split anywhere between lines. strict: any other line is an error,
    else it is left out."""
    part = lambda i: F.regexp_extract("value", STATEMENT, i)
    said = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(STATEMENT)
    if strict:
        said = said.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.col("value"))).cast("string")))
    else:
        said = said.where(good)
    node = lambda x: short_name(F.when(F.startswith(x, F.lit("<")), F.regexp_replace(x, "^<|>$", "")).otherwise(x), False)
    iri_ = part(3) != ""
    kind = F.when(part(6) != "", "rdf:langString").when(part(5) != "", short_name(part(5), False)).otherwise("xsd:string")
    return said.select(
        node(part(1)).alias("s"), short_name(part(2), True).alias("p"), F.when(iri_, node(part(3))).otherwise(unescaped(part(4))).alias("o"), F.when(iri_, "iri").otherwise("literal").alias("o_kind"),
        F.when(~iri_, kind).alias("o_datatype"), F.nullif(part(6), F.lit("")).alias("o_lang"),
    )


REPORT = ["focus", "path", "value", "component", "severity", "message"]


def _on(path: str | list[str]) -> Column:
    return F.col("p").isin(*([path] if isinstance(path, str) else path))


def _report(rows: DataFrame, focus: Column, path: str | list[str], value: Column, component: str, severity: str = "Violation", message: str = "") -> DataFrame:
    path = path if isinstance(path, str) else "|".join(path)
    return rows.select(focus.alias("focus"), F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(component).alias("component"), F.lit(severity).alias("severity"), F.lit(message or f"{component} of {path}").alias("message"))


def targets(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select("s").distinct()


def chk_count(triples: DataFrame, focus: DataFrame, path: str, least: int | None = None, most: int | None = None, severity: str = "Violation") -> DataFrame:
    n = triples.where(_on(path)).groupBy("s").agg(F.count("*").alias("n"))
    own = focus.join(n, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = own.where(F.col("n") < least) if least is not None else own.where(F.col("n") > most)
    return _report(bad, F.col("s"), path, F.col("n"), "minCount" if least is not None else "maxCount", severity)


def chk_value(triples: DataFrame, focus: DataFrame, path: str, bad: Column, component: str, severity: str = "Violation") -> DataFrame:
    own = triples.where(_on(path)).join(focus, "s", "left_semi")
    return _report(own.where(bad), F.col("s"), path, F.col("o"), component, severity)


def chk_datatype(triples, focus, path, datatype):
    return chk_value(triples, focus, path, F.coalesce(F.col("o_datatype"), F.lit("")) != datatype, "datatype")


def chk_pattern(triples, focus, path, pattern):
    return chk_value(triples, focus, path, ~F.col("o").rlike(pattern), "pattern")


def chk_in(triples, focus, path, values):
    return chk_value(triples, focus, path, ~F.col("o").isin(*values), "in")


def chk_node_kind(triples, focus, path):
    return chk_value(triples, focus, path, F.col("o_kind") != "iri", "nodeKind")


def chk_range(triples, focus, path, least=None, most=None, severity="Violation"):
    v = F.col("o").try_cast("decimal(38,6)")
    bad = v.isNull()
    if least is not None:
        bad = bad | (v < least)
    if most is not None:
        bad = bad | (v > most)
    return chk_value(triples, focus, path, bad, "range", severity)


def chk_class(triples: DataFrame, focus: DataFrame, path: str, cls: str) -> DataFrame:
    own = triples.where(_on(path)).join(focus, "s", "left_semi")
    bad = own.join(targets(triples, cls).select(F.col("s").alias("o")), "o", "left_anti")
    return _report(bad, F.col("s"), path, F.col("o"), "class")


def chk_unique(triples: DataFrame, path: str) -> DataFrame:
    own = triples.where(_on(path)).select("s", "o").distinct()
    twice = own.groupBy("o").agg(F.count("*").alias("n")).where("n > 1")
    return _report(own.join(twice, "o"), F.col("s"), path, F.col("o"), "unique")


def chk_implies(triples: DataFrame, given: str, wanted: str) -> DataFrame:
    """Subjects with one predicate but not the other."""
    have = triples.where(F.col("p") == given).select("s").distinct()
    return _report(have.join(triples.where(F.col("p") == wanted).select("s"), "s", "left_anti"), F.col("s"), wanted, F.lit(None), "implies")


def chk_scheme(triples: DataFrame, predicates: list[str], members: DataFrame) -> DataFrame:
    """Objects of the predicates that are no concept of the scheme. members: o."""
    own = triples.where(F.col("p").isin(*predicates))
    return _report(own.join(members, "o", "left_anti"), F.col("s"), "|".join(predicates), F.col("o"), "scheme")


def probabilities(triples: DataFrame) -> DataFrame:
    v = lambda p: F.max(F.when(F.col("p") == p, F.col("o").try_cast("double"))).alias(p)
    return triples.where(F.col("p").isin("probPos", "probNeu", "probNeg", "label")).groupBy("s").agg(v("probPos"), v("probNeu"), v("probNeg"), F.max(F.when(F.col("p") == "label", F.col("o"))).alias("label"))


def chk_prob_sum(triples: DataFrame, slack: float = 0.02) -> DataFrame:
    total = F.col("probPos") + F.col("probNeu") + F.col("probNeg")
    return _report(probabilities(triples).where(F.abs(total - 1) > slack), F.col("s"), "prob", F.round(total, 6), "probSum")


def chk_label_argmax(triples: DataFrame) -> DataFrame:
    """The label isn't the likeliest class; ties go to positive, then neutral."""
    pos, neu, neg = F.col("probPos"), F.col("probNeu"), F.col("probNeg")
    best = F.when((pos >= neu) & (pos >= neg), f"{BASE}Positive").when(neu >= neg, f"{BASE}Neutral").otherwise(f"{BASE}Negative")
    rows = probabilities(triples).where(pos.isNotNull() & neu.isNotNull() & neg.isNotNull())
    return _report(rows.where(F.col("label") != best), F.col("s"), "label", F.col("label"), "argmax")

