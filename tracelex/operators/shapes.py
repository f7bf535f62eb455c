"""Constraint checks of a whole graph: shapes as a list, compiled to one aggregation of the triples by subject.

Checks of single values (datatype, pattern, closed list, node kind, range) become counters of that aggregation. So do those
that need another subject's triples (classes, schemes, repeated identifiers), once their bad objects, found by joins of
distinct objects, stand beside the triples as marks. What concerns a subject as a whole (least and most values, sums,
likeliest label, implications) is then a condition on its counters. No subject's triples are ever collected.

Cases: a path may have several predicates; a missing value breaks only a least count; null subjects and predicates take
no part; repeated triples count once for each row, so a graph is given without repeats; a subject is checked once however
often it is typed; no triples give a report of zeros; columns beside those of a triple are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.operators.graph import BASE, RDF_TYPE, TRIPLE
from tracelex.operators.inference import inferred

CONCEPT, IN_SCHEME = "skos:Concept", "skos:inScheme"


@dataclass(frozen=True)
class Shape:
    """A path of a class' subjects and what must hold for it. Any of: least and most values, a datatype, a pattern, a
    closed list, a class of the objects, IRIs only, lowest and highest number, a scheme that the objects are concepts of,
    values that no other subject has, a predicate that must stand beside the path; or of the path's three probabilities
    (positive, neutral, negative) that they add up to 1, and that a label's predicate names the likeliest."""

    target: str
    path: tuple[str, ...]
    least: int | None = None
    most: int | None = None
    datatype: str | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    cls: str | None = None
    iri: bool = False
    low: float | None = None
    high: float | None = None
    scheme: str | None = None
    unique: bool = False
    implies: str | None = None
    sums: bool = False
    argmax: str | None = None
    severity: str = "Violation"
    components: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        given = {"minCount": self.least is not None, "maxCount": self.most is not None, "datatype": self.datatype, "pattern": self.pattern, "in": self.one_of, "class": self.cls, "nodeKind": self.iri,
                 "range": self.low is not None or self.high is not None, "scheme": self.scheme, "unique": self.unique, "implies": self.implies, "probSum": self.sums, "argmax": self.argmax}
        object.__setattr__(self, "components", tuple(k for k, v in given.items() if v))


#: What a probability sum may be off by.
SLACK = 0.02


def own(path: tuple[str, ...]) -> Column:
    return F.col("p").isin(*path)


def _value_fails(shape: Shape, component: str) -> Column | None:
    """Whether a value of the path breaks a check that needs nothing else."""
    if component == "datatype":
        return F.coalesce("o_datatype", F.lit("")) != shape.datatype
    if component == "pattern":
        return ~F.col("o").rlike(shape.pattern)
    if component == "in":
        return ~F.col("o").isin(*shape.one_of)
    if component == "nodeKind":
        return F.col("o_kind") != "iri"
    if component == "range":
        v = F.col("o").try_cast("decimal(38,6)")
        return reduce(lambda a, b: a | b, [v.isNull()] + ([v < shape.low] if shape.low is not None else []) + ([v > shape.high] if shape.high is not None else []))
    return None


def _object_marks(triples: DataFrame, shape: Shape, component: str, name: str) -> DataFrame | None:
    """s, mark: a row for each value that breaks a check by what its object is elsewhere in the graph."""
    values = triples.where(own(shape.path))
    if component == "unique":
        pairs = values.select("s", "o").distinct()
        bad = pairs.groupBy("o").agg(F.count("*").alias("n")).where("n > 1").select("o")
        return pairs.join(bad, "o").select("s", F.lit(name).alias("mark"))
    if component == "class":
        good = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == shape.cls)).select(F.col("s").alias("o"))
    elif component == "scheme":
        concepts = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == CONCEPT)).select(F.col("s").alias("o"))
        good = concepts.join(triples.where((F.col("p") == IN_SCHEME) & (F.col("o") == shape.scheme)).select(F.col("s").alias("o")), "o", "left_semi")
    else:
        return None
    objects = values.select("o", "o_kind").distinct()
    bad = objects.join(good.distinct().withColumn("o_kind", F.lit("iri")), ["o", "o_kind"], "left_anti")
    return values.join(bad, ["o", "o_kind"]).select("s", F.lit(name).alias("mark"))


def _label(kind: str) -> str:
    return f"{BASE}{kind}"


def report(triples: DataFrame, shapes: list[Shape], schema: DataFrame | None = None) -> DataFrame:
    """target, path, component, severity, results: a row for each check. schema: triples that it implies are checked too."""
    rows = triples.select(*TRIPLE) if schema is None else inferred(triples, schema)
    checks = [(f"c{i}_{k}", shape, c) for i, shape in enumerate(shapes) for k, c in enumerate(shape.components)]
    marks = [m for name, shape, c in checks if (m := _object_marks(rows, shape, c, name)) is not None]
    none = F.lit(None).cast("string")
    every = reduce(DataFrame.union, [m.select("s", none.alias("p"), none.alias("o"), none.alias("o_kind"), none.alias("o_datatype"), "mark") for m in marks], rows.withColumn("mark", none))
    targets = {t: f"t{i}" for i, t in enumerate(dict.fromkeys(s.target for s in shapes))}
    sums = [F.max((F.col("p") == RDF_TYPE) & (F.col("o") == t)).alias(a) for t, a in targets.items()]
    found: dict[str, Column] = {}
    for name, shape, component in checks:
        mine = own(shape.path)
        fails = _value_fails(shape, component)
        if fails is not None:
            sums.append(F.count_if(mine & fails).alias(name))
            found[name] = F.col(name)
        elif component in ("class", "scheme", "unique"):
            sums.append(F.count_if(F.col("mark") == name).alias(name))
            found[name] = F.least(F.col(name), F.lit(1)) if component == "unique" else F.col(name)
        elif component in ("minCount", "maxCount"):
            sums.append(F.count_if(mine).alias(name))
            found[name] = (F.col(name) < shape.least if component == "minCount" else F.col(name) > shape.most).cast("long")
        elif component == "implies":
            sums += [F.count_if(mine).alias(name), F.count_if(F.col("p") == shape.implies).alias(f"{name}_too")]
            found[name] = ((F.col(name) > 0) & (F.col(f"{name}_too") == 0)).cast("long")
        else:
            share = [F.max(F.when(F.col("p") == p, F.col("o").try_cast("decimal(38,6)"))).alias(f"{name}_{i}") for i, p in enumerate(shape.path)]
            sums += [*share, F.max(F.when(F.col("p") == (shape.argmax or ""), F.col("o"))).alias(f"{name}_l")]
            pos, neu, neg = (F.col(f"{name}_{i}") for i in range(3))
            best = F.when((pos >= neu) & (pos >= neg), _label("Positive")).when((neu >= pos) & (neu >= neg), _label("Neutral")).otherwise(_label("Negative"))
            bad = F.abs(pos + neu + neg - 1) > SLACK if component == "probSum" else F.col(f"{name}_l") != best
            all_there = pos.isNotNull() & neu.isNotNull() & neg.isNotNull()
            found[name] = F.coalesce((all_there & bad).cast("long"), F.lit(0))
    subjects = every.where("s is not null").groupBy("s").agg(*sums)
    total = subjects.agg(*[F.coalesce(F.sum(F.when(F.col(targets[shape.target]), found[name])), F.lit(0)).alias(name) for name, shape, _ in checks])
    each = F.array(*[F.struct(F.lit(shape.target).alias("target"), F.lit("|".join(shape.path)).alias("path"), F.lit(c).alias("component"), F.lit(shape.severity).alias("severity"), F.col(name).alias("results")) for name, shape, c in checks])
    return total.select(F.explode(each).alias("x")).select("x.*")


def summary(checks: DataFrame) -> DataFrame:
    """conforms, results, violations, warnings of a report; warnings too keep a graph from conforming."""
    of = lambda kind: F.sum(F.when(F.col("severity") == kind, F.col("results")).otherwise(0))
    return checks.agg((F.sum("results") == 0).alias("conforms"), F.sum("results").alias("results"), of("Violation").alias("violations"), of("Warning").alias("warnings"))


def standard(base: str = BASE) -> list[Shape]:
    """The checks of posts and concepts."""
    post, share = f"{base}Post", {"datatype": "xsd:decimal", "low": 0, "high": 1}
    return [
        Shape(post, ("identifier",), datatype="xsd:string", pattern="^[0-9a-z]+$", least=1, most=1),
        Shape(post, ("created",), datatype="xsd:dateTime", least=1, most=1),
        Shape(post, ("author",), cls=f"{base}Author", iri=True, least=1, most=1),
        Shape(post, ("topic",), cls=f"{base}Topic", iri=True, least=1),
        Shape(post, ("language",), datatype="xsd:string", one_of=("es", "en"), least=1, most=1),
        Shape(post, ("length",), datatype="xsd:integer", low=40, severity="Warning"),
        Shape(post, ("label",), one_of=tuple(f"{base}{x}" for x in ("Positive", "Neutral", "Negative")), cls=f"{base}Sentiment", most=1),
        *[Shape(post, (p,), **share) for p in ("probPos", "probNeu", "probNeg", "intensity")],
        Shape(post, ("probPos", "probNeu", "probNeg"), sums=True, argmax="label"),
        Shape(post, ("term",), implies="label"),
        Shape(post, ("about", "belongs"), scheme=f"{base}Domain"),
        Shape(post, ("identifier",), unique=True),
        Shape(CONCEPT, (IN_SCHEME,), least=1, iri=True),
    ]
