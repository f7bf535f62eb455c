"""Inference over triples from a schema: subclasses, subproperties, domains and ranges together.

The schema is closed first, by semi-naive rounds: only the pairs that the round before found meet the stated ones again.
Every rule extends a chain to the right, so that is enough. With the schema closed, no triple needs a second round: one
pass gives each triple its super-properties, and every class that follows from its type, domains and ranges.

Cases: cycles end, since pairs already known are dropped; nulls take part in nothing; repeated rows count once; an empty
schema infers nothing; literals have no types; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelex.operators.graph import DOMAIN, RANGE, RDF_TYPE, SUBCLASS, SUBPROPERTY, TRIPLE
from tracelex.sources import files

# Fixed values, the entailment rules: a chain of the first and the second relation implies the third.
RULES = [
    (SUBCLASS, SUBCLASS, SUBCLASS),
    (SUBPROPERTY, SUBPROPERTY, SUBPROPERTY),
    (SUBPROPERTY, DOMAIN, DOMAIN),
    (SUBPROPERTY, RANGE, RANGE),
    (DOMAIN, SUBCLASS, DOMAIN),
    (RANGE, SUBCLASS, RANGE),
]


def closed(schema: DataFrame) -> DataFrame:
    """p, s, o: everything that the schema's relations imply together. A job runs for each round, as many as the longest
    chain has links; rounds are written to the shared folder."""
    spark = schema.sparkSession
    kept = lambda df: files.through_parquet(df, files.scratch(spark))
    base = kept(schema.where(F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE) & F.col("s").isNotNull() & F.col("o").isNotNull()).select("p", "s", "o").distinct())
    rules = F.broadcast(spark.createDataFrame(RULES, "p string, then string, implied string"))
    known = delta = base
    while True:
        step = delta.join(rules, "p").select("then", "implied", "s", F.col("o").alias("via"))
        met = step.join(base.select(F.col("p").alias("then"), F.col("s").alias("via"), "o"), ["then", "via"])
        found = met.select(F.col("implied").alias("p"), "s", "o").distinct()
        delta = kept(found.join(known, ["p", "s", "o"], "left_anti"))
        if delta.isEmpty():
            return known
        known = kept(known.union(delta))


def inferred(triples: DataFrame, schema: DataFrame, stated: bool = True) -> DataFrame:
    """The triples and what the schema implies of them: super-properties, and types by domain, range and class. stated: with
    the given triples, or what follows only (which may repeat a given one)."""
    rules = closed(schema)
    pairs = lambda p, *names: rules.where(F.col("p") == p).select(F.col("s").alias(names[0]), F.col("o").alias(names[1]))
    typed = lambda df: df.select("s", F.lit(RDF_TYPE).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    rows = triples.select(*TRIPLE)
    wider = rows.join(pairs(SUBPROPERTY, "p", "q"), "p").select("s", F.col("q").alias("p"), "o", "o_kind", "o_datatype")
    # Shared subjects and objects have their classes once before anything is shuffled.
    by_domain = rows.join(pairs(DOMAIN, "p", "c"), "p").select("s", F.col("c").alias("o"))
    by_range = rows.where("o_kind = 'iri'").join(pairs(RANGE, "p", "c"), "p").select(F.col("o").alias("s"), F.col("c").alias("o"))
    by_class = rows.where(F.col("p") == RDF_TYPE).join(pairs(SUBCLASS, "o", "c"), "o").select("s", F.col("c").alias("o"))
    out = wider.union(typed(by_domain.union(by_range).union(by_class)))
    return (rows.union(out) if stated else out).distinct()

