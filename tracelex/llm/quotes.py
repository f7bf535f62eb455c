"""Operator 4: quotation linking, in DataFrame functions only.

Lines that begin with '>' are quoted; the number of '>' in front is the level. Runs of lines of one level are passages.
A passage, and each of its paragraphs and lines, is normalised (lower case, white space collapsed), hashed, and joined to
the earliest message of the conversation whose own text has it as a whole, a paragraph or a line. The first-level
passages of a message name its parent: the message that the most quoted characters come from (ties: the later one).
Parents are followed to the thread's first message by pointer doubling, and messages are put in reply order
(conversation, first turn of the thread, turn) by a range partitioning, so that a conversation of any size spreads over
many tasks. Originals are looked for in the same conversation only: turns order messages inside a conversation, and
nothing orders two conversations, so a passage that both have names no original between them.

Originals are aggregated to one row for each (conversation, passage) before the join, which is a plain one that
adaptive execution can split; no group is gathered. The work on a message is in proportion to its length.

Cases: null text is empty; null conv_id or turn are never linked; a quote of something that no earlier message says has
no link; messages that share a turn are one place (repeated rows get equal results); a message without a link begins a
thread; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.llm.common import staged

#: Blanks and '>' up to the last '>' in front; the same as any number of '>' with blanks before them.
MARK = r"^[ \t>]*>"
BLANK = " \t\n\f\r"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\f\r]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (without quotes), passages (level, text), n_quoted lines, quote_depth."""
    clean = F.translate(F.coalesce("text", F.lit("")), "\u0001\u0002\r", "")
    level = lambda x: F.length(F.translate(F.regexp_extract(x, MARK, 0), " \t", ""))
    lines = F.transform(F.split(clean, "\n"), lambda x: F.struct(level(x).alias("level"), x.alias("text")))
    m = messages.select("conv_id", "turn", "role", lines.alias("lines"))
    # Each line beside the level of the one before it. Passages are cut where the level changes; \u0002 begins one, and its
    # level ends with \u0001. The list of levels is one longer: the line beside its last is null.
    before = F.concat(F.array(F.lit(-1)), F.transform("lines", lambda x: x.level))
    piece = lambda x, p: F.concat(
        F.when(x.level == p, F.lit("\n")).otherwise(F.concat(F.lit("\u0002"), x.level.cast("string"), F.lit("\u0001"))),
        F.regexp_replace(x.text, MARK + r"[ \t]?", ""),
    )
    runs = F.array_join(F.zip_with("lines", before, lambda x, p: F.when(x.isNull(), F.lit("")).otherwise(piece(x, p))), "")
    runs = F.filter(F.split(runs, "\u0002"), lambda x: x != "")
    runs = F.transform(runs, lambda x: F.struct(F.substring_index(x, "\u0001", 1).cast("int").alias("level"), F.substring_index(x, "\u0001", -1).alias("text")))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.text), "\n")
    return m.select(
        "conv_id", "turn", "role", F.btrim(own, F.lit(BLANK)).alias("body"),
        F.filter(runs, lambda r: r.level > 0).alias("passages"), F.size(F.filter("lines", lambda x: x.level > 0)).alias("n_quoted"),
        F.array_max(F.transform("lines", lambda x: x.level)).alias("quote_depth"),
    )


def units(text: Column) -> Column:
    """The whole, its paragraphs and its lines, normalised; each once."""
    parts = [F.array(text), F.split(text, "\n"), F.split(text, r"\n[ \t\n\f\r]*\n")]
    return F.filter(F.array_distinct(F.transform(F.concat(*parts), normal)), lambda x: x != "")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quoted, quote_depth, n_links, parent_turn, thread_turn, in reply order."""
    m = parsed(messages)
    quoted = m.where("n_quoted > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p"))
    quoted = quoted.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(units(F.col("p.text"))).alias("unit"))
    quoted = staged(quoted.groupBy("conv_id", "turn", "level", "unit").agg(F.count("*").alias("times")).withColumn("hash", F.xxhash64("unit")))
    told = quoted.select("conv_id").distinct()
    said = m.join(told, "conv_id", "left_semi").where("turn is not null").select("conv_id", "turn", F.explode(units(F.col("body"))).alias("unit"))
    said = said.groupBy("conv_id", F.xxhash64("unit").alias("hash"), "unit").agg(F.min("turn").alias("origin"))
    links = quoted.join(said, ["conv_id", "hash", "unit"]).where("origin < turn")
    links = staged(links.groupBy("conv_id", "turn", "level", "origin").agg(F.sum(F.length("unit") * F.col("times")).alias("chars"), F.count("*").alias("n")))
    per = links.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_links"), F.max(F.when(F.col("level") == 1, F.struct("chars", "origin"))).alias("best"))
    up = staged(per.where("best is not null").select("conv_id", "turn", F.col("best.origin").alias("thread")))
    while True:
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("above"))
        jumped = up.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        if not jumped.where("above is not null").limit(1).count():
            break
        up = staged(jumped.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread")))
    per = per.join(up, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_links", F.col("best.origin").alias("parent_turn"), "thread")
    out = m.drop("passages").join(per, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role", "body", F.col("n_quoted").cast("long"), F.col("quote_depth").cast("long"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "parent_turn", F.coalesce("thread", "turn").alias("thread_turn"),
    )
    order = ["conv_id", "thread_turn", "turn"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def op4_quotes(spark, sf_dir):
    from tracelex.llm.common import table

    return linked(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, role, unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))) AS line,
    unnest(range(1, 1 + len(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))))) AS i FROM conversations),
v AS (SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[ \t]', '', 'g')) AS level, regexp_replace(line, '^[ \t>]*>[ \t]?', '') AS rest FROM l),
m AS (SELECT conv_id, turn, role, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') AS body,
    count(*) FILTER (level > 0) AS n_quoted, max(level) AS quote_depth FROM v GROUP BY ALL),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM v),
p AS (SELECT conv_id, turn, level, run, string_agg(rest, chr(10) ORDER BY i) AS t FROM g WHERE level > 0 GROUP BY ALL),
q AS (SELECT conv_id, turn, level, unit, count(*) AS times FROM (SELECT DISTINCT conv_id, turn, level, run, trim(regexp_replace(lower(u), '[ \t\n\f\r]+', ' ', 'g')) AS unit
    FROM (SELECT *, unnest(list_concat([t], string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t\n\f\r]*\n'))) AS u FROM p)) WHERE unit <> '' GROUP BY ALL),
s AS (SELECT conv_id, unit, min(turn) AS origin FROM (SELECT conv_id, turn, trim(regexp_replace(lower(u), '[ \t\n\f\r]+', ' ', 'g')) AS unit
    FROM (SELECT *, unnest(list_concat([body], string_split(body, chr(10)), regexp_split_to_array(body, '\n[ \t\n\f\r]*\n'))) AS u FROM m)) WHERE unit <> '' GROUP BY ALL),
k AS (SELECT conv_id, turn, level, origin, sum(len(unit) * times) AS chars, count(*) AS n FROM q JOIN s USING (conv_id, unit) WHERE origin < turn GROUP BY ALL),
b AS (SELECT conv_id, turn, sum(n) AS n_links, (max(row(chars, origin)) FILTER (level = 1))[2] AS parent FROM k GROUP BY ALL),
r AS (SELECT conv_id, turn, parent AS root FROM b WHERE parent IS NOT NULL UNION SELECT r.conv_id, r.turn, b.parent FROM r JOIN b ON b.conv_id = r.conv_id AND b.turn = r.root WHERE b.parent IS NOT NULL),
t AS (SELECT conv_id, turn, min(root) AS root FROM r GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, m.body, m.n_quoted::BIGINT AS n_quoted, m.quote_depth::BIGINT AS quote_depth, coalesce(b.n_links, 0)::BIGINT AS n_links,
    b.parent AS parent_turn, coalesce(t.root, m.turn) AS thread_turn
FROM m LEFT JOIN b USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)
"""
