"""Text expressions: cleaning, term matching, mentions, windows. All are columns; patterns are Unicode-aware."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inline and fenced code; the boundary characters of short terms; the length from which a term is long.
CODE = r"`[^`]+`|```[\s\S]+?```"
BOUNDARY = r"[\s\-\(\)\[\]\{\}\.,;:!\?\"'`]"
LONG_FROM = 4
WINDOW = 5

MARK = "\u0001"


def clean_code_blocks(text: Column) -> Column:
    some = F.coalesce(text, F.lit(""))
    return F.when(F.contains(some, F.lit("`")), F.regexp_replace(some, CODE, " ")).otherwise(some)


def combine(*parts: Column, sep: str = " ") -> Column:
    """Parts joined by sep, nulls as empty texts, trimmed."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    out = filled[0]
    for p in filled[1:]:
        out = F.concat(out, F.lit(sep), p)
    return F.trim(out)


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def spaced(text: Column) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def spaced_count(text: Column) -> Column:
    """word_count of what `spaced` gives, by its spaces."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def boundary_split(lower: Column) -> Column:
    return F.split(lower, rf"(?U){BOUNDARY}")


def short_count(parts: Column, term: str) -> Column:
    """How often a term is one of the parts between boundary characters."""
    return F.size(F.filter(parts, lambda x: x == term))


def short_hits(lower: Column, term: str) -> Column:
    """How often a short term stands between boundary characters."""
    return short_count(boundary_split(lower), term)


def long_pattern(term: str) -> str:
    return rf"(?U)\b{re.escape(term)}\b"


def long_hit(lower: Column, term: str) -> Column:
    """Whether a longer term stands as a whole word."""
    return F.contains(lower, F.lit(term)) & F.regexp_like(lower, F.lit(long_pattern(term)))


def term_hits(lower: Column, term: str) -> Column:
    """Hits of a short term, or 1 for the presence of a long one."""
    if len(term) < LONG_FROM:
        return short_hits(lower, term).cast("double")
    return long_hit(lower, term).cast("double")


def quoted(term: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def long_pattern_of(term: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), quoted(term), F.lit(r"\b"))


def term_pattern_of(term: Column) -> Column:
    """term_pattern for a column of terms."""
    short = F.concat(F.lit(rf"(?U)(?:^|{BOUNDARY})"), quoted(term), F.lit(rf"(?={BOUNDARY}|$)"))
    return F.when(F.length(term) < LONG_FROM, short).otherwise(long_pattern_of(term))


def term_pattern(term: str) -> str:
    if len(term) < LONG_FROM:
        return rf"(?U)(?:^|{BOUNDARY}){re.escape(term)}(?={BOUNDARY}|$)"
    return long_pattern(term)


def collapsed(lower: Column) -> Column:
    """Words with one space between them, and without the mark."""
    return spaced(F.replace(lower, F.lit(MARK), F.lit("")))


def mention_positions(lower: Column, pattern: str, single: bool = False) -> Column:
    """Word index of each match of a pattern: the number of words left of it less one, at least 0. Linear in the text:
    each match gets a mark in front, and the marks are found in the words. single: white space is already collapsed."""
    return mention_positions_of(lower if single else collapsed(lower), F.lit(pattern))


def term_positions(single: Column, term: str, pattern: str) -> Column:
    """mention_positions of a pattern around a term, over texts whose white space is collapsed: only texts that contain the
    term are looked through."""
    return F.when(F.contains(single, F.lit(term)), mention_positions(single, pattern, True)).otherwise(F.array().cast("array<int>"))


def mention_positions_of(single: Column, pattern: Column) -> Column:
    """The same for a column of patterns, over texts whose white space is collapsed."""
    marked = F.regexp_replace(single, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{MARK}$1"))
    found = F.transform(
        F.split(marked, " "),
        lambda w, i: F.when(F.contains(w, F.lit(MARK)), F.transform(
            F.sequence(F.lit(1), F.size(F.split(w, MARK)) - 1),
            lambda k: F.when((k == 1) & F.startswith(w, F.lit(MARK)), F.greatest(i - 1, F.lit(0))).otherwise(i),
        )).otherwise(F.array().cast("array<int>")),
    )
    return F.flatten(found)


def mention_window(word_list: Column, at: Column, window: int = WINDOW) -> Column:
    """Words from `window` before to `window` after a position, clipped."""
    first = F.greatest(at - window, F.lit(0))
    return F.slice(word_list, first + 1, at + window + 1 - first)


def mention_class(polarity: Column) -> Column:
    return F.when(polarity > 0.5, "positive").when(polarity < -0.5, "negative").otherwise("neutral")
