"""Operator 5: quality rules with tokeniser fertility.

Every whole text is tokenised with a public byte-level vocabulary, which gives characters per token and the entropy
of the text's tokens in bits. That vocabulary never falls back (each byte is a token of its own), so a second one, of
pieces with byte fallback, gives the share of the text's UTF-8 bytes that it can only spell as bytes. A text is rejected
outside the band of its language, or of its main script where the language has no band. A text of n tokens has log2(n)
bits at most, so below 256 tokens the least entropy shrinks in proportion to log2(n); every text is measured. One pass,
no shuffle: a pandas UDF makes the measures, and the other columns never leave the JVM.

`fit_bands` draws the bands from clean labelled texts: for each language and script, quantiles of a bounded sample.

Cases: a null text has no words; an empty or short text fails the base rules (under 20 words); unknown or null languages
use the script's band; repeated rows are judged one by one; any other columns are kept; an empty table gives an empty
one; runs of white space of any length are cut off before the pattern sees them, with the same tokens.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelex.llm.common import TOKENIZERS, small_batches, unused

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"

# The pattern that splits text before the merges of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of the pattern, and how long a run is taken out of its way (its look-ahead keeps a state for each character).
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")

#: Per language, else per script: least and most characters per token, most byte-fallback share, least entropy in bits
#: (from FULL tokens on). Those of the four languages and of Latin are what fit_bands gives over the labelled texts of the
#: test tables at sf0.1 (3,302 clean texts, of which 5 are outside; of 301 noisy ones 159 are); the other scripts, of which
#: there are no labelled texts, have wide ones by hand. Many characters per token mean prose that the vocabulary knows
#: well, so the upper end (MOST) isn't fitted: only runs of one character are beyond it.
BANDS = {
    "en": (2.145, 8.0, 0.018, 4.928),
    "fr": (1.927, 8.0, 0.015, 4.848),
    "de": (2.210, 8.0, 0.017, 4.871),
    "es": (2.054, 8.0, 0.015, 4.805),
    "Latin": (2.054, 8.0, 0.017, 4.852),
    "Cyrillic": (0.8, 6.0, 0.10, 3.5),
    "Greek": (0.4, 4.0, 0.20, 3.5),
    "Arabic": (0.4, 4.0, 0.20, 3.5),
    "Han": (0.3, 2.5, 0.60, 3.5),
    "other": (0.2, 8.0, 0.90, 3.0),
}
FULL, MOST = 256, 8.0

# First and last code point of the blocks that count for each script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Han": [(0x2E80, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)],
}

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double, kept boolean"
)


@functools.lru_cache(maxsize=2)
def encoding(folder: str):
    import tiktoken

    with open(f"{folder}/{BYTE_VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def spelled(folder: str) -> dict[int, None]:
    """A translation table that removes the characters that have a piece of their own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_VOCABULARY}")
    return {ord(p): None for i in range(sp.vocab_size()) if len(p := sp.id_to_piece(i)) == 1} | {0x20: None}


def repeat_words(words: list[bytes], n: int = 8) -> int:
    """Words inside n-word windows that are found twice or more, first ones included. Equal windows have equal
    hashes, and windows with an equal hash are compared word by word."""
    if len(words) < n + 1:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width = 1
    with np.errstate(over="ignore"):
        while width < n:
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    member = np.zeros(len(h), bool)
    member[order[1:][same]] = True
    member[order[:-1][same]] = True
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(member).tolist():
        groups.setdefault(tuple(words[i : i + n]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for found in groups.values():
        if len(found) > 1:
            edge[found] += 1
            edge[np.array(found) + n] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int, bool]:
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeated = repeat_words(words)
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated, failed


def script_of(text: str) -> str:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {s: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in blocks) for s, blocks in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] * 2 > sum(counts.values()) else "other"


def tokens(text: str, folder: str) -> list[int]:
    """Token ids. Of a long run of white space, all but the last character are one piece (the last one belongs to the
    text after it), as the pattern has it; at the text's end the whole run is one."""
    own, out, at = encoding(folder), [], 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += own.encode_ordinary(text[at : m.start()])
        out += own._encode_single_piece(text[m.start() : end])
        at = end
    return out + own.encode_ordinary(text[at:])


def fertility(text: str, folder: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, entropy."""
    ids = np.asarray(tokens(text, folder), np.int64)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    odd = len(text.translate(spelled(folder)).encode())
    return len(ids), len(text) / len(ids), odd / len(text.encode()), float(-(p * np.log2(p)).sum())


def verdict(measures: tuple[int, float, float, float], band: tuple[float, float, float, float]) -> bool:
    n, chars, share, entropy = measures
    least = band[3] * min(1.0, np.log2(max(n, 1)) / np.log2(FULL))
    return bool(band[0] <= chars <= band[1] and share <= band[2] and entropy >= least)


def measures(text: Column, lang: Column, folder: str = TOKENIZERS, bands: dict | None = None) -> Column:
    """A struct column of FIELDS for each row."""
    bands = bands or BANDS

    @F.pandas_udf(FIELDS)
    def made(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, code in zip(texts, langs, strict=True):
            text = text or ""
            base = base_measures(text)
            own = fertility(text, folder)
            band = bands.get(code) or bands[script_of(text)]
            rows.append((*base, *own, not base[-1] and verdict(own, band)))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return made(text, lang)


def fit_bands(docs: DataFrame, labels: DataFrame, folder: str = TOKENIZERS, per_group: int = 2000, tail: float = 0.002, margin: float = 0.1, entropy_margin: float = 0.2) -> dict:
    """Bands for each language and script of docs: the `tail` quantiles (characters per token and entropy from below, byte
    share from above) over at most `per_group` texts of quality 1, chosen by hash, that pass the base rules, widened by
    `margin`, and entropy, which a narrow subject lowers, by `entropy_margin`; it is scaled to FULL tokens first."""
    small_batches(docs.sparkSession)
    clean = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    own = docs.select("doc_id", "text", "lang").join(clean, F.col("doc_id") == F.col("_id")).drop("_id")
    script = F.pandas_udf(lambda s: s.map(lambda t: script_of(t or "")), "string")
    own = own.select("doc_id", script("text").alias("script"), "lang", measures(F.col("text"), F.col("lang"), folder).alias("m")).where("not m.base_failed")
    own = own.select("doc_id", F.explode(F.array_distinct(F.array("lang", "script"))).alias("group"), "m.*").where("group is not null")
    first = Window.partitionBy("group").orderBy(F.xxhash64("doc_id"), "doc_id")
    own = own.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_group)
    entropy = F.col("entropy") / F.least(F.lit(1.0), F.log2("n_tokens") / np.log2(FULL))
    q = own.groupBy("group").agg(F.percentile("chars_per_token", F.lit(tail)).alias("chars"), F.percentile("byte_share", F.lit(1 - tail)).alias("share"), F.percentile(entropy, F.lit(tail)).alias("entropy"))
    return {r.group: (r.chars * (1 - margin), MOST, r.share * (1 + margin), r.entropy * (1 - entropy_margin)) for r in q.collect()}


def judge(docs: DataFrame, folder: str = TOKENIZERS, bands: dict | None = None) -> DataFrame:
    """docs with a struct column of the measures, under a name that no column has."""
    small_batches(docs.sparkSession)
    name = unused(docs, "measures")
    return docs.withColumn(name, measures(F.col("text"), F.col("lang"), folder, bands))


def keep(docs: DataFrame, folder: str = TOKENIZERS, bands: dict | None = None) -> DataFrame:
    """The rows that pass the base rules and the bands, with the columns of docs."""
    out = judge(docs, folder, bands)
    return out.where(F.col(out.columns[-1])["kept"]).select(docs.columns)


def op5_fertility(spark, sf_dir):
    from tracelex.llm.common import table

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "measures.*")
