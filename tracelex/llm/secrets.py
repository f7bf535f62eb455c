"""Operator 7: secret scans by dictionary-primed zstandard novelty.

Base spans come from three patterns. The method adds spans of kind "novel". A text that holds a sensitive word
is a sensitive context as a whole; each of its runs of 16 or more key characters is a candidate, without points and dashes at
its ends. A run that sensitive words stand in is cut behind each of them (KEY=value), and its pieces are candidates. A
candidate's marginal cost is the number of bytes by which it lengthens the zstandard frame of the text around it, primed
with a dictionary; its other copies in that text, and those of its parts of 16 or more characters between signs, are
blanked first, so that a repeated key isn't free. The cost is set against the bits of a random string of the same
length over the same kinds of characters (26 for a case, 10 digits, 6 signs): what the dictionary or the surroundings know costs a part of that, random strings all of it. Runs without lower
case are also measured in lower case, as dictionaries know words in that form. Joined words of one case must cost
more than other runs, and unjoined lower case more than most random strings of it do: long words look like them.

The dictionary is trained (zstandard's own training) on the driver from a bounded source, the text of the modules of
Python's library named below, 2 KB at a time; another Python may give another one, so write the bytes and pass them as
`primed` where results must not change. The `identifiers` most frequent names of the corpus (words joined by underscores or
by capitals) and its `words` most frequent words of 4 to 15 letters, both without digits, so that no key enters, counted
over all texts, are put behind it. It has `size` bytes, whatever the corpus. Apart from that count, one pandas UDF over
whole texts, no shuffle; its time is in proportion to the text, also for one long run.

Cases: null is the empty text, which has no spans; candidates that overlap a base span add nothing; spans are code
points with an exclusive end; repeated rows are scanned one by one; an empty table gives an empty one; other columns,
whatever their names, are kept.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.llm.common import small_batches, unused

KINDS = ("assign", "access", "hex", "novel")

# The base patterns and the least length of what each must match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
#: Matches what HEX matches if it is long enough; a shorter run can't hide a longer one, since runs are maximal.
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

# Words that make the text after them sensitive, and modules of Python's library whose source is common code.
SENSITIVE = "password passwd pwd secret token apikey api_key auth authorization bearer credential private_key client_secret access_key signature connection_string"
MODULES = "argparse ast base64 calendar configparser csv datetime decimal email.message ftplib functools getpass hashlib hmac http.client http.server imaplib json.decoder logging logging.config multiprocessing.pool netrc os pathlib pickle platform random secrets shutil smtplib socket sqlite3 ssl string subprocess tarfile tempfile threading typing unittest.case urllib.parse urllib.request uuid zipfile"
#: Bytes of the dictionary, of a sample it is trained on, and how many of the corpus' identifiers and words are put behind it.
DICTIONARY, CHUNK, IDENTIFIERS, WORDS = 64 << 10, 2048, 1024, 2048
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[a-z]{2,}(?:_[a-z]{2,}){1,5}|[A-Z]{2,}(?:_[A-Z]{2,}){1,5}|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,}){1,5})(?![A-Za-z0-9_])"
WORD = r"(?<![A-Za-z0-9_])[A-Za-z][a-z]{3,14}(?![A-Za-z0-9_])"

_CONTEXT = re.compile(rf"(?:{'|'.join(SENSITIVE.split())})[^\n]{{0,24}}?[\s:=\"'(\[]", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Words of one case and at most two digits each, joined by separators or capitals, and unjoined lower case.
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]{2,}[0-9]{0,2}(?:[+/_.=-]+|(?=[A-Z])|$)|[A-Z]{2,}[0-9]{0,2}[+/_.=-]+|(?<=[+/_.=-])[A-Z]{2,}[0-9]{0,2}$)+")
_LOWER = re.compile(r"[A-Z]?[a-z]+")
#: Parts of a candidate: between equals signs, and between signs of any kind.
_PARTS = (re.compile(r"[A-Za-z0-9+/_.-]{16,}"), re.compile(r"[A-Za-z0-9]{16,}"))
#: The kinds of characters of a candidate, and how many a kind has.
_CLASSES = ((re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10), (re.compile(r"[+/_.=-]"), 6))
#: Characters of the surroundings on either side.
AROUND = (100, 200, 400)
#: Least share of a random string's bits that a candidate must cost; that of joined words; that of unjoined lower case.
RATIO, JOINED_RATIO, LOWER_RATIO = 0.85, 1.1, 1.2


def dictionary(docs: DataFrame, size: int = DICTIONARY, identifiers: int = IDENTIFIERS, words: int = WORDS) -> bytes:
    """The trained dictionary; docs: text."""
    import importlib
    import inspect

    import zstandard

    text, joined_names = F.coalesce("text", F.lit("")), F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    found = docs.select(text.alias("text")).select(F.explode(F.concat(joined_names, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("name"))
    counted = found.groupBy("name").count().withColumn("single", F.length("name").between(4, 15) & F.col("name").rlike("^[A-Za-z][a-z]+$"))
    best = [counted.where(F.col("single") == s).orderBy(F.desc("count"), "name").limit(n) for s, n in ((True, words), (False, identifiers))]
    rows = best[0].union(best[1]).orderBy("single", F.desc("count"), "name").collect()  # at most words + identifiers
    kept = [b"\n".join([r["name"].lower().encode() if s else r["name"].encode() for r in rows if r["single"] == s])[: size // 4] for s in (True, False)]
    names = b"\n".join(kept)
    source = [inspect.getsource(importlib.import_module(m)) for m in MODULES.split()]
    samples = [x[at : at + CHUNK].encode() for x in source for at in range(0, len(x), CHUNK)]
    # What follows a trained dictionary's tables is plain content.
    return zstandard.train_dictionary(size - len(names), samples).as_bytes() + names


@functools.lru_cache(maxsize=2)
def compressor(primed: bytes):
    import zstandard

    own = zstandard.ZstdCompressionDict(primed)
    own.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=own, write_checksum=False, write_content_size=False).compress


def marginal_bytes(text: str, start: int, end: int, primed: bytes, folded: bool = False) -> int:
    """By how many bytes a span lengthens the frame of what is around it, without its other copies: the median over
    surroundings of three sizes, since a frame's own coding changes in steps."""
    squeeze, value, costs = compressor(primed), text[start:end], []
    own, wide = (value.lower() if folded else value).encode(), AROUND[-1] + end - start
    # Copies are looked for a value's length beyond the surroundings, so that none is cut at their ends.
    before, after = text[max(0, start - wide) : start].replace(value, " "), text[end : end + wide].replace(value, " ")
    for runs in _PARTS:
        parts = {p for p in runs.findall(value) if p != value}
        if parts:
            before, after = (runs.sub(lambda m, p=parts: " " if m.group() in p else m.group(), side) for side in (before, after))
    for n in AROUND:
        around = (before[-n:] + after[:n]).encode()
        costs.append(len(squeeze(around + own)) - len(squeeze(around)))
    return sorted(costs)[len(costs) // 2]


def random_bytes(value: str) -> float:
    """Bytes of a random string as long as value, over the kinds of characters that value has."""
    return len(value) * math.log2(max(2, sum(n for kind, n in _CLASSES if kind.search(value)))) / 8


def novelty(text: str, start: int, end: int, primed: bytes) -> float:
    """Marginal cost as a share of a random string's; of a run without lower case, the lesser of its two forms' shares."""
    value = text[start:end]
    share = marginal_bytes(text, start, end, primed) / random_bytes(value)
    if not _CLASSES[0][0].search(value):
        share = min(share, marginal_bytes(text, start, end, primed, True) / random_bytes(value.lower()))
    return share


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters, cut behind the sensitive words in them; none without a sensitive word."""
    contexts, out, k = [m.end() for m in _CONTEXT.finditer(text)], [], 0
    if not contexts:
        return []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(contexts) and contexts[k] <= a:
            k += 1
        cuts = [a]
        while k < len(contexts) and contexts[k] < b:
            cuts.append(contexts[k])
            k += 1
        for x, y in zip(cuts, [*cuts[1:], b], strict=True):
            own = text[x:y]
            x, y = x + len(own) - len(own.lstrip(".-")), y - len(own) + len(own.rstrip(".-"))
            if y - x >= 16:
                out.append((x, y))
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], primed: bytes, ratio: float = RATIO, joined_ratio: float = JOINED_RATIO, lower: float = LOWER_RATIO) -> list[tuple[int, int, str]]:
    out, taken, k = [], sorted((a, b) for a, b, _ in base), 0
    for a, b in candidates(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if any(x < b and a < y for x, y in taken[k : k + 3]):
            continue
        least = lower if _LOWER.fullmatch(text, a, b) else joined_ratio if _PLAIN.fullmatch(text, a, b) else ratio
        if novelty(text, a, b, primed) >= least:
            out.append((a, b, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """text with each maximal run of overlapping spans replaced by mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


FIELDS = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, redacted string"


def scan(text: Column, primed: bytes, mark: str | None = None) -> Column:
    """A struct column of FIELDS; redacted is null without a mark, or if nothing was found."""

    @F.pandas_udf(FIELDS)
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            novel = novel_spans(text, base, primed)
            spans = sorted(base + novel, key=lambda s: (s[0], KINDS.index(s[2])))
            counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
            clean = redacted(text, spans, mark) if mark is not None and spans else None
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), clean))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return made(text)


def redact(docs: DataFrame, mark: str = "[SECRET]", primed: bytes | None = None) -> DataFrame:
    """docs with every span replaced by mark; n_chars, where docs has it, follows the text."""
    small_batches(docs.sparkSession)
    name = unused(docs, "found")
    out = docs.withColumn(name, scan(F.col("text"), primed or dictionary(docs), mark)["redacted"])
    changed = {"text": F.coalesce(name, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length(name)).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(docs.columns)


def op7_secrets(spark, sf_dir):
    from tracelex.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)
    out = docs.select("doc_id", scan(F.col("text"), dictionary(docs)).alias("s"))
    return out.select("doc_id", *(f"s.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")))
