"""Operator 1: SentencePiece encoding with seeded merge dropout, and lossless decoding.

A text is cut into units that no piece crosses (a run of spaces with the word after it; line breaks and tabs alone).
In each unit an agenda holds the candidate merges by score; the best is taken, and is skipped if a keyed hash of
(seed, text key, place in the text, position, piece) falls below the dropout rate, so that every occurrence of a unit
draws for itself. What a unit becomes depends on its draws only by which of them skip: the way of each (unit, skipped
draws) is worked out once in a batch of texts, and each occurrence follows it until a draw of its own leaves
it. Without dropout the ids are those of the public library. Spaces are kept as they are
and only the one in front is added and removed; the mark U+2581 itself, which the library reads as a space, is
spelled in bytes here, so that every text decodes to itself.

Cases: null and empty texts have no tokens and decode to the empty text; the text key is the doc_id (null: an empty
key), so repeated rows get equal ids; characters without a piece become byte pieces; any other columns are kept.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelex.llm.common import TOKENIZERS, small_batches

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
#: Characters that are worked on at a time.
PART = 1_000_000
#: Units that are worked on in step at a time: few enough that their arrays stay in a core's cache.
STEP = 8192
INF = np.int32(2**31 - 1)

MASK = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.text, self.byte = {}, {}, [], [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte[b] = i
                self.text.append(chr(b) if b < 128 else chr(0xDC00 + b))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append("")
            else:
                piece = piece.replace("▁", " ")
                self.ids[piece], self.score[piece] = i, (-sp.get_score(i), i)
                self.text.append(piece)
        long = [p for p in self.ids if len(p) > 1]
        if any(" " in p[1:] and p.strip(" ") for p in long):
            raise ValueError("a piece goes on after a space: texts can't be cut at spaces")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        self.units = re.compile(rf" +[^ {alone}]*|[^ {alone}]+|[{alone}]" if alone else r" +[^ ]*|[^ ]+")

    def segment(self, unit: str, key: int, cut: int) -> tuple[int, ...]:
        """Ids of a unit. key: the key of its occurrence; a merge is skipped if its hash is below cut."""
        score, ids, n = self.score, self.ids, len(unit)
        if not cut and unit in ids:
            return (ids[unit],)
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(unit[i : i + 2])
            if s is not None:
                agenda.append((s[0], i, s[1], unit[i : i + 2]))
        heapify(agenda)
        while agenda:
            _, i, number, piece = heappop(agenda)
            a = parts[i]
            if a is None:
                continue
            j = right[i]
            if j >= n or len(a) >= len(piece) or a + parts[j] != piece:
                continue
            if cut:
                h = (key + i * _A + number * _B) & MASK
                h = ((h ^ (h >> 30)) * _C) & MASK
                if h ^ (h >> 31) < cut:
                    continue
            parts[i], parts[j] = piece, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                s = score.get(piece + parts[k])
                if s is not None:
                    heappush(agenda, (s[0], i, s[1], piece + parts[k]))
            k = left[i]
            if k >= 0:
                s = score.get(parts[k] + piece)
                if s is not None:
                    heappush(agenda, (s[0], k, s[1], parts[k] + piece))
        out = []
        for p in parts:
            if p is not None:
                i = ids.get(p)
                if i is None:
                    out += [self.byte[b] for b in p.encode()]
                else:
                    out.append(i)
        return tuple(out)

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.text.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pairs:
    """(left symbol, right symbol) -> merged piece and its rank, by open addressing; a symbol is the id of a piece, or
    FIRST plus the code point of a character without one."""

    FIRST, BITS = 1 << 20, 20

    def __init__(self, v: Vocabulary):
        number = lambda t: v.ids.get(t, self.FIRST + ord(t) if len(t) == 1 else None)
        ranks = {s: r for r, s in enumerate(sorted({s[0] for s in v.score.values()}))}
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.FIRST
        for p, i in v.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        for c in "\n\t\r":
            if c not in v.ids:
                self.symbol[ord(c)] = v.byte[ord(c)]
        rows = []
        for piece, i in v.ids.items():
            for at in range(1, len(piece)):
                a, b = number(piece[:at]), number(piece[at:])
                if a is not None and b is not None:
                    rows.append((a << 22 | b, ranks[v.score[piece][0]], i))
        table = np.array(rows, np.int64)
        self.key, self.rank, self.id = np.full(1 << self.BITS, -1), np.full(1 << self.BITS, INF, np.int32), np.zeros(1 << self.BITS, np.int32)
        while len(table):
            slot = self._slot(table[:, 0])
            while (taken := self.key[slot] >= 0).any():
                slot[taken] = (slot[taken] + 1) & ((1 << self.BITS) - 1)
            own, first = np.unique(slot, return_index=True)
            self.key[own], self.rank[own], self.id[own] = table[first, 0], table[first, 1], table[first, 2]
            table = np.delete(table, first, axis=0)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(_A)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 22 | b
        slot = self._slot(key)
        held = self.key[slot]
        wrong = np.flatnonzero((held != key) & (held >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.BITS) - 1)
            held = self.key[slot[wrong]]
            wrong = wrong[(held != key[wrong]) & (held >= 0)]
        return self.rank[slot], self.id[slot]


class Encoder:
    """Works out each distinct way of a batch's units once, all units of like length in step: in each round every
    unit takes the best candidate of its own agenda. A way is a unit with the rounds whose candidate is skipped."""

    #: Rounds whose skips a way can name; an occurrence that skips a later one is worked out by itself.
    ROUNDS = 64

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        self.vocabulary, self.seed = vocabulary(path), seed
        self.pairs = pairs(path)
        self.cut = min(MASK, int(dropout * 2**64))
        self.keys = [xxhash.xxh64_intdigest(f"{seed}:{v}") for v in range(4)]

    def _in_step(self, units: list[str], skips: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of units of at most `length` characters, as one array, and how many each has; what the draws of
        their rounds add to a key, as one array, and how many each has."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        width = np.arange(length)
        sym = np.full((len(units), length), -1, np.int32)
        sym[width < n[:, None]] = self.pairs.symbol[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        # A symbol stands at the place of its first character; its neighbours' places are linked, -1 at either end.
        after, before = np.tile((width + 1).astype(np.int8), (len(units), 1)), np.tile((width - 1).astype(np.int8), (len(units), 1))
        after[np.arange(len(units)), n - 1] = -1
        rank, made = np.full((len(units), length), INF, np.int32), np.zeros((len(units), length), np.int32)
        r, c = np.nonzero(width[None, 1:] < n[:, None])
        rank[r, c], made[r, c] = self.pairs.find(sym[r, c], sym[r, c + 1])
        done, row = sym.copy(), np.arange(len(units))
        drawn, terms, at_round = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while len(row):
            j = rank.argmin(axis=1)
            live = rank[np.arange(len(row)), j] < INF
            if live.sum() < 0.8 * len(row):
                done[row[~live]] = sym[~live]
                row, sym, after, before, rank, made, skips, j = (x[live] for x in (row, sym, after, before, rank, made, skips, j))
                if not len(row):
                    break
                live = np.ones(len(row), bool)
            symbols, behind, ahead, ranks, pieces = (x.reshape(-1) for x in (sym, after, before, rank, made))  # views
            m = np.flatnonzero(live)
            at = j[m]
            start = m * length
            cell = start + at
            if self.cut:
                with np.errstate(over="ignore"):
                    terms.append(at.astype(np.uint64) * np.uint64(_A) + pieces[cell].astype(np.uint64) * np.uint64(_B))
                drawn.append(row[m])
                if at_round < self.ROUNDS:
                    skip = (skips[m] >> np.uint64(at_round)) & np.uint64(1) > 0
                    ranks[cell[skip]] = INF
                    at, start, cell = at[~skip], start[~skip], cell[~skip]
            at_round += 1
            gone = start + behind[cell]
            symbols[cell], symbols[gone] = pieces[cell], -1
            ranks[cell], ranks[gone] = INF, INF
            behind[cell] = behind[gone]
            right, left = behind[cell] >= 0, ahead[cell] >= 0
            x, y = (start + ahead[cell])[left], (start + behind[cell])[right]
            ahead[y] = at[right]
            first, second = np.append(x, cell[right]), np.append(cell[left], y)
            ranks[first], pieces[first] = self.pairs.find(symbols[first], symbols[second])
        done[row] = sym
        drawn = np.concatenate(drawn)
        kept = done >= 0
        return done[kept], kept.sum(axis=1), np.concatenate(terms)[np.argsort(drawn, kind="stable")], np.bincount(drawn, minlength=len(units))

    def _ways(self, units: list[str], skips: np.ndarray) -> tuple[np.ndarray, ...]:
        """ids of all ways in one array, where each way's begin, and how many; the same of the terms of their draws."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        flat, start, count, held = [np.zeros(0, np.int32)], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        terms, first, draws, told = [np.zeros(0, np.uint64)], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        for low, high in ((0, 2), (2, 6), (6, 9), (9, 14), (14, 24), (24, 48)):
            every = np.flatnonzero((n > low) & (n <= high))
            for own in np.split(every, range(STEP, len(every), STEP)) if len(every) else ():
                ids, size, term, rounds = self._in_step([units[i] for i in own], skips[own], high)
                start[own], count[own] = held + np.cumsum(size) - size, size
                first[own], draws[own] = told + np.cumsum(rounds) - rounds, rounds
                flat.append(ids)
                terms.append(term)
                held, told = held + len(ids), told + len(term)
        all_ids = np.concatenate(flat)
        made = np.flatnonzero(count)
        made = made[np.argsort(start[made])]
        odd = made[np.unique(np.searchsorted(start[made], np.flatnonzero(all_ids >= Pairs.FIRST), "right") - 1)]
        more = []
        for i in odd.tolist():  # characters without a piece
            ids = []
            for x in all_ids[start[i] : start[i] + count[i]].tolist():
                ids += [self.vocabulary.byte[b] for b in chr(x - Pairs.FIRST).encode()] if x >= Pairs.FIRST else [x]
            start[i], count[i] = held, len(ids)
            more.append(np.array(ids, np.int32))
            held += len(ids)
        return np.concatenate([all_ids, *more]), start, count, np.concatenate(terms), first, draws

    def _follow(self, names: list[str], which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For occurrences of units (places in names) with their keys: ids in one array, where each one's begin, and
        how many."""
        start, count = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        flat, held, alone = [np.zeros(0, np.int32)], 0, [np.zeros(0, np.int64)]
        long = (np.fromiter(map(len, names), np.int64, len(names)) > 48)[which]
        alone.append(np.flatnonzero(long))
        left = np.flatnonzero(~long)
        unit, way = np.unique(which[left], return_inverse=True)
        skips, tested = np.zeros(len(unit), np.uint64), np.zeros(len(unit), np.int64)
        while len(left):
            ids, begin, size, terms, first, draws = self._ways([names[i] for i in unit.tolist()], skips)
            # The draws up to a way's last skip are those that led to it.
            n = (draws - tested)[way]
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(left)), n)
            step = np.arange(len(owner)) - np.repeat(ends - n, n)
            with np.errstate(over="ignore"):
                h = terms[np.repeat((first + tested)[way], n) + step] + keys[left][owner]
                h = (h ^ (h >> np.uint64(30))) * np.uint64(_C)
            hit = np.flatnonzero((h ^ (h >> np.uint64(31))) < np.uint64(self.cut))
            off, at = np.unique(owner[hit], return_index=True)
            on = np.ones(len(left), bool)
            on[off] = False
            start[left[on]], count[left[on]] = held + begin[way[on]], size[way[on]]
            flat.append(ids)
            held += len(ids)
            at_round = step[hit[at]] + tested[way[off]]
            late = at_round >= self.ROUNDS
            alone.append(left[off[late]])
            off, at_round = off[~late], at_round[~late]
            left, code, back = left[off], *np.unique(way[off] * self.ROUNDS + at_round, return_inverse=True)
            unit, skips, tested = unit[code // self.ROUNDS], skips[code // self.ROUNDS] | np.uint64(1) << (code % self.ROUNDS).astype(np.uint64), code % self.ROUNDS + 1
            way = back
        for i in np.concatenate(alone).tolist():  # very long units, and very late skips
            ids = np.array(self.vocabulary.segment(names[which[i]], int(keys[i]), self.cut), np.int32)
            start[i], count[i] = held, len(ids)
            flat.append(ids)
            held += len(ids)
        return np.concatenate(flat), start, count

    def _segments(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of units that have one of self.keys each."""
        return self._follow(units, np.arange(len(units)), np.array(self.keys, np.uint64)[keys])

    def encode_all(self, texts: list[str | None], text_keys: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        some: list[tuple[int, np.ndarray]] = []
        number, indexes = numbers(), []

        def flush() -> None:
            nonlocal some, number, indexes
            if some:
                lengths = np.array([len(v) for _, v in some])
                which = np.concatenate(indexes)
                flat, start, size = self._follow(list(number), which, np.concatenate([v for _, v in some]))
                ends = np.cumsum(size)
                ids = flat[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))]
                cuts = ends[np.cumsum(lengths) - 1]
                for (i, _), piece in zip(some, np.split(ids, cuts[:-1]), strict=True):
                    out[i].append(piece)
            some, number, indexes = [], numbers(), []

        held = 0
        for i, (text, text_key) in enumerate(zip(texts, text_keys, strict=True)):
            place, seed = 0, np.uint64(xxhash.xxh64_intdigest(f"{self.seed}/{text_key}"))
            for part in parts_of(" " + text if text else ""):
                units = self.vocabulary.units.findall(part)
                with np.errstate(over="ignore"):
                    h = np.arange(place, place + len(units), dtype=np.uint64) * np.uint64(_A) + seed
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(_B)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(_C)
                some.append((i, h ^ (h >> np.uint64(31))))
                indexes.append(np.fromiter(map(number.__getitem__, units), np.int64, len(units)))
                place, held = place + len(units), held + len(part)
                if held > PART:
                    flush()
                    held = 0
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def encode(self, text: str | None, text_key: str = "") -> list[int]:
        return self.encode_all([text], [text_key])[0].tolist()


def numbers() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    out = defaultdict()
    out.default_factory = out.__len__
    return out


def parts_of(text: str):
    """text in parts of about PART characters, cut where a run of spaces begins."""
    at = 0
    while len(text) - at > PART:
        cut = text.find(" ", at + PART)
        while cut > 0 and text[cut - 1] == " ":
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


@functools.lru_cache(maxsize=2)
def pairs(path: str) -> Pairs:
    return Pairs(vocabulary(path))


@functools.lru_cache(maxsize=4)
def encoder(path: str, dropout: float, seed: int) -> Encoder:
    return Encoder(path, dropout, seed)


def encode(text: Column, key: Column, folder: str = TOKENIZERS, dropout: float = DROPOUT, seed: int = SEED) -> Column:
    """array<int>: the ids of each text."""

    @F.pandas_udf("array<int>")
    def made(texts: pd.Series, keys: pd.Series) -> pd.Series:
        own = encoder(f"{folder}/{MODEL}", dropout, seed)
        return pd.Series(own.encode_all(texts.tolist(), [k or "" for k in keys]), dtype=object)

    return made(text, key.cast("string"))


def decode(ids: Column, folder: str = TOKENIZERS) -> Column:
    """string: the text that ids encode; null for null."""

    @F.pandas_udf("string")
    def made(rows: pd.Series) -> pd.Series:
        v = vocabulary(f"{folder}/{MODEL}")
        return pd.Series([None if r is None else v.decode(r.tolist()) for r in rows], dtype=object)

    return made(ids)


def tokenized(docs: DataFrame, folder: str = TOKENIZERS, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, lang, source, ids: what a trainer reads."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "lang", "source", encode(F.col("text"), F.col("doc_id"), folder, dropout, seed).alias("ids"))


SUMMARY = "n_tokens long, n_byte_tokens long, n_chars long, ids_sha256 string, lossless boolean"


def op1_pieces(spark, sf_dir):
    """Encode each whole text with dropout, decode the ids, and digest both."""
    from tracelex.llm.common import table

    path = f"{TOKENIZERS}/{MODEL}"

    @F.pandas_udf(SUMMARY)
    def made(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        own, rows = encoder(path, DROPOUT, SEED), []
        low, high = min(own.vocabulary.byte), max(own.vocabulary.byte)
        for text, flat in zip(texts, own.encode_all(texts.tolist(), [k or "" for k in keys]), strict=True):
            flat, ids = flat.astype("<i4"), flat.tolist()
            odd = int(((flat >= low) & (flat <= high)).sum())
            rows.append((len(ids), odd, len(text or ""), hashlib.sha256(flat.tobytes()).hexdigest(), own.vocabulary.decode(ids) == (text or "")))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SUMMARY.split(", ")])

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", made("text", F.col("doc_id").cast("string")).alias("s")).select("doc_id", "s.*")
