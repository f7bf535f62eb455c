"""Operator 12: cross-tokenizer alignment.

Every text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B), both over the same bytes: a space and
the text. Byte offsets where a token of A and one of B end together cut the text into groups. They are found by divide and
conquer: in an interval between two shared cuts, the ends of A near the middle are looked up among the ends of B by
bisect, in windows that double until one is shared; both halves are then intervals of their own, and an interval without
a shared end is a group. All intervals of a batch of texts take each step together.

Token pairs of a group are linked. Corpus-wide counts (documents that hold a pair) need every document's pairs twice, so
documents are gathered in chunks of some CHUNK bytes of text: a chunk writes each of its pairs once, with the number of its
documents, and its documents refer to them by place. Pairs are shuffled, counted, and come back to their chunk; documents
are shuffled once, by chunk. Nothing is broadcast, and no key holds more rows than there are chunks.

Cases: null and empty texts, and texts that either vocabulary does not give back byte for byte, have no tokens and zeros;
rows with one doc_id, or none, are documents of their own; texts of any length are whole (one longer than CHUNK is a
chunk); an empty table gives an empty one; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelex.llm.common import TOKENIZERS, small_batches, staged, table

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Bytes of text in a chunk, pairs in a row of a chunk's list, links of a group from which equal tokens are counted first.
CHUNK, SLICE, DENSE = 24 << 20, 1 << 16, 4096

# The pattern that splits text before the merges of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space that are left to the slower encoder, since the pattern's look-ahead keeps a state for each character.
LONG_RUN = re.compile(r"\s{512,}")

#: Bits of a B id in a pair.
LOW = 16


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the others
    follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both vocabularies: token ids of texts, and the bytes of every id."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = f"{folder}/{BYTE_VOCABULARY}"
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
        self.a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a[i] = token
        self.fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_VOCABULARY}")
        self.b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size())]
        self.length = [np.array([*map(len, x)], np.int64) for x in (self.a, self.b)]
        # The strings of all ids, with what follows an id inside its side of a group, then at its end.
        self.written = np.array([b"%d%s" % (i, end) for n, ends in ((len(self.a), (b",", b"|")), (len(self.b), (b",", b";"))) for end in ends for i in range(n)], object)

    def ids_a(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text, None where either side does not give its bytes back."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            whole = " " + text
            a, raw = self.ids_a(whole), whole.encode()
            # The byte-level side only joins bytes, so its length tells; the other one may normalise.
            same = self.length[0][a].sum() == len(raw) and b"".join(map(self.b.__getitem__, b)) == raw
            out.append((a, np.array(b, np.int64)) if same else None)
        return out


@functools.lru_cache(maxsize=2)
def encoders(folder: str) -> Encoders:
    return Encoders(folder)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each entry, count of them, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends that both sides share, in order. Ends rise over all texts; last_a and last_b are the places of
    each text's last tokens, which are shared."""
    lo_a, lo_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    hi_a, hi_b, found = last_a, last_b, [(last_a, last_b)]
    while True:
        # Ends strictly inside are candidates; an interval needs one on each side.
        some = (lo_a < hi_a) & (lo_b < hi_b)
        lo_a, hi_a, lo_b, hi_b = lo_a[some], hi_a[some], lo_b[some], hi_b[some]
        if not len(lo_a):
            break
        middle = (lo_a + hi_a - 1) >> 1
        at = np.searchsorted(ends_b, ends_a[middle])
        hit = ends_b[at] == ends_a[middle]
        cut_a, cut_b = np.where(hit, middle, -1), np.where(hit, at, -1)
        open_, near = np.flatnonzero(~hit), 0
        while len(open_):
            far = 2 * near + 1
            m, first, last = middle[open_], lo_a[open_], hi_a[open_] - 1
            left, right = np.maximum(first, m - far), np.minimum(last, m + far)
            n_left, n_right = np.maximum(0, m - near - left), np.maximum(0, right - m - near)
            probe = np.concatenate([ranges(left, n_left), ranges(m + near + 1, n_right)])
            owner = np.concatenate([np.repeat(open_, n_left), np.repeat(open_, n_right)])
            at = np.searchsorted(ends_b, ends_a[probe])
            good = ends_b[at] == ends_a[probe]
            probe, owner, at = probe[good], owner[good], at[good]
            order = np.lexsort((np.abs(probe - middle[owner]), owner))
            owner, one = np.unique(owner[order], return_index=True)
            cut_a[owner], cut_b[owner] = probe[order[one]], at[order[one]]
            open_, near = open_[(cut_a[open_] < 0) & ((left > first) | (right < last))], far
        split = cut_a >= 0
        lo_a, hi_a, lo_b, hi_b, cut_a, cut_b = (x[split] for x in (lo_a, hi_a, lo_b, hi_b, cut_a, cut_b))
        found.append((cut_a, cut_b))
        lo_a, hi_a = np.concatenate([lo_a, cut_a + 1]), np.concatenate([cut_a, hi_a])
        lo_b, hi_b = np.concatenate([lo_b, cut_b + 1]), np.concatenate([cut_b, hi_b])
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    a.sort()
    b.sort()
    return a, b


class Batch:
    """The groups of a list of encoded texts: tokens of all texts in one array a side, `end_a` and `end_b` after each
    group's last token, `doc` the place of its text."""

    def __init__(self, enc: Encoders, tokens: list[tuple[np.ndarray, np.ndarray]]):
        self.enc, (self.a, self.b) = enc, (np.concatenate(x) for x in zip(*tokens, strict=True))
        self.n_a, self.n_b = (np.array([*map(len, x)], np.int64) for x in zip(*tokens, strict=True))
        self.ends = [np.cumsum(enc.length[k][x]) for k, x in enumerate((self.a, self.b))]
        last_a, last_b = np.cumsum(self.n_a) - 1, np.cumsum(self.n_b) - 1
        cut_a, cut_b = shared_cuts(*self.ends, last_a, last_b)
        self.end_a, self.end_b = cut_a + 1, cut_b + 1
        self.size_a, self.size_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)
        self.doc = np.searchsorted(last_a, cut_a)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, written out."""
        va, vb = len(self.enc.a), len(self.enc.b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        group_a, group_b = (np.repeat(np.arange(len(n)), n) for n in (self.size_a, self.size_b))
        a, b = self.a.copy(), self.b + 2 * va
        a[self.end_a - 1] += va
        b[self.end_b - 1] += vb
        code[np.arange(len(a)) + (self.end_b - self.size_b)[group_a]] = a
        code[np.arange(len(b)) + self.end_a[group_b]] = b
        words, out, at = self.enc.written[code].tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(words[at : at + n])[:-1]).hexdigest())
            at += n
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): how often each pair is linked in each text, by text and pair."""
        size, start_a, start_b = self.size_a * self.size_b, self.end_a - self.size_a, self.end_b - self.size_b
        thin = size <= DENSE
        of = np.repeat(np.flatnonzero(thin), self.size_a[thin])
        a = ranges(start_a[thin], self.size_a[thin])
        n = self.size_b[of]
        pair = np.repeat((self.doc[of] << (2 * LOW)) | (self.a[a] << LOW), n) | self.b[ranges(start_b[of], n)]
        pair, links = np.unique(pair, return_counts=True)
        for g in np.flatnonzero(~thin).tolist():
            (x, m), (y, k) = (np.unique(t[e - s : e], return_counts=True) for t, e, s in ((self.a, self.end_a[g], self.size_a[g]), (self.b, self.end_b[g], self.size_b[g])))
            pair = np.append(pair, (((self.doc[g] << LOW) | x[:, None]) << LOW | y).ravel())
            links = np.append(links, (m[:, None] * k).ravel())
        if not thin.all():
            pair, at = np.unique(pair, return_inverse=True)
            links = np.bincount(at, links).astype(np.int64)
        return pair >> (2 * LOW), pair & ((1 << (2 * LOW)) - 1), links


GROUP = "array<struct<start: long, end: long, a: array<int>, b: array<int>>>"


def groups(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and the groups of the text with their bytes (offsets over a space and the text) and ids, null without tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(folder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[list | None] = [None] * len(texts)
            for i, tokens in zip([i for i, t in enumerate(texts) if t], enc.encode([t for t in texts if t]), strict=True):
                if tokens:
                    x, a, b, end = Batch(enc, [tokens]), tokens[0].tolist(), tokens[1].tolist(), [0]
                    end += x.ends[0][x.end_a - 1].tolist()
                    ca, cb = [0, *x.end_a.tolist()], [0, *x.end_b.tolist()]
                    out[i] = [{"start": end[g], "end": end[g + 1], "a": a[ca[g] : ca[g + 1]], "b": b[cb[g] : cb[g + 1]]} for g in range(len(x.end_a))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, groups {GROUP}")


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
CHUNKED = f"chunk long, doc_id long, {COUNTS}, place binary, links binary, pairs array<long>, holders array<int>"
ARROW = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                   ("place", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))])


class Chunk:
    """Documents until there are CHUNK bytes of text: rows of documents, and each pair once."""

    def __init__(self):
        self.rows, self.pairs, self.links, self.size = [], [], [], 0

    def add(self, ids: list, texts: list, enc: Encoders) -> None:
        some = [i for i, t in enumerate(texts) if t]
        tokens = dict(zip(some, enc.encode([texts[i] for i in some]), strict=True))
        some = [i for i in some if tokens[i]]
        rows = [(d, 0, 0, 0, 0, "", 0) for d in ids]
        if some:
            x = Batch(enc, [tokens[i] for i in some])
            doc, pair, links = x.links()
            self.pairs.append(pair)
            self.links.append(links)
            n = len(some)
            each = zip(some, x.n_a.tolist(), x.n_b.tolist(), np.bincount(x.doc, minlength=n).tolist(), np.bincount(doc, links, n).astype(np.int64).tolist(), x.digests(), np.bincount(doc, minlength=n).tolist(), strict=True)
            for i, *row in each:
                rows[i] = (ids[i], *row)
        self.rows += rows
        self.size += sum(map(len, filter(None, texts)))

    def written(self, number: int) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        pairs, place, holders = np.unique(np.concatenate([none, *self.pairs]), return_inverse=True, return_counts=True)
        links, pack, at = np.concatenate([none, *self.links]).astype(np.int64), zstandard.ZstdCompressor(level=1).compress, 0
        for start in range(0, len(self.rows), 256):
            out = []
            for *row, n in self.rows[start : start + 256]:
                step = np.diff(place[at : at + n], prepend=0).astype(np.int32)
                out.append((number, *row, pack(step.tobytes()), pack(links[at : at + n].tobytes()), None, None))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)
        for start in range(0, len(pairs), SLICE):
            row = [number, *[None] * 8, pairs[start : start + SLICE], holders[start : start + SLICE].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW, strict=True)], schema=ARROW)


def chunked(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Rows of documents (their pairs by place in the chunk) and rows of the chunks' pairs, in one pass over the texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk = encoders(folder), Chunk()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(ids), 64):
                chunk.add(ids[start : start + 64], texts[start : start + 64], enc)
                if chunk.size >= CHUNK:
                    yield from chunk.written(number)
                    chunk, number = Chunk(), number + 1
        yield from chunk.written(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKED)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """One chunk: its documents and its pairs with their corpus-wide counts."""
    order = np.argsort(counts.column("pair").to_numpy())
    count, best = counts.column("count").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    unpack, n_best, total = zstandard.ZstdDecompressor().decompress, [], []
    for place, links in zip(documents.column("place").to_pylist(), documents.column("links").to_pylist(), strict=True):
        place, links = np.cumsum(np.frombuffer(unpack(place), np.int32), dtype=np.int64), np.frombuffer(unpack(links), np.int64)
        n_best.append(int(links[best[place]].sum()))
        total.append(int((links * count[place]).sum()))
    named = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(named | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": documents.column("groups_sha256")})


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair of ids linked, and whether no pair of its A id has more. A
    window holds the pairs of one A id, at most as many as B has ids."""
    pairs = rows.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", LOW)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links whose pair is its A id's commonest, and the sum of the
    links' counts."""
    rows = staged(chunked(docs, folder))
    held = rows.where("pairs IS NOT NULL").select("chunk", F.explode("pairs").alias("pair"))
    counts = held.join(pair_counts(rows), "pair").select(F.col("chunk").alias("of"), "pair", "count", "best")
    of_docs = rows.where("pairs IS NULL").select("chunk", *RESULT_INPUT)
    return of_docs.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(scored, RESULT)


RESULT_INPUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "links"]


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
