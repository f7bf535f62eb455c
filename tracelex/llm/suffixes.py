"""Operator 10: suffix-array removal of repeated byte strings.

A byte goes if a K-byte string that covers it also starts earlier (smaller doc_id, or earlier in the document).

1. Anchors. In each K-byte string the 32-byte gram with the least hash is its anchor, so equal strings have equal
   anchors at equal places. Consecutive strings with the same anchor are one row: anchor, digest of the bytes that the
   strings span (the context), document, first start, how many starts. This is 3 rows in 100 bytes, whole texts.
2. Anchors that occur twice are found by counting. A bit map of fixed size lets the second pass drop most others
   before the shuffle; an exact join drops the rest.
3. Of rows with equal anchor and context, all but the first repeat an earlier text: all their strings go. The digest is
   BLAKE2b of the bytes (64 bits), beside the anchor's own 64 bits and the number of starts.
4. Anchors with several contexts may still share strings. Their first contexts' bytes are dealt by anchor into WAVES
   shards for each core of the cluster (fewer, if those would be of less than SHARD_BYTES); each shard is suffix-sorted by external induced sorting (see induced.py), which
   may be far larger than memory, and strings that start at a smaller place of the shard go.
5. An anchor with more than HOT contexts isn't left to one shard: its K-byte strings, one row each, are compared by
   their 128-bit BLAKE2b digests in a plain aggregation and join.
6. Spans are joined to the documents and cut out.

A shard is read as a stream. Aggregations combine before the shuffle, so that a text or passage that a third of all
documents have costs a row for each place where it stands, and no task gathers those rows as a group.

Cases: a null text is empty; rows that share doc_id and text are one document and get the same result; rows that
share only the doc_id are ordered by the text's hash; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelex.llm.common import small_batches, staged
from tracelex.llm.induced import SEPARATOR, repeated

K, GRAM = 100, 32
#: Bytes that are hashed at a time: arrays of eight times as many stay in a core's cache.
CHUNK = 1 << 18
BITS = 1 << 25
#: Shards for each core, so that a part of the candidates' bytes is on scratch disks at a time; bytes of a shard's queues
#: in memory; contexts of an anchor that may go to one shard. Shards of fewer than SHARD_BYTES bytes are joined, since each
#: has 256 queues to pass, whatever it holds; the queues of a shard of that size stay in memory.
WAVES, SHARD_MEMORY, HOT, SHARD_BYTES = 24, 96 << 20, 4096, 4 << 20

_TABLE = np.random.default_rng(10).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, first start, how many starts. valid: starts of K-byte strings that lie within one text."""
    with np.errstate(over="ignore"):
        h, width, power = _TABLE[data], 1, _STEP
        while width < GRAM:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        gram = mix(h)
        # The hash's upper bits and the place in the lower ones: the least is the leftmost of the least.
        least = (gram & ~np.uint64(CHUNK - 1)) | np.arange(len(gram), dtype=np.uint64)
        span, width = K - GRAM + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least[valid] & np.uint64(CHUNK - 1)).astype(np.int64)
        new = np.append(True, (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1))
        first = np.flatnonzero(new)
        start, n = valid[first], np.diff(np.append(first, len(valid)))
        return mix(gram[place[first]] + _STEP).view(np.int64), start, n


def contexts(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Digest of the bytes that n strings from each start span."""
    raw, digest = memoryview(data), hashlib.blake2b
    ends = (start + n - 1 + K).tolist()
    return np.frombuffer(b"".join([digest(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), ends, strict=True)]), np.int64)


OCCURRENCE = "anchor long, context long, id long, th long, start long, n int"


def occurrences(bits: np.ndarray | None):
    """mapInArrow function over (id, th, text): the rows of step 1 that are in the bit map, or all anchors without one."""

    def rows_of(ids, ths, offsets, pieces):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        valid = np.concatenate([np.arange(a, b - K + 1) for a, b in zip(starts, ends, strict=True)])
        anchor, start, n = anchors(data, valid)
        if bits is None:
            return pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])
        slot = anchor.view(np.uint64) & np.uint64(BITS - 1)
        ok = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        anchor, start, n = anchor[ok], start[ok], n[ok]
        context = contexts(data, start, n)
        doc = np.searchsorted(ends, start, "right")
        at = start - starts[doc] + np.array(offsets)[doc]
        own = pa.array(ids, pa.int64()).take(pa.array(doc))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(context), own, pa.array(np.array(ths, np.int64)[doc]), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32))],
            names=["anchor", "context", "id", "th", "start", "n"],
        )

    def run(batches):
        ids, ths, offsets, pieces, held = [], [], [], [], 0
        for batch in batches:
            for own, th, text in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text")), strict=True):
                raw = text.encode()
                for at in range(0, max(len(raw) - K + 1, 0), CHUNK // 2):
                    piece = raw[at : at + CHUNK // 2 + K - 1]
                    if held + len(piece) > CHUNK and pieces:
                        yield rows_of(ids, ths, offsets, pieces)
                        ids, ths, offsets, pieces, held = [], [], [], [], 0
                    ids.append(own), ths.append(th), offsets.append(at), pieces.append(piece)
                    held += len(piece)
        if pieces:
            yield rows_of(ids, ths, offsets, pieces)

    return run


def bitmap(anchors_twice: DataFrame) -> np.ndarray:
    """BITS bits, whatever the number of anchors."""
    slot = F.col("anchor").bitwiseAND(F.lit(BITS - 1))
    words = anchors_twice.select(F.shiftright(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


PIECE = "anchor long, id long, th long, start long, bytes binary"


def packed(text):
    """Texts as they are shuffled: zstandard frames of their bytes."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return texts.map(lambda t: squeeze(t.encode()))

    return made(text)


def unpacked(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def cut_pieces(batches):
    """mapInArrow function over (id, th, z, wanted): the bytes of each wanted context whose anchor isn't hot."""
    for batch in batches:
        rows = []
        for own, th, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "z", "wanted")), strict=True):
            raw = unpacked(z)
            rows += [(w["anchor"], own, th, w["start"], raw[w["start"] : w["start"] + w["n"] - 1 + K]) for w in wanted if not w["hot"]]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "id", "th", "start", "bytes"])


STRING = "d1 long, d2 long, id long, th long, start long"


def cut_strings(batches):
    """mapInArrow function over (id, th, z, wanted): the digest of each K-byte string of the hot contexts."""
    for batch in batches:
        for own, th, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "z", "wanted")), strict=True):
            at = [a for w in wanted if w["hot"] for a in range(w["start"], w["start"] + w["n"])]
            if at:
                raw = memoryview(unpacked(z))
                d = np.frombuffer(b"".join([hashlib.blake2b(raw[a : a + K], digest_size=16).digest() for a in at]), np.int64).reshape(-1, 2)
                columns = [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([own] * len(at), pa.int64()), pa.array([th] * len(at), pa.int64()), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "id", "th", "start"])


def sort_shard(batches):
    """mapInArrow function over the pieces of a shard in (id, th, start) order: spans that repeat an earlier place."""
    import tempfile
    from array import array

    ids, named, ths, starts, lengths, last = array("q"), bytearray(), array("q"), array("q"), array("q"), None
    with tempfile.TemporaryFile() as f:
        for batch in batches:
            for own, th, start, piece in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "start", "bytes")), strict=True):
                if (own, th, start) != last:  # else it is of a repeated row
                    f.write(piece + bytes([SEPARATOR]))
                    ids.append(0 if own is None else own), named.append(own is not None), ths.append(th), starts.append(start), lengths.append(len(piece))
                last = own, th, start
        if not ids:
            return
        f.flush()
        flags = repeated(np.memmap(f, np.uint8, "r"), K, SHARD_MEMORY)
    ids, ths, starts, lengths = (np.frombuffer(x, np.int64) for x in (ids, ths, starts, lengths))
    nameless = np.frombuffer(named, np.uint8) == 0
    begin = np.cumsum(lengths + 1) - lengths - 1
    for first, last in runs(flags):
        piece = np.searchsorted(begin, first, "right") - 1
        offset = starts[piece] - begin[piece]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[piece], mask=nameless[piece]), pa.array(ths[piece]), pa.array(first + offset), pa.array(last + offset + K)],
            names=["id", "th", "start", "end"],
        )


def runs(flags: np.ndarray, block: int = 1 << 20):
    """First and last places of the runs of set flags, in batches: those that end within each block of flags."""
    open_ = -1
    for at in range(0, len(flags) + 1, block):
        # The place before the block, the block, and, at the end, one place that ends an open run.
        own = np.asarray(flags[at : at + block], bool)
        if len(own) < block:
            own = np.append(own, False)
        change = np.flatnonzero(np.diff(own, prepend=open_ >= 0)) + at
        if open_ >= 0:
            change = np.append(open_, change)
        first, last = change[0::2], change[1::2] - 1
        open_ = int(first[-1]) if len(first) > len(last) else -1
        if len(last):
            yield first[: len(last)].astype(np.int64), last.astype(np.int64)


def shard_count(size: int, cores: int) -> int:
    """Shards for so many bytes: WAVES for each core, but none of fewer than SHARD_BYTES, unless cores would be idle."""
    return min(WAVES * cores, max(cores, -(-size // SHARD_BYTES)))


def spans(docs: DataFrame) -> DataFrame:
    """id, th, start, end: byte spans that repeat an earlier text; they may overlap. docs: id, th, text."""
    spark = docs.sparkSession
    long = docs.where(F.octet_length("text") >= K)
    counted = long.mapInArrow(occurrences(None), "anchor long").groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    twice = staged(counted)
    sent = spark.sparkContext.broadcast(bitmap(twice))

    def second(batches):
        yield from occurrences(sent.value)(batches)

    rows = staged(long.mapInArrow(second, OCCURRENCE).join(twice, "anchor"))
    place = F.struct("id", "th", "start")
    firsts = rows.groupBy("anchor", "context").agg(F.min(F.struct("id", "th", "start", "n")).alias("f"))
    firsts = staged(firsts.select("anchor", "context", F.struct("f.id", "f.th", "f.start").alias("place"), F.col("f.n").alias("k")))
    copies = rows.join(firsts.select("anchor", "context", "place"), ["anchor", "context"]).where(~place.eqNullSafe(F.col("place")))
    copies = copies.select("id", "th", "start", (F.col("start") + F.col("n") - 1 + K).alias("end"))
    several = firsts.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", (F.col("c") > HOT).alias("hot"))
    wanted = firsts.join(several, "anchor").select(F.col("place.id").alias("wid"), F.col("place.th").alias("wth"), F.struct("anchor", F.col("place.start").alias("start"), F.col("k").alias("n"), "hot").alias("w"))
    wanted = staged(wanted.groupBy("wid", "wth").agg(F.collect_list("w").alias("wanted")))
    cold = F.aggregate("wanted", F.lit(0).cast("long"), lambda total, w: total + F.when(w.hot, 0).otherwise(w.n + K))
    hot, size = wanted.agg(F.max(F.exists("wanted", lambda w: w.hot)), F.sum(cold)).first()
    texts = long.select("id", "th", packed(F.col("text")).alias("z"))
    texts = texts.join(wanted, texts["id"].eqNullSafe(wanted["wid"]) & (texts["th"] == wanted["wth"])).select("id", "th", "z", "wanted")
    texts = staged(texts) if hot else texts
    pieces = texts.mapInArrow(cut_pieces, PIECE)
    shards = shard_count(size or 0, spark.sparkContext.defaultParallelism)
    found = pieces.repartition(shards, "anchor").sortWithinPartitions("id", "th", "start").mapInArrow(sort_shard, "id long, th long, start long, end long")
    if hot:
        strings = staged(texts.where(F.exists("wanted", lambda w: w.hot)).mapInArrow(cut_strings, STRING))
        # Written first, so that the join's two sides are plain shuffles, which adaptive execution can split.
        least = staged(strings.groupBy("d1", "d2").agg(F.min(place).alias("least"), F.count("*").alias("c")).where("c > 1").drop("c"))
        again = strings.join(least, ["d1", "d2"]).where(~place.eqNullSafe(F.col("least")))
        found = found.union(again.select("id", "th", "start", (F.col("start") + K).alias("end")))
    return copies.union(found)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _merged(found) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept text if it is asked for (bytes that aren't
    UTF-8 after the cuts become U+FFFD): one row for each row of docs."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    # Where ids are unique they name the documents, and 0 stands for the text's hash.
    unique = not docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    own = docs.select(F.col("doc_id").alias("id"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("th"), text.alias("text"))
    found = spans(own).groupBy(F.col("id").alias("sid"), F.col("th").alias("sth")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    own = own.select("id", "th", packed(F.col("text")).alias("z"))
    whole = own.join(found, own["id"].eqNullSafe(found["sid"]) & (own["th"] == found["sth"]), "left")
    whole = whole.select("id", "z", F.transform("spans", lambda s: s.start).alias("a"), F.transform("spans", lambda s: s.end).alias("b"))

    @F.pandas_udf(RESULT)
    def cut(frames: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for z, a, b in zip(frames, starts, ends, strict=True):
            raw = unpacked(z)
            gone = _merged(zip(a.tolist(), b.tolist(), strict=True)) if a is not None else []
            edges = [0, *(x for s in gone for x in s), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if gone else raw
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = whole.select(F.col("id").alias("doc_id"), cut("z", "a", "b").alias("r"))
    return out.select("doc_id", "r.*") if with_text else out.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256")


def op10_suffixes(spark, sf_dir):
    from tracelex.llm.common import table

    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
