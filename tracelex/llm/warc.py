"""Operator 2: WARC archives with a two-level capture index.

`write` makes WARC files (a gzip member per record) and the index: capture lines sorted by reversed-host URL key, cut
into compressed blocks, and a sparse directory with one row for each block. `read_all` walks the directory, decodes
each block and range-reads its records; `lookup` binary-searches the directory for given URLs, brings the keys to their
blocks, decodes each block once, binary-searches it, and range-reads the records. A key that fills many blocks is read
by as many tasks as these make. The query looks up the URLs of all pages.
Files lie in the shared folder and are reached through pyarrow's file systems. A task names its file anew at each
attempt and hands over what it wrote as rows, which are staged; what a lost attempt wrote is never pointed at.

Of pages with equal payloads the one with the largest page_id is the response and the others are revisits (rows that
tie on page_id are all responses). Payloads are compared by length and SHA-256. Copies meet in a join on the digest
that adaptive execution can split, after aggregation to one row for each digest; records are sorted by (key, page_id),
so that a host with a third of all pages spreads over many blocks.

Cases: a null html is an empty payload; null or broken URLs get the key they can; null page_ids are kept as null;
an empty table writes an empty archive; further columns, whatever their names, are ignored. `pages` has no capture times:
WARC-Date is a parameter. Each file begins with a warcinfo record, which the index doesn't list.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelex.llm.common import shared_dir, small_batches, staged

BLOCK_LINES = 1000
#: Beyond so many blocks the directory isn't sent to every task; lookups then join with the index lines.
MAX_DIRECTORY = 200_000
DATE = "2024-01-01T00:00:00Z"

ENTRY = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first string, last string, file string, offset long, length long, lines long"
RECORD = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: http://a.b.c/x?y -> c,b,a)/x?y."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return quote(url or "", safe="/:?=&,.)(")
    path = quote(parts.path or "/", safe="/%:=&,.)(~!*'+;@$")
    query = f"?{quote(parts.query, safe='/%:=&,.)(~!*+;@$?')}" if parts.query else ""
    return ",".join(reversed(quote(host).split("."))) + ")" + path + query


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    body = b"" if revisit else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n", 1, mtime=0)


def info(date: str) -> bytes:
    body = b"software: tracelex\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != declared or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": declared,
        "record_type": kind, "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload,
    }


def _at(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)


def _ints(frame: pd.DataFrame, *names: str) -> pd.DataFrame:
    return frame.astype({n: "Int64" for n in names})


def _write_part(base: str, date: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _at(base)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for frame in frames:
            rows = []
            for page_id, url, html, response in zip(*(frame[c] for c in ("page_id", "url", "html", "response")), strict=True):
                own, best = (None if pd.isna(x) else int(x) for x in (page_id, response))
                data = record(own, url, (html or "").encode(), best, own != best, date)
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                    at = out.write(info(date))
                out.write(data)
                rows.append((url_key(url), own, name, at, len(data)))
                at += len(data)
            yield _ints(pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]), "page_id")
        if out is not None:
            out.close()

    return run


def _write_blocks(base: str, block_lines: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _at(base)
        name, out, at, lines, rows = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def close_block() -> None:
            nonlocal out, at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
            out.write(data)
            rows.append((lines[0].partition(" ")[0], lines[-1].partition(" ")[0], name, at, len(data), len(lines)))
            at, lines = at + len(data), []

        for frame in frames:
            for key, page_id, file, offset, length in frame.itertuples(index=False):
                lines.append(f"{key} {'-' if pd.isna(page_id) else int(page_id)} {file} {offset} {length}")
                if len(lines) == block_lines:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIRECTORY.split(", ")])

    return run


class Reader:
    """Range reads below one folder; keeps a few files open."""

    def __init__(self, base: str, most: int = 32):
        (self.store, self.top), self.files, self.most = _at(base), {}, most

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.top}/{name}")
        return self.files[name].read_at(length, offset)

    def block(self, name: str, offset: int, length: int) -> list[list[str]]:
        return [x.split(" ") for x in zlib.decompress(self.read(name, offset, length)).decode().split("\n")]

    def records(self, entries: list[list[str]]) -> Iterator[tuple]:
        for key, _, file, offset, length in sorted(entries, key=lambda e: (e[2], int(e[3]))):
            r = parse(self.read(file, int(offset), int(length)))
            yield key, r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]


def _frames(rows: Iterator[tuple], size: int = 256) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield _ints(pd.DataFrame(some, columns=names), "page_id", "refers_to")
            some = []
    if some:
        yield _ints(pd.DataFrame(some, columns=names), "page_id", "refers_to")


class Archive:
    def __init__(self, spark: SparkSession, base: str, directory: DataFrame):
        self.spark, self.base, self.directory = spark, base, directory

    def read_all(self) -> DataFrame:
        """Every record, through directory, blocks and range reads."""
        base = self.base

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader(base)
            for frame in frames:
                for file, offset, length in zip(frame["file"], frame["offset"], frame["length"], strict=True):
                    yield from _frames(reader.records(reader.block(file, offset, length)))

        parts = max(1, self.directory.sparkSession.sparkContext.defaultParallelism * 2)
        return self.directory.repartition(parts, "file", "offset").mapInPandas(run, RECORD)

    def lines(self) -> DataFrame:
        """Every capture line of the index, as rows."""
        base = self.base

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader(base)
            for frame in frames:
                for file, offset, length in zip(frame["file"], frame["offset"], frame["length"], strict=True):
                    rows = [(k, None if p == "-" else int(p), f, int(o), int(n)) for k, p, f, o, n in reader.block(file, offset, length)]
                    yield _ints(pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]), "page_id")

        return self.directory.mapInPandas(run, ENTRY)

    def lookup(self, urls: DataFrame, max_directory: int = MAX_DIRECTORY) -> DataFrame:
        """Records of the URLs in column url: binary search in the directory, then in the block, then range reads."""
        base, key = self.base, F.pandas_udf(lambda s: s.map(url_key), "string")
        keys = urls.select(key("url").alias("key")).distinct()
        if self.directory.count() > max_directory:
            found = keys.join(self.lines(), "key")

            def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                reader = Reader(base)
                for f in frames:
                    yield from _frames(reader.records([[k, "", n, o, m] for k, n, o, m in zip(f["key"], f["file"], f["offset"], f["length"], strict=True)]))

            return found.mapInPandas(fetch, RECORD)
        blocks = self.spark.sparkContext.broadcast(sorted(map(tuple, self.directory.collect())))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            firsts, lasts = [b[0] for b in blocks.value], [b[1] for b in blocks.value]
            for frame in frames:
                rows = [(k, *b[2:5]) for k in frame["key"] for b in blocks.value[bisect.bisect_left(lasts, k) : bisect.bisect_right(firsts, k)]]
                yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"]).astype({"offset": "int64", "length": "int64"})

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, at, entries, names = Reader(base), None, [], []
            for frame in frames:
                wanted: list[list[str]] = []
                for k, *block in zip(frame["key"], frame["file"], frame["offset"], frame["length"], strict=True):
                    if block != at:
                        at, entries = block, reader.block(*block)
                        names = [e[0] for e in entries]
                    wanted += entries[bisect.bisect_left(names, k) : bisect.bisect_right(names, k)]
                yield from _frames(reader.records(wanted))

        found = keys.mapInPandas(search, "key string, file string, offset long, length long")
        return found.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInPandas(read, RECORD)


def write(pages: DataFrame, base: str | None = None, block_lines: int = BLOCK_LINES, date: str = DATE) -> Archive:
    """Write page_id, url, html as an indexed archive."""
    spark = pages.sparkSession
    small_batches(spark)
    base = base or shared_dir(spark)
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("sum"), F.octet_length(html).alias("n"))
    best = own.groupBy("sum", "n").agg(F.max("page_id").alias("response"))
    records = own.join(best, ["sum", "n"]).select("page_id", "url", "html", "response")
    entries = staged(records.mapInPandas(_write_part(f"{base}/warc", date), ENTRY).withColumn("file", F.concat(F.lit("warc/"), "file")))
    parts = spark.sparkContext.defaultParallelism
    ordered = entries.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id")
    directory = ordered.mapInPandas(_write_blocks(f"{base}/index", block_lines), DIRECTORY)
    return Archive(spark, base, staged(directory.withColumn("file", F.concat(F.lit("index/"), "file"))))


def op2_warc(spark, sf_dir):
    from tracelex.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = write(pages).lookup(pages.select("url"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS response FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(sha1(html), 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)), 1)), '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM p JOIN m USING (html)
"""
