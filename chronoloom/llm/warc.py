"""WARC archives with a two-level capture index.

`write` puts one record per row into gzip archives (a member a record) in a shared
folder and returns what it wrote. `build_index` sorts the captures by reversed-host
URL key and writes them as compressed blocks of lines, with a sparse directory beside
each index file: the first key of every block, its offset and length. `lookup` finds
captures by two binary searches, over the first keys of the index files (one a file)
and over one file's directory, then reads only the block's byte range;
`read_records` reads records by theirs. Archives begin with a warcinfo record, payloads are bodies of HTTP responses.

Payloads that occur again are written once: of equal payloads of at least
`min_bytes`, the row with the smallest id is the response and the others are revisits
that refer to it. A hot payload, that of a third of all rows say, is aggregated before
the shuffle and joined back by `hot_join`.

Defined results: a null html is an empty payload; a null URL is written as an empty
one and its key is empty. Smaller payloads are always responses. Rows with a null id
are responses, as nothing can refer to them. Rows that repeat an id are written each;
a revisit never refers to its own id, so such a repetition is a response. An empty table writes nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, hot_join, shared

LEVEL = 4
BLOCK_LINES = 300
DATE = "1970-01-01T00:00:00Z"  # of records, where pages tell none
CAPTURES = "urlkey string, page_id long, record_type string, digest string, refers_to long, file string, offset long, length long"


@lru_cache(64)
def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@lru_cache(1024)
def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: `org,example,www)/a?b`. Fragments and schemes don't count.

    Tab, newline and return are escaped here, before anything is sorted, as index lines can't hold them.
    """
    try:
        p = urlsplit((url or "").strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:  # not a URL: kept whole, so that it can still be found
        return _field((url or "").lower())
    if not host:
        return _field((url or "").lower())
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


def _clean(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, digest: str, kind: str = "response") -> str:
    """The same for a page and its payload wherever it is written, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind} {page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: an HTTP response with the payload, or a revisit without one. `Page-ID` and `Refers-To-Page-ID` are fields of our own."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest, kind)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    block = b"format: WARC File Format 1.1\r\nsoftware: chronoloom\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name, 'warcinfo')}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record; HTTP heads are taken off."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["content-type"].startswith("application/http") else block


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = None
    for b in batches:
        if out is None:
            system, root = _place(folder)
            system.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.gz"  # an attempt's own: what a lost one left is referred to by no index
            out, at = system.open_output_stream(f"{root}/{name}", compression=None), 0
            first = _gzip(info(name))
            out.write(first)
            at = len(first)
        rows = []
        for page_id, url, html, digest, refers in zip(*[c.to_pylist() for c in b.columns]):
            member = _gzip(record(page_id, url, (html or "").encode(), digest, refers))
            out.write(member)
            rows.append((url_key(url), page_id, "response" if refers is None else "revisit", digest, refers, name, at, len(member)))
            at += len(member)
        cols = list(zip(*rows)) or [[]] * 8
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], CAPTURES.replace(",", "").split()[::2])
    if out is not None:
        out.close()


def with_roles(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which rows are responses, which revisits of which.

    First ids are found on digests alone. Texts are moved once; those of one payload are spread over as many tasks as
    they are hundred-thousandths of all rows.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    slim = slim.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    key = F.when((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull(), F.col("digest"))
    slim = slim.withColumn("_key", key)
    first = slim.select("_key", "page_id").filter("_key is not null").groupBy("_key").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).filter("n > 1")
    out = hot_join(slim, first, "_key", "n", pages.count())
    return out.select("page_id", "url", "html", "digest", F.when(F.col("low") != F.col("page_id"), F.col("low")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 100) -> tuple[str, DataFrame]:
    """Write archives; (their folder, their captures)."""
    folder = folder or shared(pages.sparkSession, "warc")
    return folder, cut(with_roles(pages, min_bytes).mapInArrow(lambda it: _write(it, folder), CAPTURES), "captures")


def _index(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    out, name, at, held, blocks, first = None, "", 0, [], [], None

    def put() -> None:
        nonlocal at
        raw = _gzip("\n".join(x[1] for x in held).encode())
        out.write(raw)
        blocks.append(f"{held[0][0]}\t{at}\t{len(raw)}")
        at += len(raw)
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        if out is None:
            system, root = _place(folder)
            system.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.cdx.gz"
            out = system.open_output_stream(f"{root}/{name}", compression=None)
        for row in zip(*[c.to_pylist() for c in b.columns]):
            key = row[0]
            first = key if first is None else first
            held.append((key, "\t".join([key, *("-" if x is None else str(x) for x in row[1:])])))
            if len(held) >= lines:
                put()
    if out is not None:
        if held:
            put()
        out.close()
        with system.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
            f.write("\n".join(blocks).encode())
        yield pa.record_batch([[first], [name]], ["first", "name"])


def _field(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, per_file: int = 1_000_000) -> list[tuple[str, str]]:
    """Write the index; (first key, file) of each index file, in order. One row a file of up to about a million captures comes to the driver."""
    spark = captures.sparkSession
    n = captures.count()
    parts = max(1, min(n, max(-(-n // per_file), min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    # by id as well, so that captures of one URL may span files
    rows = captures.repartitionByRange(parts, "urlkey", "page_id", "file", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    done = rows.mapInArrow(lambda it: _index(it, folder, block_lines), "first string, name string")
    # files that begin with the same key stay in the order of their partitions
    return sorted(((r["first"], r["name"]) for r in done.collect()), key=lambda f: f[0])


class Index:
    """Two binary searches, then one range read a block."""

    def __init__(self, folder: str, files: list[tuple[str, str]]) -> None:
        self.folder, self.firsts, self.names = folder, [f for f, _ in files], [n for _, n in files]
        self.directory = lru_cache(16)(self._directory)
        self.block = lru_cache(16)(self._block)

    def _directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        system, root = _place(self.folder)
        with system.open_input_file(f"{root}/{name}.dir") as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, name: str, at: int, length: int) -> tuple[list[str], list[list[str]]]:
        system, root = _place(self.folder)
        with system.open_input_file(f"{root}/{name}") as f:
            raw = f.read_at(length, at)
        rows = [x.split("\t") for x in zlib.decompress(raw, 31).decode().split("\n")]
        return [r[0] for r in rows], rows

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(index file, offset, length) of the blocks that may hold a key, found by binary searches alone."""
        key = _field(key)
        # the block before the first one that begins at or after the key may hold its first captures
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.names) and self.firsts[k] <= key:
            keys, ranges = self.directory(self.names[k])
            j = max(0, bisect.bisect_left(keys, key) - 1)
            while j < len(keys) and keys[j] <= key:
                yield (self.names[k], *ranges[j])
                j += 1
            k += 1

    def within(self, key: str, name: str, at: int, length: int) -> list[list[str]]:
        """The captures of a key in one block."""
        key = _field(key)
        inside, rows = self.block(name, at, length)
        return rows[bisect.bisect_left(inside, key) : bisect.bisect_right(inside, key)]

    def find(self, key: str) -> Iterator[list[str]]:
        """All captures of a URL key, in index order."""
        for at in self.blocks(key):
            yield from self.within(key, *at)


def _locate(batches: Iterator[pa.RecordBatch], folder: str, files: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    index = Index(folder, files)
    for b in batches:
        rows = [(key, *at) for key in b.column(0).to_pylist() for at in index.blocks(key)]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["urlkey", "name", "at", "length"])


def _scan(batches: Iterator[pa.RecordBatch], folder: str, files: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    index = Index(folder, files)
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = CAPTURES.replace(",", "").split()[::2]
    for b in batches:
        rows = [r for key, *at in zip(*[c.to_pylist() for c in b.columns]) for r in index.within(key, *at)]
        rows = [[None if v == "-" and t != pa.string() else int(v) if t == pa.int64() else v for v, t in zip(r, types)] for r in rows]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names)


def lookup(urls: DataFrame, url_col: str, folder: str, files: list[tuple[str, str]]) -> DataFrame:
    """All captures of the URLs of a column.

    Each distinct key is searched once, in key order so that directories are read in
    turn; the blocks found are then read in order, each once. A URL captured very
    often is many blocks, read by many tasks.
    """
    key = F.pandas_udf(lambda s: s.map(lambda u: url_key(u if isinstance(u, str) else None)), "string")
    keys = urls.select(key(F.col(url_col).cast("string")).alias("urlkey")).distinct()
    keys = keys.repartitionByRange("urlkey").sortWithinPartitions("urlkey")
    blocks = keys.mapInArrow(lambda it: _locate(it, folder, files), "urlkey string, name string, at long, length long")
    blocks = blocks.repartitionByRange("name", "at").sortWithinPartitions("name", "at", "urlkey")
    return blocks.mapInArrow(lambda it: _scan(it, folder, files), CAPTURES)


def _records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = _place(folder)
    name, f = None, None
    for b in batches:
        rows = []
        for file, at, length in zip(*[b.column(k).to_pylist() for k in ("file", "offset", "length")]):
            if file != name:
                if f:
                    f.close()
                name, f = file, system.open_input_file(f"{root}/{file}")
            head, payload = parse(zlib.decompress(f.read_at(length, at), 31))
            refers = head.get("refers-to-page-id")
            page = head["page-id"]
            rows.append((int(page) if page else None, head["warc-type"], head["warc-target-uri"], payload, head["warc-payload-digest"][7:], int(refers) if refers else None, hashlib.sha256(payload).hexdigest()))
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], ["page_id", "record_type", "url", "payload", "declared", "refers_to", "found"])
    if f:
        f.close()


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures by range reads: page_id, record_type, url, payload, declared and found digest, refers_to."""
    rows = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(lambda it: _records(it, folder), "page_id long, record_type string, url string, payload binary, declared string, refers_to long, found string")


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write archives and their index, find every page by its URL, read the records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder, captures = write(pages, min_bytes=min_bytes)
    files = build_index(captures, folder)
    found = lookup(pages, "url", folder, files)
    read = read_records(found, folder).select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), "found", "declared")
    read = cut(read, "read")
    # a revisit's payload is the one its response holds
    revisits = read.filter("record_type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("n"))
    held = read.filter("record_type = 'response' and page_id is not null").select("page_id", "bytes", "found").dropDuplicates(["page_id"])
    held = held.join(revisits, held["page_id"] == revisits["refers_to"]).select("refers_to", "n", F.col("bytes").alias("b"), F.col("found").alias("d"))
    out = hot_join(read, held, "refers_to", "n", pages.count())
    revisit = F.col("record_type") == "revisit"
    return out.select("page_id", F.when(revisit, F.col("b")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("d")).otherwise(F.col("found")).alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS low FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN low <> page_id THEN low END AS refers_to FROM f
"""
