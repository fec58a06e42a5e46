"""WARC archives with a two-level capture index.

Each task writes one archive of gzip members, one per record. The index has a line per record, keyed
by the URL with its host reversed, sorted over all archives and cut into compressed blocks; beside
each index file lies its directory, which names only the first key of each block. A lookup finds the
index file and then the block by halving, reads the range of that block, finds the lines in it by
halving again, and reads the ranges of their records.

Files are written through the file system that the shared folder's address names. A file's name has
a part that no other attempt has, and only names that a finished task returned are used, so a lost
or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import keep, plain
from tallyloom.storage import scratch_path

BLOCK_LINES = 512
ENTRY = "urlkey string, page bigint, kind string, file string, offset bigint, length bigint"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def opened(folder: str):
    """File system and path of a folder's address."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    else:
        system, path = fs.LocalFileSystem(), folder
    return system, path


def url_key(url: str | None) -> str:
    """Reversed host, port and path: http://a.example.com/x?y becomes com,example,a)/x?y."""
    try:
        told = urlsplit((url or "").strip())
        host, port = (told.hostname or "").strip("."), told.port
    except ValueError:
        return (url or "").strip().lower()
    rest = (told.path or "/") + (f"?{told.query}" if told.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + rest


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit of the record of page ``first`` with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "none" if page is None else page
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    block = head + payload
    if first is not None:
        block = head
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of RESULT from a record; a response's payload is hashed again and must fit its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x.endswith(":none>") else int(x[len("<urn:page:") : -1])
    page, digest, kind = number(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "revisit":
        told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        return page, int(told["Content-Length"]), digest, kind, number(fields["WARC-Refers-To"])
    if b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"page {page}: payload does not fit its digest")
    return page, len(payload), digest, kind, None


def write(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) below ``folder``; one index entry per record.

    Of equal payloads of at least ``min_payload`` bytes, that of the smallest page_id is a response and
    the others revisit it; rows that repeat this page are responses too, and rows without page_id revisit
    it if there is one. Null html is an empty payload.
    """
    rows = plain(pages, "page_id", "url", "html").withColumn("html", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = rows.withColumn("sha", F.sha1("html"))
    firsts = rows.filter(F.length("html") >= min_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 and first is not null").select("sha", "first")
    marked = rows.join(firsts, "sha", "left").withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        name, at, out = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            found = []
            for page, url, html, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or system.open_output_stream(name, compression=None)
                raw = gzip.compress(record(page, url, html, b32encode(bytes.fromhex(sha)).decode(), first), 1, mtime=0)
                out.write(raw)
                found.append((url_key(url), page, "response" if first is None else "revisit", name, at, len(raw)))
                at += len(raw)
            yield entries_batch(found)
        if out:
            out.close()

    return marked.select("page_id", "url", "html", "sha", "first").mapInArrow(work, ENTRY)


def entries_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], "urlkey page kind file offset length".split())


def index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index below ``folder``. One row per index file: file and its first key.

    Keys are URL and page together, so that the pages of one host or URL can lie in many files.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        name, directory, lines, at = f"{path}/{uuid.uuid4().hex}.cdx.gz", [], [], 0
        out = None

        def close_block() -> None:
            nonlocal at, lines
            raw = gzip.compress("\n".join(map(json.dumps, lines)).encode(), 6, mtime=0)
            out.write(raw)
            directory.append([*lines[0][:2], at, len(raw)])
            at, lines = at + len(raw), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or system.open_output_stream(name, compression=None)
                lines.append([row[0], -1 if row[1] is None else row[1], *row[2:]])
                if len(lines) == block_lines:
                    close_block()
        if out:
            if lines:
                close_block()
            out.close()
            with system.open_output_stream(name + ".dir", compression=None) as beside:
                beside.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64())], ["file", "urlkey", "page"])

    ordered = entries.repartitionByRange("urlkey", "page").sortWithinPartitions("urlkey", "page")
    return ordered.mapInArrow(work, "file string, urlkey string, page bigint")


class Index:
    """Lookups in one index file through its directory."""

    def __init__(self, system, name: str):
        self.system, self.name, self.at, self.lines = system, name, -1, []
        with system.open_input_file(name + ".dir") as file:
            self.blocks = json.loads(file.read())
        self.file = system.open_input_file(name)

    def block(self, i: int) -> list:
        if i != self.at:
            _, _, offset, length = self.blocks[i]
            self.file.seek(offset)
            self.lines = list(map(json.loads, gzip.decompress(self.file.read(length)).decode().split("\n")))
            self.at = i
        return self.lines

    def find(self, key: list) -> Iterator[list]:
        """All lines of a key (url key and page); they may run over several blocks."""
        i = max(bisect.bisect_left(self.blocks, key, key=lambda b: b[:2]) - 1, 0)
        while i < len(self.blocks) and self.blocks[i][:2] <= key:
            lines = self.block(i)
            k = bisect.bisect_left(lines, key, key=lambda x: x[:2])
            while k < len(lines) and lines[k][:2] == key:
                yield lines[k]
                k += 1
            i += 1


def lookup(keys: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The index entries of ``keys`` (urlkey, page; page -1 where there is none), each key once.

    ``files`` are the index files; the driver sees one first key per file.
    """
    known = sorted((r["urlkey"], -1 if r["page"] is None else r["page"], r["file"]) for r in files.collect())
    sent = keys.sparkSession.sparkContext.broadcast(known)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [list(x[:2]) for x in sent.value]
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            # entries of one key may begin in the file before the one that starts with it
            spots = [(max(bisect.bisect_left(first, [u, p]) - 1, 0), bisect.bisect_right(first, [u, p])) for u, p in pairs]
            rows = [i for i, (a, b) in enumerate(spots) for _ in range(a, max(b, a + 1))]
            numbers = [k for a, b in spots for k in range(a, max(b, a + 1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), *(batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1))], ["number", "urlkey", "page"]
            )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        number, own = -1, None
        for batch in batches:
            found = []
            for n, urlkey, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n != number:
                    number, own = n, Index(system, sent.value[n][2])
                found += [tuple(x) for x in own.find([urlkey, page])]
            yield entries_batch(found)

    if not known:
        return keys.sparkSession.createDataFrame([], ENTRY)
    routed = keys.distinct().mapInArrow(route, "number int, urlkey string, page bigint")
    return routed.repartition("number").sortWithinPartitions("number", "urlkey", "page").mapInArrow(find, ENTRY)


def read(entries: DataFrame, folder: str) -> DataFrame:
    """The records of index entries as rows of RESULT; each archive is read in the order of its offsets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        name, file = "", None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for own, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    name, file = own, system.open_input_file(own)
                file.seek(offset)
                rows.append(parsed(gzip.decompress(file.read(length))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                "page_id payload_bytes payload_digest record_type refers_to".split(),
            )

    # a stated number of parts: entries are short and Spark would put them together, but what they name is long
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(work, RESULT)


def archive(pages: DataFrame, min_payload: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """Write archives and index of ``pages`` into the shared folder: entries, index files and the folder."""
    folder = scratch_path(pages.sparkSession, "warc")
    entries = keep(write(pages, folder, min_payload), "warc-entries")
    return entries, keep(index(entries, folder), "warc-index"), folder


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Archive all pages and read every record back through the index."""
    entries, files, folder = archive(pages, min_payload)
    keys = entries.select("urlkey", F.coalesce("page", F.lit(-1)).alias("page"))
    return read(lookup(keys, files, folder), folder)
