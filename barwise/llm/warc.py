"""Archives of web pages in WARC files, where equal payloads are kept once and revisited.

1. Headers only (id, address, digest and length of the payload) are grouped by digest: counts combine before the shuffle, and of
   each digest that occurs more than once the row to keep comes out.
2. That table is joined to the pages again; it is sent to every task where its size allows, so texts stay where they are.
   Rows that repeat an original in all of id, address and payload are merged and counted, as only one of them may be kept.
3. Every task writes its pages as records with fresh headers: a response with the payload, or a revisit that names the response
   and has the length and digest of the payload. Files are written under the name of the attempt, ended at a size, and renamed.
4. Reading streams the files, checks length and digest of every payload, and joins revisits to responses by record id.

A record is a gzip member of its own (WARC 1.1). The page id stands in the extension field ``Page-Id``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import map_arrow
from barwise.llm.links import broadcast_small
from barwise.session import materialize

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes after which a file ends; a longer record has a file of its own.
FILE_BYTES = 256 << 20
GZIP_LEVEL = 3
#: Bytes read at a time.
CHUNK = 1 << 18
FILES = "path string, n_records long, n_responses long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, url string"


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """The same for the same record, so a task that runs again writes the same file."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}\n{url}\n{digest}\n{copy}')}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _field(text: str) -> str:
    """A header value: bytes that would end the line or the value's place are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, copy: int, original: str | None, original_url: str | None, date: str) -> bytes:
    """A response, or with ``original`` (the id of a record) a revisit without its payload."""
    headers = [
        ("WARC-Type", "revisit" if original else "response"),
        ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", _field(url))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        *([("Page-Id", str(page_id))] if page_id is not None else []),
    ]
    if original:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", original), ("WARC-Refers-To-Date", date)]
        headers += [("WARC-Refers-To-Target-URI", _field(original_url))] if original_url else []
    return record(headers, _http(size) + (b"" if original else payload or b""))


class _Archive:
    """Files of one task, each written under a name of the attempt and renamed when it is whole."""

    def __init__(self, folder: str, task: int, most: int, level: int):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.task, self.most, self.level, self.number, self.out = task, most, level, 0, None
        self.done: list[tuple[str, int, int]] = []

    def add(self, data: bytes, response: bool) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = packer.compress(data) + packer.flush()
        if self.out and self.size + len(data) > self.most:
            self.close()
        if not self.out:
            self.attempt = f"{self.base}/_attempt-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.responses = self.store.open_output_stream(self.attempt, compression=None), 0, 0, 0
        self.out.write(data)
        self.size, self.records, self.responses = self.size + len(data), self.records + 1, self.responses + response

    def close(self) -> None:
        if self.out:
            self.out.close()
            path = f"{self.base}/pages-{self.task:06d}-{self.number:04d}.warc.gz"
            self.store.move(self.attempt, path)
            self.done.append((path, self.records, self.responses))
            self.out, self.number = None, self.number + 1


def _same(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out &= F.col(name).eqNullSafe(F.col(f"keep_{name}"))
    return out


def decided(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` (page_id, url, payload, digest, size, mark), equal ones as one with their number as ``copies``, and for those of
    repeated payloads the row to keep (``keep_page_id``, ``keep_url``, ``repeated``)."""
    same = ["digest", "size", "mark"]
    heads = materialize(rows.groupBy(*same, "page_id", "url").agg(F.count(F.lit(1)).alias("copies")), "page-headers")
    kept = heads.where(F.col("size") >= least_bytes).groupBy(*same)
    kept = kept.agg(F.sum("copies").alias("rows"), F.max(F.struct("page_id", "url")).alias("keep")).where("rows > 1")
    kept = kept.select(*same, F.col("keep.page_id").alias("keep_page_id"), F.col("keep.url").alias("keep_url"), F.lit(True).alias("repeated"))
    kept = broadcast_small(materialize(kept, "repeated-payloads"))
    twins = materialize(heads.where("copies > 1"), "repeated-rows")
    if twins.isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        theirs = [F.col(x).alias(f"keep_{x}") for x in (*same, "page_id", "url")]
        out = rows.join(broadcast_small(twins).select(*theirs, "copies"), _same(*same, "page_id", "url"), "left").select(*rows.columns, "copies")
        once = out.where("copies > 1").dropDuplicates([*same, "page_id", "url"])
        rows = out.where("copies is null").withColumn("copies", F.lit(1).cast("long")).unionByName(once)
    return rows.join(kept, same, "left")


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = GZIP_LEVEL,
) -> DataFrame:
    """Write one record per row; returns one row per file (``FILES``).

    Payloads are equal if length, SHA-1 and a further hash are; of equal ones of at least ``least_bytes`` bytes that with the largest
    id is the response (of one id, with the largest address), the others revisit it. A null payload is an empty one, a null id is below
    all ids. Rows equal in everything become one response and revisits of it. An empty table writes no file.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long"), "mark": F.xxhash64("payload")})
    rows = decided(rows, least_bytes)
    own = F.col("repeated").isNull() | _same("page_id", "url")
    rows = rows.select(
        "page_id", "url", F.when(own, F.col("payload")).alias("payload"), "size", "digest", "copies", "keep_page_id", "keep_url", "repeated", own.alias("own")
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for page, address, data, size, sha, copies, keep, keep_url, repeated, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(folder, TaskContext.get().partitionId(), file_bytes, level)
                digest = base32(sha)
                original = record_id(keep, keep_url, digest, 0) if repeated else None
                for copy in range(copies):
                    response = not repeated or own and not copy
                    archive.add(page_record(page, address, data, size, digest, copy, None if response else original, keep_url, date), response)
        if archive:
            archive.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*archive.done, strict=True)], [x.split()[0] for x in FILES.split(", ")])

    return materialize(map_arrow(rows, save, FILES), "archive-files")


def read_members(source) -> Iterator[bytes]:
    """The records of a file: one gzip member each. Holds one record."""
    packer, parts = zlib.decompressobj(31), []
    while chunk := source.read(CHUNK):
        while chunk:
            parts.append(packer.decompress(chunk))
            chunk = packer.unused_data
            if packer.eof:
                yield b"".join(parts)
                packer, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = (line.decode("utf-8").split(":", 1) for line in lines[1:])
    headers = {name.strip().lower(): value.strip() for name, value in fields}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"a record of {size} bytes has {len(rest) - 4}")
    return headers, rest[:size]


def _read_page(data: bytes) -> tuple:
    headers, block = parsed(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} is not what its headers say")
    page = headers.get("page-id")
    return page and int(page), size, digest, kind, headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("warc-target-uri")


def read(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files of ``write``: ``RECORDS``. A task reads whole files; payloads are checked, not returned."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as source:
                    for data in read_members(source):
                        rows.append(_read_page(data))
                        if len(rows) == 10_000:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    spread = files.select("path").repartition(max(1, files.count()))
    return map_arrow(spread, load, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url``: revisits with the page id of their response.

    A response whose page has no id is referred to by null. Give the records as a written table; it is read twice.
    """
    wanted = records.where(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("record_id")).distinct()
    named = records.where("record_type = 'response'").select("record_id", F.col("page_id").alias("refers_to"))
    named = materialize(named.join(wanted, "record_id", "left_semi").withColumnRenamed("record_id", "refers_to_id"), "referred-records")
    out = records.join(broadcast_small(named), "refers_to_id", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
