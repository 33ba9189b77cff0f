"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader keeps a window of the compressed stream, decompresses it piece by piece,
frames each record by its Content-Length, checks that a gzip member ends with its record,
and verifies the block's and the payload's SHA-1.  Neither side holds an archive in
memory; the reader doesn't even hold a payload unless it is asked for.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest
page_id is a response and the others are revisits: header blocks that name the payload's
digest and the response.  Payloads are told apart by SHA-1 and length.

Archives go to the folder that all executors share, through the file system of its URI.
Every task writes under a name of its own and reports the files it closed; the report is
a committed table, so files of lost or repeated tasks are never read.

Defined results: a null html is an empty payload; a null url has no target header; rows
without page_id are responses that nothing refers to; repeated rows with the largest
page_id are all responses; extra columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh_path, saved

REVISIT_BYTES = 1000
#: Compressed bytes after which an archive is closed, bytes read at a time, and the zlib level.
ARCHIVE_BYTES, READ_BYTES, LEVEL = 64 << 20, 256 << 10, 4
#: Bytes of a header, at most.
HEADER_BYTES = 1 << 20
#: Distinct repeated payloads up to which the table of them is broadcast.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_DDL = "archive string, n_records long, n_bytes long"
MANIFEST = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=-._~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def writer(folder: str):
    """mapInArrow function: (page_id, url, html, refers_to) to archives, and a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        name, out, count, size, closed = "", None, 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                closed.append((name, count, size))
            out = None

        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                    if out is None:
                        name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    member = zlib.compress(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py()), LEVEL, 31)
                    out.write(member)
                    count, size = count + 1, size + len(member)
                    if size >= ARCHIVE_BYTES:
                        close()
            close()
        except BaseException:  # a task that fails leaves no archives behind
            close()
            for n, _, _ in closed:
                store.delete_file(f"{root}/{n}")
            raise
        cols = list(zip(*closed)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in cols[0]], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], schema=MANIFEST)

    return run


class Broken(ValueError):
    """An archive that doesn't follow the format or fails a digest."""


class Stream:
    """Incremental decompression of gzip members, with framing on top."""

    def __init__(self, source) -> None:
        self.source, self.raw, self.plain = source, b"", b""
        self.member = None

    def start(self) -> bool:
        """Enter the next member; False at the end of the archive."""
        if self.plain:
            raise Broken("a member holds more than its record")
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
        if not self.raw:
            return False
        self.member = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Decompress some more of the member; False at its end."""
        if self.member.eof:
            return False
        if not self.raw and not self.member.unconsumed_tail:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise Broken("the archive ends inside a member")
        data = self.member.unconsumed_tail + self.raw
        self.raw = b""
        try:
            self.plain += self.member.decompress(data, READ_BYTES)
        except zlib.error as wrong:
            raise Broken(f"a member can't be decompressed: {wrong}") from wrong
        if self.member.eof:
            self.raw = self.member.unused_data
        return True

    def until(self, mark: bytes, most: int = HEADER_BYTES) -> bytes:
        """Bytes up to and with the mark."""
        at = -1
        while (at := self.plain.find(mark)) < 0:
            if len(self.plain) > most or not self.more():
                raise Broken("a header has no end")
        found, self.plain = self.plain[: at + len(mark)], self.plain[at + len(mark) :]
        return found

    def exactly(self, n: int) -> Iterator[bytes]:
        """n bytes, in pieces."""
        while n:
            if not self.plain and not self.more():
                raise Broken("a record is shorter than its Content-Length")
            part, self.plain = self.plain[:n], self.plain[n:]
            n -= len(part)
            if part:
                yield part

    def finish(self) -> None:
        """The member must end here."""
        while self.more():
            pass
        if self.plain:
            raise Broken("a member holds more than its record")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k.strip()}


def length_of(head: dict[str, str]) -> int:
    value = head.get("content-length", "")
    if not value.isdigit():
        raise Broken("a record has no Content-Length")
    return int(value)


def records(source, keep: bool = False) -> Iterator[dict]:
    """The records of one archive, one after another, verified."""
    stream = Stream(source)
    while stream.start():
        head_bytes = stream.until(b"\r\n\r\n")
        if not head_bytes.startswith(b"WARC/1."):
            raise Broken("a record doesn't begin with its version")
        head = fields(head_bytes)
        left = length_of(head)
        block, payload = hashlib.sha1(), hashlib.sha1()
        body, http, size = [], b"", 0
        inside = not head.get("content-type", "").startswith("application/http")
        for part in stream.exactly(left):
            block.update(part)
            if not inside:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    if len(http) > HEADER_BYTES:
                        raise Broken("a header has no end")
                    continue
                inside, part, http = True, http[at + 4 :], http[: at + 4]
            payload.update(part)
            size += len(part)
            if keep:
                body.append(part)
        if b"".join(stream.exactly(4)) != b"\r\n\r\n":
            raise Broken("a record isn't followed by two line ends")
        stream.finish()
        kind = head.get("warc-type", "")
        if head.get("warc-block-digest") not in (None, base32(block.digest())):
            raise Broken("a block fails its digest")
        if kind == "revisit":
            size, digest = length_of(fields(http)), head["warc-payload-digest"]
        else:
            digest = base32(payload.digest())
            if head.get("warc-payload-digest", digest) != digest:
                raise Broken("a payload fails its digest")
        yield {"head": head, "kind": kind, "bytes": size, "sha1": base64.b32decode(digest.removeprefix("sha1:")).hex(), "payload": b"".join(body) if keep and kind != "revisit" else None}


READ_DDL = "archive string, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
READ = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def reader(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = located(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for x in records(source, keep):
                        h = x["head"]
                        rows.append((uri, h.get("warc-record-id"), h.get("warc-target-uri"), x["kind"], x["bytes"], x["sha1"], h.get("warc-refers-to"), x["payload"]))
                        held += len(x["payload"] or b"")
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)

    return run


def assigned(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the response's page_id for revisits, else null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("_sha1"), F.octet_length(html).alias("_n"))
    narrow = rows.where(F.col("_n") >= REVISIT_BYTES).select("page_id", "_sha1", "_n")
    twice = saved(narrow.groupBy("_sha1", "_n").agg(F.max("page_id").alias("_last"), F.count("*").alias("_copies")).where("_copies > 1 and _last is not null"), "warc-payloads")
    n = twice.count()
    if n <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(twice), ["_sha1", "_n"], "left")
    else:
        # payloads with over a thousandth of the rows are fewer than a thousand: broadcast those only
        floor = narrow.count() // 1000 + 1
        hot = rows.join(F.broadcast(twice.where(F.col("_copies") > floor)), ["_sha1", "_n"], "left")
        cold = hot.where("_last is null").drop("_last", "_copies").join(twice.where(F.col("_copies") <= floor), ["_sha1", "_n"], "left")
        joined = hot.where("_last is not null").unionByName(cold)
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives; returns archive, n_records, n_bytes of the committed ones."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    store, root = located(folder)
    store.create_dir(root, recursive=True)
    return saved(assigned(pages).mapInArrow(writer(folder), MANIFEST_DDL), "warc-manifest")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives named in the column archive; one task reads some archives, one after another."""
    spark: SparkSession = archives.sparkSession
    n = max(2, min(archives.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("archive").repartition(n, "archive").mapInArrow(reader(payloads), READ_DDL)


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """archive of every file that matches a path pattern."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("archive"))


def page_of(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def digest(pages: DataFrame) -> DataFrame:
    """What the reader finds for every page that was written."""
    found = read_archives(write_archives(pages))
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "url")
