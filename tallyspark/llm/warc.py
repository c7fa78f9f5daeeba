"""WARC archives: a distributed writer and a sequential reader.

Writing: every task writes its rows to archive files of its own in a shared folder, one gzip member
per record, and returns a row per finished file (the manifest).  A file's name holds a random part,
so a repeated task never touches a file of another attempt, and only files in the manifest are read.

Reading: every archive is one task's sequential read: zlib decompresses chunk by chunk, headers are
split off at the blank line, Content-Length frames the block, the block is hashed as it passes
(WARC-Block-Digest, and WARC-Payload-Digest behind the HTTP header), and each gzip member must end
with its record.  A damaged archive raises ArchiveError with file and offset.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the smallest id is the
response, the others are revisits without payload that name it; shorter ones are all responses.

Defined results: a null payload is empty; a row without an id is a response if no equal payload has
an id, else a revisit; rows that repeat the smallest id are all responses; a null address gives no
WARC-Target-URI; blanks and control characters in addresses are percent-encoded; an empty table
gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.arrow import once, small_batches
from tallyspark.llm.byid import split
from tallyspark.llm.work import Workspace, remove

MIN_REVISIT = 100
CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean"


class ArchiveError(ValueError):
    pass


def record_uri(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(uri: str | None) -> int | None:
    value = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def encode_uri(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    digest = hashlib.sha256(payload).hexdigest()
    http = HTTP % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {encode_uri(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Stream:
    """Uncompressed bytes of one gzip member after another, decompressed as they are asked for."""

    def __init__(self, read: Callable[[int], bytes], name: str):
        self.read_raw, self.name = read, name
        self.raw, self.data, self.offset = b"", b"", 0
        self.member = None

    def fail(self, what: str) -> ArchiveError:
        return ArchiveError(f"{self.name}: {what} in the member at byte {self.offset}")

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if self.member is not None:
            while not self.member.eof:
                if self.data or not self.more():
                    raise self.fail("bytes after the record" if self.data else "cut off")
            if self.data:
                raise self.fail("bytes after the record")
            self.raw = self.member.unused_data
        if not self.raw:
            self.raw = self.read_raw(CHUNK)
        self.member = zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bool:
        """Decompress some more; False if the member is over."""
        if self.member.eof:
            return False
        raw = self.member.unconsumed_tail or self.raw or self.read_raw(CHUNK)
        self.raw = b""
        if not raw:
            raise self.fail("cut off")
        try:
            self.data += self.member.decompress(raw, CHUNK)
        except zlib.error as e:
            raise self.fail(str(e)) from e
        return True

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark; a header may be of any length that memory holds."""
        seen = 0
        while (at := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if not self.more():
                raise self.fail("no end of a header")
        found, self.data = self.data[:at], self.data[at + len(mark):]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.more():
                raise self.fail("short block")
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            if part:
                yield part


def read_records(read: Callable[[int], bytes], name: str, with_payload: bool = False) -> Iterator[dict]:
    """Records of one archive, in order."""
    stream = Stream(read, name)
    while stream.next_member():
        lines = stream.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise stream.fail("no WARC version line")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        declared = {part: head.get(f"warc-{part}-digest") for part in ("block", "payload")}
        block, payload = Digest(declared["block"]), Digest(declared["payload"])
        http, kept, size = b"", [], 0
        in_payload = not head.get("content-type", "").lower().startswith("application/http")  # of other records the block is the payload
        try:
            length = int(head["content-length"])
        except (KeyError, ValueError) as e:
            raise stream.fail("no Content-Length") from e
        for part in stream.take(length):
            block.update(part)
            if not in_payload:
                http += part
                front, mark, part = http.partition(b"\r\n\r\n")
                if not mark:
                    continue
                http, in_payload = front, True
            payload.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise stream.fail("no end of record")
        revisit = head.get("warc-type") == "revisit"
        checks = [block.matches()]
        digest = payload.sha256.hexdigest()
        if revisit:  # its HTTP header, if it has one, tells the length of the full payload
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
            size = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
            digest = (declared["payload"] or "").removeprefix("sha256:") or None
        else:
            checks.append(payload.matches())
        known = [c for c in checks if c is not None]
        yield {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
               "payload_bytes": size, "payload_digest": digest, "digest_ok": all(known) if known else None, "payload": b"".join(kept) if with_payload and not revisit else None}


class Digest:
    """A running SHA-256, and the digest that a header declares: hexadecimal or base 32, of any algorithm of hashlib's."""

    def __init__(self, declared: str | None):
        name, _, self.value = (declared or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.sha256 = hashlib.sha256()
        self.own = None if name not in hashlib.algorithms_guaranteed or name.startswith("shake") else self.sha256 if name == "sha256" else hashlib.new(name)

    def update(self, part: bytes) -> None:
        self.sha256.update(part)
        if self.own is not None and self.own is not self.sha256:
            self.own.update(part)

    def matches(self) -> bool | None:
        """None where no digest, or one of an unknown algorithm, is declared."""
        if self.own is None:
            return None
        found = self.own.digest()
        return self.value.strip().lower() == found.hex() or self.value.strip().upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def plan_records(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, revisit, refers_to: which rows repeat a payload.

    Only digests of repeated payloads are joined back, and only rows whose digest may be among
    them (by a bitmap of bounded size) go through that join; Spark splits a hot digest.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= MIN_REVISIT, F.sha2("payload", 256))
    first = rows.select("page_id", digest.alias("_digest")).where("_digest is not null").groupBy("_digest")
    first = work.save(first.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "repeated")
    maybe, rest = split(once(rows, _digest=digest), first.select("_digest"), "_digest")
    found = maybe.join(first, "_digest", "left").unionByName(rest.withColumn("first", F.lit(None).cast("bigint")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned records to archives in ``folder``; returns the manifest (path, records, bytes)."""
    small_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        sink = path = None
        records = size = 0
        for batch in batches:
            for page, url, payload, revisit, refers_to in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if sink is None:
                    path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(path, compression=None)
                data = gzip_member(record(page, url, payload, refers_to, revisit))
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
                    sink, records, size = None, 0, 0
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return records.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(write, "path string, records bigint, bytes bigint")


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in the manifest (column ``path``)."""
    schema = RECORD + ", payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pa.fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for x in read_records(source.read, path, with_payload):
                        rows.append(x)
                        size += len(x["payload"] or b"")
                        if len(rows) >= 512 or size >= 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)

    # each archive is a task's sequential read; the paths are dealt out by their random names
    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 4096), "path").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok, read back from archives."""
    spark: SparkSession = pages.sparkSession
    work = Workspace(spark, "warc")
    folder = f"{work.root}/archives"
    manifest = work.save(write_warc(plan_records(pages, work), folder), "manifest")
    page = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("bigint")
    found = read_warc(manifest, folder).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok")
    out = work.save(found, "records")
    work.drop_all_but(out)
    remove(spark, folder)
    return out


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select h, min(page_id) as first from p where n >= {MIN_REVISIT} group by h)
select page_id, n::bigint as payload_bytes, sha256(p.h) as payload_digest,
  case when n >= {MIN_REVISIT} and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when n >= {MIN_REVISIT} and page_id is distinct from first then first end as refers_to, true as digest_ok
from p left join f on p.h = f.h"""
