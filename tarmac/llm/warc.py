"""WARC archives: writer with revisit records, and a salvage reader.

The reader checks every record (gzip CRC, header, length, digests).  After a
failed check it searches for the next gzip member or version line that starts a
record, goes on there, and reports the bytes in between as a quarantined gap.  The
same holds inside a member of many records: what a damaged member still unpacks to is
searched for version lines, and records whose own digest holds are recovered from it.
If a member's checksum fails and no record in it does, the damage must lie in some
header, and the whole member is quarantined; so is a record that ends just where a
member breaks off.

Archives live in the shared folder and are opened through pyarrow's file
systems, so any store that it reaches will do.  A writing task puts its file
under a name of its own and renames it when complete; a second attempt of a lost
task replaces the file by an equal one.

Defined cases: a null payload is empty; a null id is written as such and never
becomes the response that others refer to while the group has another id; rows
that repeat id and payload share their record type; columns of the pages beside the
three that are named play no part, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from uuid import UUID

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import shared_path, text_of, written

CHUNK = 1 << 18
ROTATE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
#: A header that doesn't end within so many bytes is damaged.
HEADER_BYTES = 1 << 20
#: Records of a member wait for its checksum up to so many bytes; beyond them those with a digest of their own go on.
HELD_BYTES = 64 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.md5(f'{page_id}|{payload_digest}'.encode()).digest())}>"


def make_record(page_id: int | None, url: str | None, payload: bytes | None, payload_digest: str, payload_bytes: int, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit that names the response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if payload is None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = {"WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": record_id(page_id, payload_digest), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}
    if page_id is not None:
        head["Page-Id"] = str(page_id)
    if payload is None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, payload_digest), "Refers-To-Page": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The HTTP body."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Gap:
    """Bytes of the archive that are quarantined; with ``inside``, bytes of the unpacked member at ``offset``, from there on."""

    offset: int
    length: int
    reason: str
    inside: int | None = None


class Damaged(Exception):
    """A failed check; ``need``: bytes from the record's start that might mend it."""

    def __init__(self, reason: str, need: int = 0):
        super().__init__(reason)
        self.need = need


def parse_record(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; raises Damaged."""
    if not (m := VERSION.match(data, at)):
        raise Damaged("no version line", need=32 if len(data) - at < 32 else 0)
    close = re.compile(rb"\r?\n\r?\n").search(data, m.end() - 1)
    if not close:
        raise Damaged("headers don't end", need=len(data) - at + 1 if len(data) - at < HEADER_BYTES else 0)
    headers: dict[str, str] = {}
    for line in data[m.end() : close.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise Damaged("bad length")
    start, end = close.end(), close.end() + int(length)
    if end > len(data):
        raise Damaged("block cut short", need=end - at + 2)
    tail = re.compile(rb"(\r?\n){2}").match(data, end)
    if not tail:
        raise Damaged("no end of record", need=len(data) - at + 1 if len(data) < end + 4 else 0)
    block = bytes(data[start:end])
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != sha1_base32(block):
        raise Damaged("block digest differs")
    return headers, block, tail.end()


class SalvageReader:
    """Iterates over the Records and Gaps of one archive, gzipped by record, by several, as a whole, or plain."""

    def __init__(self, source, size: int):
        """``source``: random access through read_at(n, offset)."""
        self.source, self.size = source, size

    def _unpacked(self, at: int) -> Iterator[bytes]:
        """What the member at ``at`` unpacks to, up to its damage if any; returns its end."""
        unpacker, pos = zlib.decompressobj(31), at
        while not unpacker.eof:
            chunk = self.source.read_at(CHUNK, pos)
            if not chunk:
                raise Damaged("member cut short")
            spare = unpacker.copy()
            try:
                part = unpacker.decompress(chunk)
            except zlib.error as e:
                yield from self._up_to_damage(spare, chunk)
                raise Damaged(f"member: {e}") from None
            pos += len(chunk)
            yield part
        return pos - len(unpacker.unused_data)

    @staticmethod
    def _up_to_damage(unpacker, chunk: bytes) -> Iterator[bytes]:
        """A chunk in ever smaller steps, so that nothing in front of the damage is lost."""
        at = 0
        for step in (4096, 64, 1):
            while at < len(chunk):
                spare = unpacker.copy()
                try:
                    yield unpacker.decompress(chunk[at : at + step])
                except zlib.error:
                    unpacker = spare
                    break
                at += step

    def _member(self, at: int) -> Iterator[Record | Gap]:
        """Records and Gaps of the member at ``at``; returns where to go on."""
        feed, data, base, want = self._unpacked(at), bytearray(), 0, CHUNK
        end = failure = lost = None
        held: list[Record | Gap] = []
        waiting, reason, released = 0, "", False
        gap = lambda: Gap(at, base - lost, reason, inside=lost)
        sealed = lambda x: isinstance(x, Gap) or x.headers.get("warc-block-digest", "").startswith("sha1:")

        while True:
            while end is None and failure is None and len(data) < want:
                try:
                    data += next(feed)
                except StopIteration as stop:
                    end = stop.value
                except Damaged as e:
                    failure = e
            if not data:
                break
            try:
                headers, block, n = parse_record(data)
            except Damaged as e:
                if e.need > len(data) and end is None and failure is None:
                    want = max(e.need, 2 * len(data))
                    continue
                if lost is None:
                    lost, reason = base, str(e)
                mark = VERSION.search(data, 1)
                last = end is not None or failure is not None
                cut = mark.start() if mark else len(data) if last else max(1, len(data) - 16)  # a version line may straddle two chunks
                del data[:cut]
                base, want = base + cut, CHUNK
                continue
            if lost is not None:
                held.append(gap())
                lost = None
            held.append(Record(at, 0, headers, block))
            waiting += len(block)
            del data[:n]
            base, want = base + n, CHUNK
            if waiting > HELD_BYTES:
                yield from filter(sealed, held)
                held, waiting, released = [x for x in held if not sealed(x)], 0, True
        if lost is not None:
            held.append(gap())
        resume, kept = end, held
        checksum = bool(re.search("(data|length) check", str(failure)))
        if failure is not None:
            resume = self._next(at + 1)
            touched = held[-1:] if lost is None and not checksum else []  # ends where the damage begins
            kept = [x for x in held if sealed(x) and x not in touched]
            if checksum and not any(isinstance(x, Gap) for x in kept):
                kept = []
        if not released and not any(isinstance(x, Record) for x in kept):
            yield Gap(at, resume - at, reason or str(failure or "empty member"))
            return resume
        yield from (x if isinstance(x, Gap) else replace(x, length=resume - at) for x in kept)
        if failure is not None and (not checksum or len(kept) < len(held)):
            yield Gap(at, 0, str(failure), inside=base)
        return resume

    def _plain(self, at: int) -> tuple[Record, int]:
        want = CHUNK
        while True:  # a record longer than what was read is read again
            data = self.source.read_at(min(want, self.size - at), at)
            try:
                headers, block, end = parse_record(data)
                return Record(at, end, headers, block), at + end
            except Damaged as e:
                if not len(data) < e.need <= self.size - at:
                    raise
                want = max(e.need, 2 * want)

    def _starts(self, at: int) -> bool:
        """Whether a record or the member of one starts here."""
        head = self.source.read_at(1024, at)
        if head.startswith(GZIP):
            try:
                head = zlib.decompressobj(31).decompress(head, 64)
            except zlib.error:
                return False
        return bool(VERSION.match(head))

    def _next(self, at: int) -> int:
        """The next position from ``at`` where a record starts, or the end of the archive."""
        look = re.compile(re.escape(GZIP) + rb"|" + VERSION.pattern)
        while at < self.size:
            data = self.source.read_at(CHUNK, at)
            for m in look.finditer(data):
                if self._starts(at + m.start()):
                    return at + m.start()
            if at + len(data) >= self.size:
                break
            at += max(1, len(data) - 16)  # a mark may straddle two chunks
        return self.size

    def __iter__(self) -> Iterator[Record | Gap]:
        at = 0
        while at < self.size:
            if self.source.read_at(3, at) == GZIP:
                at = yield from self._member(at)
                continue
            try:
                record, end = self._plain(at)
                yield record
                at = end
            except Damaged as e:
                resume = self._next(at + 1)
                yield Gap(at, resume - at, str(e))
                at = resume


def _write_part(directory: str, compress: bool):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, number, out, rows, size = f"part-{task.partitionId():06d}", 0, None, 0, 0
        draft = lambda: f"{root}/_{stem}-{number:03d}-{task.taskAttemptId()}"
        final = lambda: f"{stem}-{number:03d}.warc" + ".gz" * compress
        done = []
        for batch in batches:
            for page, url, payload, digest, n, first in zip(*[c.to_pylist() for c in batch.columns]):
                out = out or store.open_output_stream(draft())
                data = make_record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), n, first)
                data = gzip_member(data) if compress else data
                out.write(data)
                rows, size = rows + 1, size + len(data)
                if size >= ROTATE_BYTES:
                    out.close()
                    store.move(draft(), f"{root}/{final()}")
                    done.append((f"{directory}/{final()}", rows, size))
                    number, out, rows, size = number + 1, None, 0, 0
        if out:
            out.close()
            store.move(draft(), f"{root}/{final()}")
            done.append((f"{directory}/{final()}", rows, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def write_archives(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, compress: bool = True) -> DataFrame:
    """Write a record per row; returns the list of archives (path, records, bytes).

    Roles come from narrow rows (id, digest, length): the smallest id of each
    payload is the response.  Bodies travel once, to their archive, and those of
    revisits not at all.
    """
    body = text_of(payload_col).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body")).select("*", F.sha1("body").alias("sha"), F.octet_length("body").cast("long").alias("n"))
    # SHA-1 is what archives state; payloads that were made to collide under it differ in SHA-256
    narrow = written(base.select("id", "sha", F.unhex(F.sha2("body", 256)).alias("key"), "n"), "payloads")
    first = narrow.where(F.col("n") >= min_bytes).groupBy(F.col("key").alias("fkey")).agg(F.min("id").alias("first"))
    # only revisits need their response's id, one row each
    again = narrow.join(first, F.col("key") == F.col("fkey")).where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    again = again.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "first").distinct()
    rows = base.join(again, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")
    rows = rows.select("id", "url", F.when(F.col("first").isNull(), F.col("body")).alias("body"), "sha", "n", "first").sortWithinPartitions("id", "sha")
    return written(rows.mapInArrow(_write_part(directory, compress), "path string, records long, bytes long"), "archives")


def _read_parts(with_payload: bool):
    fields = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def one(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            where = "" if x.inside is None else f", unpacked from byte {x.inside} on"
            return (path, x.offset, x.length, x.reason + where, *[None] * (len(fields) - 4))
        h = x.headers
        kind, payload = h.get("warc-type"), x.payload
        whole = kind != "revisit"
        number = lambda v: int(v) if v and re.fullmatch(r"-?\d+", v) else None
        inner = re.search(rb"(?im)^content-length: *(\d+)", x.block.partition(b"\r\n\r\n")[0])
        digest = sha1_base32(payload) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:")
        size = len(payload) if whole else int(inner[1]) if inner else None
        row = (path, x.offset, x.length, None, number(h.get("page-id")), h.get("warc-target-uri"), kind, number(h.get("refers-to-page")), digest, size)
        return (*row, payload if whole else None) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as source:
                    for x in SalvageReader(source, source.size()):
                        rows.append(one(path, x))
                        held += x.length
                        if len(rows) >= 2000 or held > 32 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record or gap of the archives (column ``path``), read by one task each."""
    kinds = "path string, offset long, length long, gap string, page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long" + ", payload binary" * with_payload
    files = written(archives.select("path").distinct(), "paths")
    n = max(1, min(20_000, files.count()))
    # by range every path has a partition of its own, which hashes can't promise
    return files.repartitionByRange(n, "path").mapInArrow(_read_parts(with_payload), kinds)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as archives and read them back: one row per page.  A gap in them, which would lose pages, is an error."""
    archives = write_archives(pages, shared_path(pages.sparkSession, "warc"), min_bytes=min_bytes)
    found = read_archives(archives, with_payload=False)
    whole = F.when(F.col("gap").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("damaged archive"), "path", "gap"))).otherwise(F.col("page_id")).cast("long")
    return found.select(whole.alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


WARC_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS sha, min(page_id) OVER (PARTITION BY body) AS first FROM rows
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(sha, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""
