"""WARC archives: a writer through Spark's own file committer, and a sequential reader.

A record is one gzip member. The reader inflates members piece by piece, takes the header up to the blank line, frames
the block by Content-Length, checks the end of the record and verifies both digests.

Archives are written by the text writer, so tasks can be lost and repeated like any others and no executor touches a
local folder. That works because a gzip member ends in the high byte of its length, which is zero for records under
16 MB: members are handed over without that byte, and the writer's line separator is a zero byte. (A larger record is
followed by an empty member.) The files are plain multi-member gzip files.

Defined cases
* null html: an empty payload. Null url: an empty target. Null page_id: a record of its own; it is never referred to
  unless no row with the payload has an id, and then every such row is a response.
* repeated rows: all rows that hold the largest page_id of a payload are responses.
* empty table: no records. Other columns are not carried over.
* a cut or damaged archive: WarcError names the place; nothing is skipped silently.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, sized_broadcast, written

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Payload bytes of one archive file, on average; a reader holds one compressed file.
ARCHIVE_BYTES = 64 * 1024 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int
    problems: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers of the message in the block, and its payload."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
        elif line:
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            found[last] = value.strip().decode("utf-8", "replace")
    return found


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_hex(labelled: str) -> str:
    return base64.b32decode(labelled.partition(":")[2]).hex()


class _Members:
    """Inflates the members of a stream one after the other, a piece at a time."""

    def __init__(self, stream: BinaryIO):
        self._stream, self._raw, self.offset = stream, b"", 0
        self._open: zlib._Decompress | None = None

    def begin(self) -> bool:
        if not self._raw:
            self._raw = self._stream.read(CHUNK)
        if not self._raw:
            return False
        self._open = zlib.decompressobj(31)
        return True

    def piece(self) -> bytes:
        """More of the open member; empty at its end."""
        while not self._open.eof:
            if not self._raw:
                self._raw = self._stream.read(CHUNK)
                if not self._raw:
                    raise WarcError(f"the member at byte {self.offset} is cut off")
            try:
                out = self._open.decompress(self._raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"the member at byte {self.offset} is damaged: {e}") from e
            self._used(len(self._raw))
            self._raw = self._open.unused_data or self._open.unconsumed_tail
            self._used(-len(self._raw))
            if out:
                return out
        return b""

    _count = 0

    def _used(self, n: int) -> None:
        self._count += n

    def end(self) -> None:
        self.offset = self._count


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """Every record of an archive, in order. Memory: one record."""
    members = _Members(stream)
    while members.begin():
        data = bytearray()
        at, sought = -1, 0
        while at < 0 and (piece := members.piece()):
            data += piece
            at = data.find(b"\r\n\r\n", sought)
            sought = max(0, len(data) - 3)
        if not data:
            members.end()
            continue  # an empty member
        if at < 0 or not data.startswith(b"WARC/"):
            raise WarcError(f"no record header at byte {members.offset}")
        headers = _fields(bytes(data[:at]).split(b"\r\n")[1:])
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError(f"no content length at byte {members.offset}") from None
        del data[: at + 4]
        while piece := members.piece():
            data += piece
            if len(data) > length + 4:
                raise WarcError(f"the record at byte {members.offset} is longer than its content length")
        if len(data) != length + 4 or not data.endswith(b"\r\n\r\n"):
            raise WarcError(f"the record at byte {members.offset} does not end where its content length says")
        record = Record(headers, bytes(data[:length]), members.offset)
        if "warc-block-digest" in headers and headers["warc-block-digest"] != digest(record.block):
            record.problems.append("block digest")
        if record.kind == "response" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != digest(record.http()[1]):
            record.problems.append("payload digest")
        yield record
        members.end()


def member(kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = b"\r\n".join(http) + b"\r\n\r\n" + (payload if kind == "response" else b"")
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The pages with _refers_to: the largest id with an equal payload of at least least_bytes, for the others that have it."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    sums = pages.select(F.col(id_col).alias("_id"), F.sha2(payload, 256).alias("_sum"), F.octet_length(payload).alias("_bytes")).filter(F.col("_bytes") >= least_bytes)
    groups = written(sums.groupBy("_sum").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sum", "_last"), "revisits")
    found = pages.join(sized_broadcast(groups, 120), F.sha2(payload, 256) == groups["_sum"], "left")
    return found.withColumn("_refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("_last")), F.col("_last"))).drop("_sum", "_last")


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per page to gzip files in the folder."""
    size = pages.agg(F.sum(F.octet_length(html_col) + 1000)).first()[0] or 0
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = with_revisits(named, id_col="id").repartition(1 + size // archive_bytes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, html, refers = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary()), batch.column(3)
            for at in range(0, batch.num_rows, 200):
                out = []
                for i in range(at, min(at + 200, batch.num_rows)):
                    other = refers[i].as_py()
                    out.append(member("response" if other is None else "revisit", ids[i].as_py(), urls[i].as_py() or "", html[i].as_py() or b"", other, date)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = own.select("id", "url", "html", "_refers_to").mapInArrow(pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in the folder: page_id, target, record_type, refers_to, payload_bytes, payload_digest (hex), payload (null for revisits). Raises on any damage."""

    def page(urn: str | None) -> int | None:
        number = (urn or "").strip("<>").rpartition(":")[2]
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_records(io.BytesIO(memoryview(content.as_buffer()))):
                    if r.problems:
                        raise WarcError(f"the record at byte {r.offset} has a wrong {' and '.join(r.problems)}")
                    http, payload = r.http()
                    rows.append((page(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), r.kind, page(r.headers.get("warc-refers-to")), int(http.get("content-length", len(payload))), digest_hex(r.headers["warc-payload-digest"]), payload if r.kind == "response" else None))
                    if len(rows) == 200:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "target", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col=id_col)
    return read_archives(pages.sparkSession, path)
