"""WARC archives: a writer with revisit records, and a sequential reader.

Writer. Payloads are grouped by SHA-1 in the JVM: the smallest page_id of each digest that several pages have is found by
an aggregation that combines before the shuffle. The few payloads of very many pages are broadcast to these, the others
joined on the digest. Each page then becomes one gzip member: a `response` record with the HTTP block, or, for a payload
that another page holds, a `revisit` record (profile identical-payload-digest) with the HTTP header only. Members are
put together to archives of about `archive_bytes`; archives are rows (name, content) of a table, so that any store that
Spark writes holds them and a lost task is redone by Spark's commit protocol. `export` makes .warc.gz files of them.

Reader. One pass over an archive's bytes: zlib decompresses member by member in pieces of fixed size; each record is
framed by its Content-Length and its digests are verified. What fails is reported in `problem`, not dropped: a damaged or
cut member, or bytes between members, give one row, and reading goes on at the next member.

Cases: null html is an empty payload; a null page_id is never the smallest unless all of its payload's are null, and
is read back as null; pages with one page_id and one payload are all responses if theirs is the smallest; null or odd
urls are written percent-encoded; an empty table gives an empty archive table and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, read_table, texts_of

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE, _NO_PAGE = 0x70616765 << 96, 0x6E6F6E65 << 96  # so that record ids of pages and of none differ
_CHUNK = 1 << 16

READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_PAGE if page_id is None else _PAGE | page_id & (1 << 64) - 1)}>"


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").rpartition(":")[2]).int
    if value >> 96 << 96 == _NO_PAGE:
        return None
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int) -> bytes:
    """One record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, archive_bytes: int = 4 << 20, level: int = 4, least: int = 0, hot: int = 10_000) -> DataFrame:
    """page_id, url and html to archives (name, content). Payloads of at least `least` bytes are written once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    scratch = Scratch(pages.sparkSession, "payloads")
    firsts = scratch.table(rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"))
    least_hot = max(hot, (firsts.agg(F.sum("n")).first()[0] or 0) // 1000)  # fewer than a thousand payloads have more pages
    most = F.broadcast(firsts.filter(F.col("n") > least_hot).select("digest", "first_id"))
    rest = rows.join(most, "digest", "left_anti").join(firsts.filter(F.col("n") <= least_hot), "digest", "left")
    alone = F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("first_id")).alias("first_id")
    marked = rows.join(most, "digest").select("page_id", "url", "html", "first_id").unionByName(rest.select("page_id", "url", "html", alone))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for page, url, payload, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                revisit = len(payload) >= least and page != first
                held.append(member(page, url, payload, first, revisit, level))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    n, held, size = n + 1, [], 0
        if held:
            yield archive()

    return marked.mapInArrow(run, "name string, content binary")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    problem: str | None


_MAGIC = b"\x1f\x8b\x08"


def members(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """What the members of an archive hold, in order, each decompressed in pieces; and what is wrong with it."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out, start, problem = zlib.decompressobj(31), bytearray(), at, None
        if content[at : at + 3] != _MAGIC:
            problem = "bytes that are no gzip member"
        while not problem and not z.eof:
            chunk = view[at : at + _CHUNK]
            if not chunk:
                problem = "the archive ends inside a member"
                break
            try:
                out += z.decompress(chunk)
            except zlib.error as e:
                problem = f"a member cannot be decompressed: {e}"
                break
            at += len(chunk) - len(z.unused_data)
        if problem:
            at = content.find(_MAGIC, start + 1)
            at = len(view) if at < 0 else at
        yield bytes(out), problem


_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def fields(head: bytes) -> dict[str, str]:
    return {k.decode(errors="replace").lower(): v.decode(errors="replace") for k, v in _LINE.findall(head)}


def number(text: str | None) -> int:
    """A length, or -1 for what is none."""
    return int(text) if text is not None and text.isascii() and text.isdigit() else -1


def records(content: bytes) -> Iterator[Record]:
    """The records of an archive, one gzip member each, in order."""
    for whole, problem in members(content):
        head, found, rest = whole.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        headers = fields(lines + b"\r\n") if found else {}
        length = number(headers.get("content-length"))
        block, tail = (rest[:length], rest[length:]) if length >= 0 else (rest, b"")
        if problem:
            pass
        elif not found:
            problem = "no end of the header"
        elif not version.startswith(b"WARC/1."):
            problem = "unknown version"
        elif length < 0 or len(block) != length or tail != b"\r\n\r\n":
            problem = "Content-Length does not frame the record"
        elif (d := headers.get("warc-block-digest")) and d != f"sha1:{sha1_base32(block)}":
            problem = "the block's digest differs"
        yield Record(headers, block, problem)


def page_row(r: Record) -> tuple:
    """A row of READ_SCHEMA from a record of HTTP content."""
    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    head, _, payload = r.block.partition(b"\r\n\r\n")
    http = fields(head.partition(b"\r\n")[2] + b"\r\n")
    revisit, problem = r.headers.get("warc-type") == "revisit", r.problem
    size = number(http.get("content-length")) if revisit else len(payload)
    if not problem and not revisit and sha1_base32(payload) != digest:
        problem = "the payload's digest differs"
    ids = []
    for name in ("warc-record-id", "warc-refers-to"):
        try:
            ids.append(page_of(r.headers[name]) if name in r.headers else None)
        except ValueError:
            ids.append(None)
            problem = problem or f"{name} is no id of a page"
    return ids[0], size, digest, r.headers.get("warc-type"), ids[1] if revisit else None, problem


def read_archives(archives: DataFrame) -> DataFrame:
    """Archives with a column `content`, as write_archives or Spark's binaryFile source gives them, to one row a record."""
    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [page_row(r) for r in records(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    return archives.select("content").mapInArrow(run, READ_SCHEMA)


def export(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a file of its own into a folder that this machine sees, one after the other: for extracts, not for whole crawls."""
    from pathlib import Path

    for r in archives.toLocalIterator():
        Path(folder, r["name"]).write_bytes(r["content"])


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = Scratch(spark, "warc").table(write_archives(read_table(spark, sf_dir, "pages")))
    return read_archives(written)
