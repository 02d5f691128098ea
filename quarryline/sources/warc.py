"""WARC archives as a Python data source (read and write), and CDX lookups.

A compressed archive is a row of gzip members, mostly one for each record; the reader streams through it record by record, so its memory
is bounded by the largest record. Long files are read by several tasks: each begins at the first member that starts in its range of
bytes, found by unpacking what looks like one. Paths are those of pyarrow's file systems (local, s3, gs, hdfs, ...), which read by
ranges; ``records`` reads through Spark's binaryFile instead, for stores that only Spark can open.

A record's place is (offset, within): the byte at which its gzip member starts (in an archive that isn't compressed, the record itself)
and its place in the unpacked member, 0 for the first one. What breaks off is a row of type ``torn`` without content.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import glob
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import urls
from .files import place

SCHEMA = "file string, offset long, within long, url string, warc_type string, crawl_date timestamp, http_status int, mime string, http_header string, content binary"
FIELDS = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("within", pa.int64()), ("url", pa.string()), ("warc_type", pa.string()), ("crawl_date", pa.timestamp("us", "UTC")),
    ("http_status", pa.int32()), ("mime", pa.string()), ("http_header", pa.string()), ("content", pa.binary()),
])
BLOCK = 1 << 20
#: Bytes of content and records that a task holds before it hands them on; a record stays whole.
SLICE, SLICE_ROWS = 4 << 20, 1000
#: Bytes of a compressed archive that one task reads, about.
SPLIT = 64 << 20
MAGIC = b"\x1f\x8b\x08"


def archives(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, of the archives in a folder, or of those that fit a glob. What is being written begins with _ or a dot."""
    system, at = place(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(at) if not glob.has_magic(at) else None
    if found is not None and found.type == FileType.File:
        return [(path, found.size)]
    if found is not None:
        fits = lambda p: ".warc" in p
    else:
        fits, at = (lambda p, pattern=at: fnmatch.fnmatch(p, pattern)), re.split(r"[*?\[]", at)[0].rpartition("/")[0]
    every = system.get_file_info(FileSelector(at, allow_not_found=True, recursive=True))
    return sorted((prefix + f.path, f.size) for f in every if f.type == FileType.File and fits(f.path) and f.base_name[:1] not in "_.")


class Stream:
    """Unpacked bytes of an archive with the place where they start; ``read(n)`` gives the next stored bytes."""

    def __init__(self, read):
        self.read = read
        self.stored = read(BLOCK)
        self.packed = self.stored[:2] == b"\x1f\x8b"
        self.gz = None
        self.offset = self.within = 0  # of the first byte held
        self.next = 0  # stored bytes used
        self.held = b""
        self.torn = False

    def more(self) -> bool:
        """Holds more bytes of the same member, if there are any."""
        if not self.packed:
            self.held += self.stored
            got, self.stored = bool(self.stored), self.read(BLOCK)
            return got
        while self.gz is not None:
            if not self.stored:
                self.stored = self.read(BLOCK)
                if not self.stored:
                    self.gz, self.torn = None, True
                    return False
            out = self.gz.decompress(self.stored)
            self.next += len(self.stored) - len(self.gz.unused_data)
            self.stored = self.gz.unused_data
            if self.gz.eof:
                self.gz = None
            if out:
                self.held += out
                return True
        return False

    def member(self) -> bool:
        """Goes on to the next member."""
        if not self.packed:
            return False
        self.held, self.within = b"", 0
        self.stored = self.stored or self.read(BLOCK)
        if self.stored[:2] != b"\x1f\x8b" and len(self.stored) > 1:
            self.stored = b""  # no member: padding or what broke off
        self.offset, self.gz = self.next, zlib.decompressobj(31) if self.stored else None
        return self.gz is not None

    def take(self, n: int) -> bytes:
        """Up to n bytes of the member, which are gone then."""
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self.more():
                break
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        if self.packed:
            self.within += min(n, size)
        else:
            self.offset += min(n, size)
        return whole[:n]

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which is gone with it; None without one."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        return self.take(at + len(mark))[:at]


def headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def record(file: str, offset: int, within: int, head: dict[str, str], body: bytes) -> tuple:
    """The row of one record; the HTTP framing of a response is taken off."""
    status = mime = http = None
    content = body
    if body[:5] == b"HTTP/":
        top, _, content = body.partition(b"\r\n\r\n")
        http = top.decode("latin-1")
        first = http.split("\r\n", 1)[0].split(" ")
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        fields = headers(top)
        mime = fields.get("content-type", "").split(";")[0].strip().lower() or None
        if "chunked" in fields.get("transfer-encoding", "").lower():
            content = unchunked(content)
    try:
        date = dt.datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00")).astimezone(dt.UTC)
    except ValueError:
        date = None
    return file, offset, within, head.get("warc-target-uri"), head.get("warc-type"), date, status, mime, http, content


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data  # not chunked after all
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + size + 4
    return b"".join(out)


def records_of(file: str, read) -> Iterator[tuple]:
    """Rows of an archive; a member may hold several records."""
    stream = Stream(read)
    while stream.member() or not stream.packed:
        yield from records_in(file, stream)
        if stream.torn or not stream.packed:
            break


def records_in(file: str, stream: Stream) -> Iterator[tuple]:
    """The records of the stream's member, from where it stands."""
    torn = (None, "torn", None, None, None, None, None)
    while True:
        while stream.held[:1] in (b"\r", b"\n") or not stream.held and stream.more():
            if stream.held[:1] in (b"\r", b"\n"):
                stream.take(1)
        if not stream.held:
            if stream.torn:
                yield (file, stream.offset, stream.within, *torn)
            return
        at = stream.offset, stream.within
        block = stream.until(b"\r\n\r\n")
        if block is None or not block.startswith(b"WARC/"):
            yield (file, *at, *torn)
            return
        head = headers(block)
        length = int(head.get("content-length", "0") or 0)
        body = stream.take(length)
        if len(body) < length:
            yield (file, *at, *torn)
            return
        yield record(file, *at, head, body)


def is_member(source, at: int) -> bool:
    """Whether a member with a record starts at a place: it unpacks to one, and another member or nothing follows."""
    source.seek(at)
    gz, head = zlib.decompressobj(31), b""
    try:
        while not gz.eof:
            block = source.read(BLOCK)
            if not block:
                return head.startswith(b"WARC/")  # what is torn is a member as well
            out = gz.decompress(block)
            if len(head) < 5:
                head += out[:5]
                if not b"WARC/".startswith(head[:5]) and head:
                    return False
    except zlib.error:
        return False
    after = gz.unused_data or source.read(len(MAGIC))
    return head.startswith(b"WARC/") and (len(after) < 2 or MAGIC.startswith(after[:3]) or not after.strip(b"\0"))


def first_member(source, start: int, end: int) -> int | None:
    """The first member that starts in a range of bytes."""
    at = start
    while at < end:
        source.seek(at)
        block = source.read(BLOCK + len(MAGIC) - 1)
        found = block.find(MAGIC)
        while 0 <= found < BLOCK:
            if at + found >= end:
                return None
            if is_member(source, at + found):
                return at + found
            found = block.find(MAGIC, found + 1)
        at += BLOCK
    return None


def records_between(file: str, source, start: int, end: int) -> Iterator[tuple]:
    """Rows of the members that start in a range of bytes; an archive that isn't compressed is one range."""
    source.seek(0)
    first = start
    if start and source.read(2) == MAGIC[:2]:
        first = first_member(source, start, end)
    if first is None:
        return
    source.seek(first)
    stream = Stream(source.read)
    stream.next = first
    while stream.member() or not stream.packed:
        if stream.packed and stream.offset >= end:
            break
        yield from records_in(file, stream)
        if stream.torn or not stream.packed:
            break


def in_slices(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of a bounded size, so that what a task holds doesn't grow with the archive."""
    some, held = [], 0

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), FIELDS, strict=True)], schema=FIELDS)

    for row in rows:
        some.append(row)
        held += len(row[-1] or b"")
        if held >= SLICE or len(some) == SLICE_ROWS:
            yield handed_on()
            some, held = [], 0
    if some:
        yield handed_on()


def record_at(file: str, read, offset: int, within: int) -> tuple | None:
    """The record at a place; ``read`` gives bytes from ``offset`` on."""
    for row in records_of(file, read):
        if row[2] == within:
            return (file, offset, *row[2:])
        if row[2] > within or row[1]:
            return None
    return None


def framed(url: str, date: dt.datetime, payload: bytes) -> bytes:
    """A response record as one gzip member."""
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date.strftime('%Y-%m-%dT%H:%M:%SZ')}\r\n"
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + payload + b"\r\n\r\n") + gz.flush()


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, size in archives(self.path):
            system, at = place(path)
            with system.open_input_file(at) as source:
                packed = source.read(2) == MAGIC[:2]
            step = self.split if packed else max(size, 1)
            found += [Range(path, start, min(size, start + step)) for start in range(0, max(size, 1), step)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            system, at = place(partition.path)
            with system.open_input_file(at) as source:
                yield from in_slices(records_between(partition.path, source, partition.start, partition.end))


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceWriter):
    """One archive for each task, under a name of the attempt until the job commits. Then those of the attempts that count get their
    names, and what others of the job have left goes."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, folder = place(self.path)
        name, n = uuid.uuid4().hex, 0
        system.create_dir(folder)
        path = f"{folder}/_tmp_{self.job}_{name}.warc.gz"
        with system.open_output_stream(path, compression=None) as out:
            for row in rows:
                http = (row["http_header"] or "HTTP/1.1 200 OK\r\nContent-Type: text/html").encode("latin-1", "replace")
                out.write(framed(row["url"], dt.datetime.now(dt.UTC), http + b"\r\n\r\n" + bytes(row["content"] or b"")))
                n += 1
        if not n:
            system.delete_file(path)
        return Written(name if n else None)

    def left(self) -> list[str]:
        """What attempts of this job have written and not moved."""
        system, folder = place(self.path)
        return [f.path for f in system.get_file_info(FileSelector(folder, allow_not_found=True)) if f.base_name.startswith(f"_tmp_{self.job}_")]

    def commit(self, messages: list) -> None:
        system, folder = place(self.path)
        old = [f.path for f in system.get_file_info(FileSelector(folder, allow_not_found=True)) if re.fullmatch(r"files_\w+\.warc\.gz", f.base_name)] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                system.move(f"{folder}/_tmp_{self.job}_{m.name}.warc.gz", f"{folder}/files_{m.name}.warc.gz")
        for path in old + self.left():
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        for path in self.left():
            place(self.path)[0].delete_file(path)


class Warc(DataSource):
    """``spark.read.format("warc").load(path)``: a file, a folder or a glob; option ``split``: bytes of a compressed file for a task. Writes
    response records of (url, http_header, content)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Warc)
    return spark


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives in any store that Spark reads; a file's bytes pass through one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        import io

        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                some = []
                for row in records_of(file, io.BytesIO(content).read):
                    some.append(row)
                    if len(some) == 256:
                        yield pd.DataFrame(some, columns=names)
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=names)

    return files.mapInPandas(run, SCHEMA)


def responses(archive: DataFrame) -> DataFrame:
    return archive.where("warc_type = 'response'")


def good(status: str = "http_status"):
    return F.col(status).between(200, 299)


def cdx(spark: SparkSession, path: str) -> DataFrame:
    """A CDX index from text lines: key, timestamp, url, type, status, digest, redirect, tags, size, offset, file."""
    c = F.split("value", " ")
    rows = spark.read.text(path).where("value NOT LIKE ' CDX%'").where(F.size(c) >= 11)
    text = {"url_key": 0, "timestamp": 1, "url": 2, "mime": 3, "file": 10}
    return rows.select(*(F.get(c, F.lit(i)).alias(n) for n, i in text.items()), F.get(c, F.lit(4)).try_cast("int").alias("http_status"), F.get(c, F.lit(9)).try_cast("long").alias("offset"), F.lit(0).cast("long").alias("within"))


def index_of(archive: DataFrame) -> DataFrame:
    """A CDX index of the records of an archive."""
    return responses(archive).select(urls.url_key(F.col("url")).alias("url_key"), F.date_format("crawl_date", "yyyyMMddHHmmss").alias("timestamp"), "url", "mime", "file", "http_status", "offset", "within")


def by_prefix(index: DataFrame, url: str) -> DataFrame:
    return index.where(F.startswith("url_key", urls.url_key(F.lit(url)))).where(good())


def by_url(index: DataFrame, url: str) -> DataFrame:
    return index.where(F.col("url_key") == urls.url_key(F.lit(url)))


def first_by_url(index: DataFrame, url: str) -> DataFrame:
    return by_url(index, url).where(good()).orderBy("timestamp", "file", "offset").limit(1)


def write_index(index: DataFrame, path: str) -> None:
    """An index as files sorted by url_key, each with a range of keys of its own: lookups read what may have the key and nothing else."""
    index.repartitionByRange("url_key", "timestamp").sortWithinPartitions("url_key", "timestamp").write.option("parquet.block.size", 8 << 20).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def first_captures(index: DataFrame, by: str = "url_key") -> DataFrame:
    """The first successful capture of each key (or of each url); captures of one are summed up where they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in index.columns))
    return index.where(good()).groupBy(by).agg(F.min_by(row, F.struct("timestamp", "file", "offset")).alias("r")).select("r.*")


def content_of(index: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Captures of an index with their content: each is read at its place, not by a scan of the archives. Null if nothing is there, or
    no such file, or no offset. In a store that only Spark can open, give the archive's records: they are joined by place."""
    if archive is not None:
        at = ["file", "offset", "within"]
        return index.join(archive.select(*at, "content"), at, "left").select(*index.columns, "content")

    def run(batches):
        for pdf in batches:
            order = pdf.sort_values(["file", "offset"]).reset_index(drop=True)
            content, last, source = [], None, None
            for file, offset, within in zip(order["file"], order["offset"], order["within"], strict=True):
                if not isinstance(file, str) or offset != offset or offset is None:
                    content.append(None)
                    continue
                if file != last:
                    if source is not None:
                        source.close()
                    last = file
                    system, at = place(file)
                    source = system.open_input_file(at) if system.get_file_info(at).type == FileType.File else None
                found = None
                if source is not None and 0 <= offset < source.size():
                    source.seek(int(offset))
                    found = record_at(file, source.read, int(offset), 0 if within != within or within is None else int(within))
                content.append(found[-1] if found is not None else None)
            if source is not None:
                source.close()
            yield order.assign(content=content)

    return index.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields) + ", content binary")


def load_page(index: DataFrame, url: str) -> str | None:
    """The text of the first successful capture of a url, None without one: one row of the index, one read of an archive."""
    row = content_of(first_by_url(index, url)).select(F.col("content").cast("string")).first()
    return row[0] if row else None
