"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Every record is a gzip member of its own. The reader checks each record; where a check fails it goes
on at the next gzip member or version line that holds a valid record, and reports the bytes between
as a gap. Archives are written and read through Hadoop-style file addresses (``pyarrow.fs``), one
archive at a time per task, record by record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches, pick

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20  # payload bytes after which a task begins another archive
READ_BYTES = 1 << 20
FED_BYTES = 16 << 10
MAX_LONG = (1 << 63) - 1

# Signs and fields of the WARC 1.1 and gzip formats.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
SIGN = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records


def header_value(value: str) -> str:
    """A field value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record, as a gzip member."""
    lines = [VERSION, *(f"{k}: {header_value(v)}".encode() for k, v in fields), b"Content-Length: %d" % len(payload)]
    maker = zlib.compressobj(6, zlib.DEFLATED, 31)
    return maker.compress(b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n") + maker.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    fields.append(("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
        return record_bytes(fields, b"")
    return record_bytes([*fields, ("Content-Type", "text/html; charset=utf-8")], payload)


class Damaged(Exception):
    """What stands here is no whole, valid record."""


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Fields (lower-case names), block, and length of the record that begins ``raw``."""
    if not VERSION_LINE.match(raw):
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header does not end")
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields:
        raise Damaged("no length or type")
    stop = end + 4 + int(length)
    block = raw[end + 4 : stop]
    if len(block) < int(length):
        raise Damaged("block is cut off")
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record end is missing")
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:]:
        raise Damaged("payload digest differs")
    return fields, block, stop + 4


class Window:
    """A seekable stream seen through a buffer; ``pos`` is the place in it, ``at`` that in the stream."""

    def __init__(self, stream) -> None:
        self.stream, self.base, self.pos, self.data, self.ended = stream, 0, 0, b"", False

    @property
    def at(self) -> int:
        return self.base + self.pos

    @property
    def left(self) -> int:
        return len(self.data) - self.pos

    def fill(self, wanted: int) -> bool:
        """Read until ``wanted`` bytes are left, in one copy; whether anything came."""
        parts, size = [], self.left
        while size < wanted and not self.ended:
            block = self.stream.read(READ_BYTES)
            self.ended = not block
            if block:
                parts.append(block)
                size += len(block)
        if parts:
            self.base, self.data, self.pos = self.at, b"".join([self.data[self.pos :], *parts]), 0
        return bool(parts)

    def more(self) -> bool:
        """Read on, at least as much as is left, so that a long record is copied a few times only."""
        return self.fill(max(2 * self.left, self.left + READ_BYTES))

    def peek(self, ahead: int, size: int) -> bytes:
        """Bytes that far ahead, without those between."""
        if ahead + size <= self.left or self.ended:
            return self.data[self.pos + ahead : self.pos + ahead + size]
        here = self.stream.tell()
        self.stream.seek(self.at + ahead)
        found = self.stream.read(size)
        self.stream.seek(here)
        return found


def member_at(window: Window) -> tuple[bytes, int]:
    """Content and compressed length of the gzip member at the window's place."""
    maker, parts, used, size = zlib.decompressobj(31), [], 0, 0
    try:
        while not maker.eof:
            block = window.data[window.pos + used : window.pos + used + FED_BYTES]
            if not block:
                if not window.more():
                    raise Damaged("member is cut off")
                continue
            parts.append(maker.decompress(block))
            used += len(block) - len(maker.unused_data)
            if size < 10 <= (size := size + len(parts[-1])) and not VERSION_LINE.match(b"".join(parts)[:10]):
                raise Damaged("member holds no record")
    except zlib.error as error:
        raise Damaged(f"member is damaged: {error}") from None
    return b"".join(parts), used


def header_length(window: Window) -> int:
    """Length of the header at the window's place, however long it is, up to its empty line."""
    at = 0
    while True:
        stop = window.data.find(b"\r\n", window.pos + at) - window.pos
        if stop < 0:
            if not window.more():
                raise Damaged("header does not end")
        elif stop == at:
            return at - 2
        elif at and window.data.find(b":", window.pos + at, window.pos + stop) < 0:
            raise Damaged("header line without a colon")
        else:
            at = stop + 2


def plain_at(window: Window) -> tuple[tuple[dict, bytes], int]:
    """A record that is not compressed; its end is looked at first, so that a wrong length has nothing read."""
    window.fill(10)
    if not VERSION_LINE.match(window.data, window.pos):
        raise Damaged("no version line")
    size = header_length(window)  # may read on, which moves the buffer
    head = window.data[window.pos : window.pos + size]
    found = re.search(rb"(?i)\r\ncontent-length[ \t]*:[ \t]*(\d{1,15})[ \t]*(?:\r\n|$)", head)
    need = len(head) + 8 + (int(found[1]) if found else 0)
    if window.peek(need - 4, 4) != b"\r\n\r\n":
        raise Damaged("record end is missing")
    window.fill(need)
    fields, block, length = parse_record(window.data[window.pos : window.pos + need])
    return (fields, block), length


def salvage(stream) -> Iterator[tuple]:
    """``("record", start, end, fields, block)`` and ``("gap", start, end, reason, None)`` in the order of a seekable archive."""
    window, gap = Window(stream), None
    while window.left or window.more():
        window.fill(len(MAGIC))
        try:
            if window.data.startswith(MAGIC, window.pos):
                content, used = member_at(window)
                fields, block, length = parse_record(content)
                if length != len(content):
                    raise Damaged("member holds more than a record")
            else:
                (fields, block), used = plain_at(window)
        except Damaged as reason:
            gap = gap or (window.at, str(reason))
            next_place(window)
            continue
        if gap:
            yield "gap", gap[0], window.at, gap[1], None
            gap = None
        yield "record", window.at, window.at + used, fields, block
        window.pos += used
    if gap:
        yield "gap", gap[0], window.at, gap[1], None


def next_place(window: Window) -> None:
    """Go on to the next place that looks like a gzip member or a version line, or to the end."""
    window.pos += 1
    while True:
        found = SIGN.search(window.data, window.pos)
        if found:
            window.pos = found.start()
            return
        window.pos = max(window.pos, len(window.data) - 6)  # a sign may be cut by the buffer's end
        if not window.more():
            window.pos = len(window.data)
            return


# ---- jobs


def arrow_address(uri: str) -> str:
    """A Hadoop-style address under the name that Arrow knows: Hadoop's ``s3a:`` and ``s3n:`` are its ``s3:``."""
    return re.sub(r"^s3[an]:", "s3:", uri)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = arrow_address(uri)
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:/", uri) else f"file://{uri}")


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: of equal payloads of ``min_bytes`` or more the largest id stays.

    Null payloads are empty. Rows that repeat the largest id with the same payload all stay responses; a null id
    refers to the largest one, and where all ids are null none is a revisit. Only (digest, id) is grouped; the
    pages meet the few digests that occur twice in a join that Spark can split where one payload is frequent.
    An empty table gives no rows.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= min_bytes)
    twice = long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(twice.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("of", "last")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, digest, refers_to`` to ``folder``; ``path, records, bytes`` of each archive.

    A task writes under a name of its own attempt and renames whole archives, so a repeated task replaces its archives.
    Collect or store the result: it is lazy. An archive takes records up to ``archive_bytes`` of payload and one more.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        number, stream, name, records, size, payloads = 0, None, "", 0, 0, 0

        def close() -> None:
            nonlocal stream, number
            stream.close()
            system.move(name, f"{base}/pages-{context.partitionId():06d}-{number:04d}.warc.gz")
            done.append((f"{folder.rstrip('/')}/pages-{context.partitionId():06d}-{number:04d}.warc.gz", records, size))
            stream, number = None, number + 1

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                if stream is None:
                    name, records, size, payloads = f"{base}/_writing-{context.taskAttemptId()}-{number:04d}", 0, 0, 0
                    stream = system.open_output_stream(name, compression=None)
                data = page_record(page_id, url, payload, digest, refers_to)
                stream.write(data)
                records, size, payloads = records + 1, size + len(data), payloads + len(payload)
                if payloads >= archive_bytes:
                    close()
        if stream is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    ordered = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return map_batches(ordered, work, "path string, records bigint, bytes bigint")


READ_TYPES = (
    "path string, start bigint, stop bigint, gap string, record_type string, page_id bigint, url string, "
    "payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record or gap of the archives in column ``path``.

    ``gap`` is null for records, and the reason for byte ranges that are set aside. ``payload_bytes`` and
    ``payload_digest`` are those of the full payload, for revisits too. Fields that a record lacks are null; numbers
    are any of 64 bits. A header has no greatest length: it is held in memory as the payload is.
    An archive is read by one task, record by record; ``path`` rows are dealt out over all tasks.
    Without paths there are no rows; an archive without a byte has none.
    """
    names = [x.split()[0] for x in READ_TYPES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def number(value: str | None) -> int | None:
        if not value or not re.fullmatch(r"-?0*[0-9]{1,19}", value) or len(value) > 1000:
            return None
        return found if -MAX_LONG - 1 <= (found := int(value)) <= MAX_LONG else None

    def row(path: str, found: tuple) -> tuple:
        kind, start, stop, fields, block = found
        if kind == "gap":
            return (path, start, stop, fields, None, None, None, None, None, None, None)
        type_, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
        size = number(fields.get("x-payload-length")) if type_ == "revisit" else len(block)
        return (
            path, start, stop, None, type_, number(fields.get("x-page-id")), fields.get("warc-target-uri"),
            digest.removeprefix("sha1:") or None, size, number(fields.get("x-refers-to-page-id")), block if with_payload and type_ != "revisit" else None,
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                rows, size = [], 0
                with system.open_input_file(name) as stream:
                    for found in salvage(stream):
                        rows.append(row(path, found))
                        size += len(found[4] or b"")
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    paths = archives.select("path").where("path is not null")
    return map_batches(paths, work, READ_TYPES)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the archives in a folder, one per task."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    return found
