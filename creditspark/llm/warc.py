"""WARC archives as seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames: whole records, grouped up to about ``FRAME`` bytes each. A
skippable frame then maps record identifiers to (frame, offset inside the frame, length), and a seek table in a last
skippable frame lists the sizes and checksums of all frames. Any Zstandard reader can unpack a bundle from front to
back; a reader of the seek table unpacks only the frames that hold the records wanted.

Bundles are rows of a frame and are written by Spark's own text sink, one row a file, so that commits, retries and
remote stores work as for any other output. The sink ends a row with a line separator; here that is the magic number
that ends a seek table.

Of rows with equal payloads of at least ``minimum`` bytes, the one with the smallest id is a response and the others
are revisits of it, without payload. Null bodies count as empty. Null ids come last; rows that repeat an id are told
apart by their place, and one of them is the response. A null address has no target line, control characters and blanks
in an address are percent-encoded. Other columns of the table are not read, so their names cannot clash. An empty
table gives an archive without records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm.rows import stored
from creditspark.operators.joins import lookup_join
from creditspark.session import materialize

FRAME = 256 * 1024
BUNDLE = 32 * 1024 * 1024
LEVEL = 3

# Fixed values of the Zstandard format and its seekable extension.
MAP_MAGIC = 0x184D2A5D
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
SKIPPABLE = struct.Struct("<II")

# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, type string, headers map<string,string>, http map<string,string>, payload binary"
INDEX = "record_id string, path string, frame int, offset long, length long"


# ---- records -------------------------------------------------------------------------------

def _address(url: Column) -> Column:
    """An address that fits on a header line."""
    codes = [*range(33), 127]
    encoded = reduce(lambda text, c: F.replace(text, F.lit(chr(c)), F.lit(f"%{c:02X}")), codes, url)
    return F.when(url.rlike("[\\x00-\\x20\\x7f]"), encoded).otherwise(url)


def _urn(key: Column, row: Column) -> Column:
    """A record identifier from the id of a row and its place."""
    digits = F.sha2(F.concat_ws(":", key, row.cast("string")), 256)
    cuts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _lines(*lines: Column) -> Column:
    """Header lines, those that are null left out, ended by an empty line, in UTF-8."""
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "utf-8")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def archive_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", minimum: int = 100,
                    captured: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record_id, record): one WARC record per row of ``pages``.

    Rows are stored with their digests first, so that a row keeps its place and identifier if a task is repeated. Only
    digests are grouped; the payloads that repeat are few and their list is broadcast if measured to be small, so
    bodies are not shuffled then.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "utf-8")
    rows = stored(pages.select(
        F.col(key).alias("id"), _address(F.col(url)).alias("url"), payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "warc-rows")
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    whole = rows.filter(F.col("bytes") >= minimum).groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("first"), F.count("*").alias("n"))
    repeated = materialize(whole.filter("n > 1").select("digest", "first"))
    rows = lookup_join(rows, repeated, "digest")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row")) & (F.col("bytes") >= minimum)

    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _line("Content-Length", F.col("bytes")))
    body_kept = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    head = _lines(
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.col("record_id")), F.lit(f"WARC-Date: {captured}"), _line("WARC-Target-URI", F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.col("first.id").cast("string"), F.col("first.row")))),
        F.when(revisit, _line("Refers-To-Source-ID", F.col("first.id"))), _line("Source-ID", F.col("id")),
        F.lit("Content-Type: application/http; msgtype=response"),
        _line("Content-Length", F.octet_length("http") + F.octet_length("kept")))
    return (rows.withColumn("record_id", _urn(F.col("id").cast("string"), F.col("row")))
            .withColumn("http", http).withColumn("kept", body_kept)
            .select("record_id", F.concat(head, F.col("http"), F.col("kept"), F.lit(b"\r\n\r\n")).alias("record")))


# ---- bundles -------------------------------------------------------------------------------

class Bundle:
    """Frames of one file while it grows."""

    def __init__(self, frame: int):
        self.limit, self.packer = frame, zstandard.ZstdCompressor(level=LEVEL)
        self.done, self.table, self.places, self.size = [], [], [], 0
        self.open, self.filled = [], 0

    def add(self, record_id: str, record: bytes) -> None:
        self.places.append(f"{record_id}\t{len(self.table)}\t{self.filled}\t{len(record)}\n")
        self.open.append(record)
        self.filled += len(record)
        if self.filled >= self.limit:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            whole = b"".join(self.open)
            self._append(self.packer.compress(whole), whole)
            self.open, self.filled = [], 0

    def _append(self, frame: bytes, whole: bytes) -> None:
        self.done.append(frame)
        self.size += len(frame)
        self.table.append(ENTRY.pack(len(frame), len(whole), xxhash.xxh64(whole).intdigest() & 0xFFFFFFFF))

    def content(self) -> bytes:
        """The whole file but for its last four bytes, the magic number that the sink writes."""
        self.end_frame()
        places = self.packer.compress("".join(self.places).encode())
        self._append(SKIPPABLE.pack(MAP_MAGIC, len(places)) + places, b"")
        size = len(self.table) * ENTRY.size + FOOTER.size
        tail = FOOTER.pack(len(self.table), CHECKSUMS, FOOTER_MAGIC)
        return b"".join([*self.done, SKIPPABLE.pack(TABLE_MAGIC, size), *self.table, tail[:-4]])


def bundles(records: DataFrame, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """(content): records (``record_id``, ``record``) in bundles that end once they exceed ``bundle`` bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            ids, found = batch.column("record_id"), batch.column("record")
            for at in range(batch.num_rows):
                now = now or Bundle(frame)
                now.add(ids[at].as_py(), found[at].as_py())
                if now.size >= bundle:
                    yield pa.RecordBatch.from_arrays([pa.array([now.content()], pa.binary())], ["content"])
                    now = None
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now.content()], pa.binary())], ["content"])

    return records.mapInArrow(pack, "content binary")


def write_bundles(made: DataFrame, folder: str) -> None:
    """One file per row of ``made`` in ``folder``."""
    magic = struct.pack("<I", FOOTER_MAGIC).decode("latin-1")
    (made.select(F.col("content").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", magic).option("maxRecordsPerFile", 1).text(folder))


# ---- reading -------------------------------------------------------------------------------

def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(start in the file, packed size, unpacked size, checksum) of every frame a bundle's seek table lists."""
    count, kind, magic = FOOTER.unpack_from(content, len(content) - FOOTER.size)
    if magic != FOOTER_MAGIC or kind != CHECKSUMS:
        raise ValueError("no seek table at the end of the bundle")
    first = len(content) - FOOTER.size - count * ENTRY.size
    out, start = [], 0
    for packed, unpacked, checksum in ENTRY.iter_unpack(content[first:first + count * ENTRY.size]):
        out.append((start, packed, unpacked, checksum))
        start += packed
    return out


def unpack_frame(content: bytes, place: tuple[int, int, int, int]) -> bytes:
    """One frame, checked against the table."""
    start, packed, unpacked, checksum = place
    whole = zstandard.ZstdDecompressor().decompress(content[start:start + packed], max_output_size=unpacked)
    if len(whole) != unpacked or xxhash.xxh64(whole).intdigest() & 0xFFFFFFFF != checksum:
        raise ValueError("a frame differs from the seek table")
    return whole


def _fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, by name."""
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(whole: bytes, offset: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Headers, HTTP headers, payload and end of the record that begins at ``offset``."""
    stop = whole.index(b"\r\n\r\n", offset)
    if not whole.startswith(VERSION.encode(), offset):
        raise ValueError("no record begins here")
    headers = _fields(whole[offset:stop])
    end = stop + 4 + int(headers["Content-Length"])
    split = whole.index(b"\r\n\r\n", stop + 4, end)
    if whole[end:end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, _fields(whole[stop + 4:split]), whole[split + 4:end], end + 4


def _batch(found: list[tuple]) -> pa.RecordBatch:
    headers = [f[0] for f in found]
    maps = pa.map_(pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array([h["WARC-Record-ID"] for h in headers], pa.string()), pa.array([h["WARC-Type"] for h in headers], pa.string()),
        pa.array([list(h.items()) for h in headers], maps), pa.array([list(f[1].items()) for f in found], maps),
        pa.array([f[2] for f in found], pa.binary())], ["record_id", "type", "headers", "http", "payload"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "content")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: ``record_id``, ``type``, ``headers``, ``http`` headers and ``payload``, one frame at a time."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                content = batch.column("content")[at].as_py()
                for place in seek_table(content):
                    if place[2]:
                        whole, offset, found = unpack_frame(content, place), 0, []
                        while offset < len(whole):
                            *record, offset = parse_record(whole, offset)
                            found.append(record)
                        yield _batch(found)

    return _files(spark, folder).mapInArrow(unpack, RECORD)


def record_map(content: bytes) -> list[list[str]]:
    """Identifier, frame, offset and length of every record, from the frame before the seek table."""
    start, packed, _, _ = seek_table(content)[-1]
    text = zstandard.ZstdDecompressor().decompressobj().decompress(content[start + SKIPPABLE.size:start + packed])
    return [line.split("\t") for line in text.decode().splitlines()]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where every record lies: ``record_id``, ``path``, ``frame``, ``offset`` in the frame, ``length``. Unpacks no record."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, frames, offsets, lengths = zip(*record_map(batch.column("content")[at].as_py()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array([batch.column("path")[at].as_py()] * len(ids)),
                    pa.array(map(int, frames), pa.int32()), pa.array(map(int, offsets), pa.int64()),
                    pa.array(map(int, lengths), pa.int64())], ["record_id", "path", "frame", "offset", "length"])

    return _files(spark, folder).mapInArrow(places, INDEX)


def read_records(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """The records at ``places`` (rows of :func:`read_index`); only files and frames that hold one are unpacked.

    The places wanted in one file are gathered in a list, which a bundle's size bounds.
    """
    wanted = places.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("frame", "offset"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                content = batch.column("content")[at].as_py()
                table, open_frame, whole = seek_table(content), -1, b""
                for place in batch.column("wanted")[at].as_py():
                    if place["frame"] != open_frame:
                        open_frame, whole = place["frame"], unpack_frame(content, table[place["frame"]])
                    yield _batch([parse_record(whole, place["offset"])[:3]])

    return _files(spark, folder).join(wanted, "path").mapInArrow(fetch, RECORD)


def write_archive(pages: DataFrame, folder: str, frame: int = FRAME, bundle: int = BUNDLE, **columns) -> None:
    """Archive the rows of ``pages`` in ``folder``; ``columns`` as for :func:`archive_records`."""
    write_bundles(bundles(archive_records(pages, **columns), frame, bundle), folder)


def digests(records: DataFrame, key: str = "page_id") -> DataFrame:
    """What the archive says of each row: payload size and digest, record type, and the row a revisit refers to.

    A response is measured by its payload; a revisit has none, so its own headers tell.
    """
    response = F.col("type") == "response"
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return records.select(
        header("Source-ID").cast("long").alias(key),
        F.when(response, F.octet_length("payload").cast("long"))
        .otherwise(F.try_element_at("http", F.lit("Content-Length")).cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256))
        .otherwise(F.replace(header("WARC-Payload-Digest"), F.lit("sha256:"), F.lit(""))).alias("payload_digest"),
        F.col("type").alias("record_type"), header("Refers-To-Source-ID").cast("long").alias("refers_to"))
