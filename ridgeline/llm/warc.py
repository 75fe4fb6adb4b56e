"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed on their own; a bundle ends with a seek table (in a skippable
frame) that gives each frame's compressed and plain size, so one record is read with one seek. A catalog table maps
record ids to (bundle, frame, offset in the frame). Equal payloads of at least 100 bytes are stored once: the smallest
page_id is the response, the others are revisits that refer to it.

Pages move through one shuffle: the left side of the join with the owners of repeated payloads, which Spark may
split where a payload is hot. Each task streams its rows into bundles of a bounded size, named by task attempt: the
catalog that is committed names the bundles of the attempt that was, and those of lost attempts are never read.
Bundles have about the same size and are read back one to a task: the rows of the catalog in the order of their
places, so each frame is sought and unpacked once and each record cut at its offset.

A record's id names its page, its task and its number there, so a repeated row has records of different ids. A revisit
says what it refers to by the target and the date of the response, and by its page in a field of our own.

Defined results: a null html is an empty payload; a null page_id never owns a payload that has another id; a
repeated row writes its record again, of the same type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Plain bytes after which a task starts its next bundle.
BUNDLE_BYTES = 64 << 20
#: Plain bytes after which a frame ends.
FRAME_BYTES = 256 << 10
#: Magic numbers of the Zstandard seekable format: the skippable frame that holds the table, and the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

CATALOG = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def filesystem(folder: str):
    """(filesystem, path) of a folder's URI, so bundles can go wherever the shared folder is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def target_of(page_id: int | None, url: str | None) -> str:
    """A page's target: its url without white space, or a name made of its id."""
    return "".join((url or "").split()) or f"urn:page:{'' if page_id is None else page_id}"


def record(record_id: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, owner: tuple[int, str | None] | None) -> bytes:
    """One WARC/1.1 record; owner is the page (and its url) that a revisit refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if owner is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_of(page_id, url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Bytes: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if owner is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {target_of(*owner)}",
            f"WARC-Refers-To-Date: {date}",
            f"Refers-To-Page-Id: {owner[0]}",
        ]
    body = payload if owner is None else b""
    return "\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[tuple[int | None, int, str, str, int | None], int]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the record at an offset, and where the next one starts. A response's payload is digested anew."""
    end = plain.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in plain[at:end].decode().split("\r\n")[1:])
    number = lambda name: int(fields[name]) if name in fields else None
    page, kind, length = number("Page-Id"), fields["WARC-Type"], int(fields["Content-Length"])
    after = end + 4 + length + 4
    if kind == "revisit":
        return (page, int(fields["Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, number("Refers-To-Page-Id")), after
    digest = hashlib.sha256(memoryview(plain)[end + 4 : end + 4 + length]).hexdigest()
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of record {page} differs from its digest")
    return (page, length, digest, kind, None), after


class Bundle:
    """Writes one seekable bundle: records into frames, then the seek table."""

    def __init__(self, folder: str, name: str):
        import zstandard

        files, base = filesystem(folder)
        self.uri = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{base}/{name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.in_frame = self.plain = 0

    def add(self, plain: bytes) -> tuple[int, int]:
        """(frame, offset in the frame)"""
        found = len(self.frames), self.in_frame
        self.held.append(plain)
        self.in_frame += len(plain)
        self.plain += len(plain)
        if self.in_frame >= FRAME_BYTES:
            self.end_frame()
        return found

    def end_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.in_frame))
            self.held, self.in_frame = [], 0

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer."""
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("this bundle has no seek table")
    source.seek(size - 9 - 8 * count)
    table, at = [], 0
    for packed, plain in struct.iter_unpack("<II", source.read(8 * count)):
        table.append((at, packed, plain))
        at += packed
    return table


class Reader:
    """One bundle, open: its frames by number."""

    def __init__(self, bundle: str):
        import zstandard

        folder, _, name = bundle.rpartition("/")
        files, base = filesystem(folder)
        self.source = files.open_input_file(f"{base}/{name}")
        self.table, self.unpacker = seek_table(self.source, self.source.size()), zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.table[number]
        self.source.seek(at)
        return self.unpacker.decompress(self.source.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.source.close()


def write_bundles(folder: str, date: str):
    """A function for mapInArrow: page_id, url, payload, digest, owner, owner_url -> rows of the catalog."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()

        def rows():
            bundle, bundles, number = None, 0, 0
            for part in parts:
                for page_id, url, payload, digest, owner, owner_url in zip(*(part.column(i) for i in range(6))):
                    if bundle is None:
                        bundle, bundles = Bundle(folder, f"bundle-{task:06d}-{bundles:04d}-{attempt}.warc.zst"), bundles + 1
                    page, owner = page_id.as_py(), owner.as_py()
                    name = f"urn:page:{'' if page is None else page}:{task}-{number}"
                    plain = record(name, date, page, url.as_py(), payload.as_py(), digest.as_py().hex(), None if owner is None else (owner, owner_url.as_py()))
                    yield page, name, bundle.uri, *bundle.add(plain), len(plain)
                    number += 1
                    if bundle.plain >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
            if bundle is not None:
                bundle.close()

        yield from common.batches(rows(), CATALOG)

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a record under folder, dated with the time of this call; the catalog: page_id, record_id, bundle, frame, frame_offset, record_bytes."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"),
        common.text_bytes("html").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    page = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    owners = found.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min(page).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    another = ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    dealt = found.join(owners, "digest", "left").select("page_id", "url", "payload", "digest", F.when(another, F.col("owner.page_id")).alias("owner"), F.when(another, F.col("owner.url")).alias("owner_url"))
    return common.written(common.arrow_map(dealt, write_bundles(folder, date), "page_id long, record_id string, bundle string, frame int, frame_offset long, record_bytes long"), "warc-catalog")


def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows of the catalog in the order of bundle, frame and offset: each record, found where the catalog says. A bundle is opened once, a frame unpacked once."""

    def rows():
        bundle, frame, plain, source = None, None, b"", None
        for part in parts:
            for page_id, record_id, name, number, at, size in zip(*(part.column(c).to_pylist() for c in range(6))):
                if name != bundle:
                    if source:
                        source.close()
                    bundle, frame, source = name, None, Reader(name)
                if number != frame:
                    frame, plain = number, source.frame(number)
                found, after = parse(plain, at)
                if after != at + size or found[0] != page_id or plain[at : plain.index(b"\r\n\r\n", at)].find(f"<{record_id}>".encode()) < 0:
                    raise ValueError(f"{record_id} isn't where the catalog has it")
                yield found
        if source:
            source.close()

    yield from common.batches(rows(), RECORDS)


def read_archives(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """The records of a catalog, each read from its place: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit whose response isn't there with the same size and digest is an error."""
    bundles = max(1, catalog.select("bundle").distinct().count())
    places = catalog.select(*CATALOG.names).repartitionByRange(bundles, F.xxhash64("bundle")).sortWithinPartitions("bundle", "frame", "frame_offset")  # a given number, which adaptive execution leaves alone: about one bundle to a task; ranges of a hash, as Spark samples what it ranges by at the driver
    found = common.written(common.arrow_map(places, cut, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-records")
    known = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("known_bytes"))
    fault = F.raise_error(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")), F.lit(" revisits what isn't there")))
    revisits = found.where("record_type = 'revisit'").join(known, ["refers_to", "payload_digest"], "left")
    right = F.col("known_bytes").eqNullSafe(F.col("payload_bytes"))
    checked = revisits.select("page_id", F.when(right, F.col("payload_bytes")).otherwise(fault).cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return found.where("record_type = 'response'").unionByName(checked)


def lookup(catalog: DataFrame, page_id: int) -> bytes:
    """One record's plain bytes: one row of the catalog and one seek."""
    row = catalog.where(F.col("page_id") == page_id).select("bundle", "frame", "frame_offset", "record_bytes").first()
    bundle = Reader(row.bundle)
    plain = bundle.frame(row.frame)
    bundle.close()
    return plain[row.frame_offset : row.frame_offset + row.record_bytes]


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = common.new_folder(spark, "warc")
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    return read_archives(spark, write_archives(pages, folder))
