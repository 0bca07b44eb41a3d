"""WARC records in seekable Zstandard bundles.

write_bundles() groups records into independent Zstandard frames and frames into bundle files; each file ends with the
seek table of the public seekable format (a skippable frame with the sizes of all frames).  read_bundles() reads files back;
index_bundles() maps record identifiers to (file, frame, frame offset, offset in the decompressed frame, length), and
read_record() opens one frame only; lookup() reads frames by range.  Files are written by Spark's own writer, so any file system that Spark knows will do.

Of records with equal payloads of at least `revisit_bytes` bytes the one with the largest identifier is a response and the others are
revisits of it.  Null html: an empty payload.  Null url: no target.  Rows that repeat the largest identifier are all
responses; a null identifier is never referred to while the group has another one.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.folder import opened

from .shared import scratch_dir, table

#: Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and of frames in a file; a file is held in memory while it is written or read.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, frame int, frame_offset long, offset long, length long"


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def record(page_id, url: str | None, html: bytes, n_bytes: int, sha1: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload, its digest and size are those of the full one."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else html)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"WARC-Payload-Length: {n_bytes}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def bundle(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames and their seek table."""
    table_ = b"".join(struct.pack("<II", len(c), n) for c, n in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(c for c, _ in frames) + struct.pack("<II", SKIPPABLE, len(table_)) + table_


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    out, at = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", data, len(data) - 9 - width * (n - k))
        out.append((at, packed, size))
        at += packed
    return out


def parsed(frame: bytes, at: int) -> tuple[dict[str, str], int, int, int]:
    """(headers, start of the block, its end, end of the record) of the record at an offset."""
    head = frame.index(b"\r\n\r\n", at)
    headers = dict(x.split(": ", 1) for x in frame[at:head].decode().split("\r\n")[1:])
    start = head + 4
    end = start + int(headers["Content-Length"])
    return headers, start, end, end + 4


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record of a bundle; only its frame is decompressed."""
    at, packed, size = seek_table(data)[frame]
    raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)
    headers, start, end, _ = parsed(raw, offset)
    return headers, raw[start:end].partition(b"\r\n\r\n")[2]


def _write(batches: Iterator[pa.RecordBatch], bundle_bytes: int = BUNDLE_BYTES) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)
    frames, raw, held = [], bytearray(), 0

    def close() -> None:
        nonlocal raw, held
        if raw:
            frames.append((press.compress(bytes(raw)), len(raw)))
            held += len(frames[-1][0])
            raw = bytearray()

    def out() -> pa.RecordBatch:
        # The writer ends each row with the last byte of the seek table.
        nonlocal frames, held
        data, frames, held = bundle(frames), [], 0
        return pa.RecordBatch.from_pydict({"data": pa.array([data[:-1]], pa.binary())})

    for b in batches:
        for page, url, html, n, sha1, to in zip(*(x.to_pylist() for x in b.columns), strict=True):
            raw += record(page, url, (html or "").encode("utf-8", "replace"), n, sha1, to)
            if len(raw) >= FRAME_BYTES:
                close()
            if held >= bundle_bytes:
                yield out()
    close()
    if frames:
        yield out()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for b in batches:
        for file, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
            rows = []
            for k, (at, packed, size) in enumerate(seek_table(data)):
                raw, offset = unpress.decompress(data[at : at + packed], max_output_size=size), 0
                while offset < len(raw):
                    h, _, _, end = parsed(raw, offset)
                    url = h.get("WARC-Target-URI")
                    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    to = _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    rows.append((_page(h["WARC-Record-ID"]), url, int(h["WARC-Payload-Length"]), digest, h["WARC-Type"], to, file, k, at, offset, end - offset))
                    offset = end
            named = [x.split() for x in READ_SCHEMA.split(", ")]
            made = [pa.array(x, TYPES[t]) for x, (_, t) in zip(zip(*rows, strict=True), named, strict=True)] if rows else [pa.array([], TYPES[t]) for _, t in named]
            yield pa.RecordBatch.from_arrays(made, names=[x for x, _ in named])


def write_bundles(pages: DataFrame, path: str, revisit_bytes: int = 1000, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html) to bundle files under path."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("n"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    # Short payloads get keys of their own, so that they spread instead of meeting in one task.
    own = own.withColumn("key", F.when(F.col("n") >= revisit_bytes, F.col("sha1")).otherwise(F.concat_ws("-", F.lit("short"), "page_id", "sha1")))
    first = own.where(F.col("n") >= revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("c")).where("c > 1").selectExpr("concat(sha1, '') as of", "largest")
    joined = own.join(first, own.key == first.of, "left").withColumn("to", F.expr("if(largest is null or page_id <=> largest, null, largest)"))
    rows = joined.select("page_id", "url", "html", "n", "sha1", "to").mapInArrow(lambda batches: _write(batches, bundle_bytes), "data binary")
    rows.select(F.col("data").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", "\x8f").option("maxRecordsPerFile", 1).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the bundles under path, with its place."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, READ_SCHEMA)


def index_bundles(spark: SparkSession, path: str) -> DataFrame:
    """page_id -> file, frame, frame_offset, offset, length, and the page_id that a revisit refers to."""
    return read_bundles(spark, path).select("page_id", "file", "frame", "frame_offset", "offset", "length", "refers_to")


def read_frame(file: pa.NativeFile, size: int, frame: int) -> bytes:
    """One decompressed frame of an open bundle of `size` bytes; what is read is the end of the seek table, one of its entries or all up to it where
    the frame's place is not known, and the frame."""
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    if not 0 <= frame < n:
        raise IndexError(f"frame {frame} of {n}")
    width = 12 if flags & 0x80 else 8
    entries = file.read_at(width * (frame + 1), size - 9 - width * n)
    at = sum(struct.unpack_from("<I", entries, width * k)[0] for k in range(frame))
    packed, raw = struct.unpack_from("<II", entries, width * frame)
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=raw)


def lookup(spark: SparkSession, path: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, html) of the wanted page_ids, read by range: of a bundle the seek table and the frames in question, never the file.

    The payload of a revisit is that of the response it refers to.  Repeated wanted ids count once, unknown and null ones give nothing; rows that
    share an id are all given.  Frames are dealt to the tasks one by one, so a bundle that many ids lie in is read by many.
    `path` is the folder that `index` was made of; the index names its files.
    """

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, frame, at in zip(b["file"], b["frame"], b["at"], strict=True):
                fs, where = opened(name)
                with fs.open_input_file(where) as file:
                    raw = read_frame(file, file.size(), int(frame))
                rows = []
                for offset in at:
                    _, start, end, _ = parsed(raw, offset)
                    rows.append((name, frame, offset, raw[start:end].partition(b"\r\n\r\n")[2].decode()))
                yield pd.DataFrame(rows, columns=["file", "frame", "offset", "html"])

    asked = index.join(wanted.select("page_id").distinct(), "page_id")
    own = asked.where("refers_to is null").select("page_id", "file", "frame", "offset")
    again = asked.where("refers_to is not null").selectExpr("page_id", "refers_to as source")
    # Rows that repeat the largest id hold one payload each; a revisit takes the first of them.
    held = index.where("refers_to is null").join(again.select(F.col("source").alias("page_id")).distinct(), "page_id", "left_semi")
    held = held.groupBy(F.col("page_id").alias("source")).agg(F.min(F.struct("file", "frame", "offset")).alias("place"))
    own = own.unionByName(again.join(held, "source").select("page_id", "place.*"))
    # A payload is read once, however many ask for it; a frame's list is bounded by its records.
    frames = own.groupBy("file", "frame").agg(F.collect_set("offset").alias("at"))
    return own.join(frames.mapInPandas(get, "file string, frame int, offset long, html string"), ["file", "frame", "offset"]).select("page_id", "html")


def op8_warc_bundles(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_bundles(table(spark, sf_dir, "pages"), path)
    return read_bundles(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
m as (select d, max(page_id) as largest from p where n >= 1000 group by d having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when largest is not null and page_id is distinct from largest then 'revisit' else 'response' end as record_type,
       case when largest is not null and page_id is distinct from largest then largest end as refers_to
from (select p.*, case when n >= 1000 then m.largest end as largest from p left join m using (d))
"""
