"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames of about a megabyte of whole records, closed by the seek table of the
public seekable format: a skippable frame with the compressed and the plain size of every frame. Any Zstandard reader can
read a bundle from the front; with the table a reader can open one frame alone. Bundles are written by the tasks that
hold the pages; the index that comes back names for every record its bundle, frame, and place in the frame. They are
written below ``_attempts`` and moved up once the index is complete, so what failed attempts left is no part of the archive.

The folder is opened with Arrow's file systems: local, HDFS, S3 (also as ``s3a``) and Google Storage. Any other scheme is an
error before anything is written; a folder without a scheme is that of Spark's default file system.

Of records with equal payloads the one with the smallest id holds the payload, the others are revisits that refer to it.

Defined cases: null html is an empty payload; a null url is an empty target; a page without an id is written with an empty
id and is a revisit if a page with an id has its payload, else a response; pages that repeat the smallest id of a payload
are all responses; a very long url is a header line of its length; columns other than the named ones are ignored, whatever they are called; no pages give no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto.llm.common import materialise, new_path, qualified

#: Plain bytes of a frame and of a bundle, about; a longer record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Plain bytes of the records that one task reads back.
READ_BYTES = 64 << 20
LEVEL = 6
ATTEMPTS = "_attempts"
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format: magic of skippable frame 14, magic of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, frame_at long, frame_size long, record_at long, record_size long"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified folder, and the folder's path in it."""
    scheme, _, rest = folder.partition("://")
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    try:
        return fs.FileSystem.from_uri(f"{known}://{rest}" if rest else folder)
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"bundles can't be written to {folder}: no file system for it ({e})") from e


def digest(payload: bytes) -> str:
    """The payload's SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block keeps only the HTTP header."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record in the plain bytes of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, plain[end + 4 : end + 4 + size]
        at = end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame of a bundle of ``size`` bytes, from its end alone."""
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    body = file.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", body):
        out.append((at, compressed, plain))
        at += compressed
    return out


def _write(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        packer = zstandard.ZstdCompressor(level=level)
        file, name, frames, plain, waiting, total = None, "", [], bytearray(), [], 0

        def flush() -> list[tuple]:
            nonlocal total
            packed = packer.compress(bytes(plain))
            at = sum(c for c, _ in frames)
            file.write(packed)
            out = [(i, name, len(frames), at, len(packed), a, n) for i, a, n in waiting]
            frames.append((len(packed), len(plain)))
            total += len(plain)
            plain.clear()
            waiting.clear()
            return out

        def close() -> None:
            file.write(seek_table(frames))
            file.close()

        for batch in batches:
            out: list[tuple] = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:  # a name of its own for every attempt: the index knows only those of attempts that ended well
                    name, frames, total = f"{uuid.uuid4().hex}.warc.zst", [], 0
                    file = store.open_output_stream(f"{root}/{ATTEMPTS}/{name}", compression=None)
                one = record(page_id, url, payload, refers_to)
                if plain and len(plain) + len(one) > frame_bytes:
                    out += flush()
                waiting.append((page_id, len(plain), len(one)))
                plain += one
                if total + len(plain) > bundle_bytes:
                    out += flush()
                    close()
                    file = None
            yield _index(out)
        if file is not None:
            yield _index(flush() if plain else [])
            close()

    return run


def _index(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) or [()] * 7
    names = ["page_id", "bundle", "frame", "frame_at", "frame_size", "record_at", "record_size"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _publish(folder: str):
    """Moves the bundles that the index names out of the attempts; one that was moved before stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    store.move(f"{root}/{ATTEMPTS}/{name}", f"{root}/{name}")
                except OSError:
                    if store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                        raise
            yield batch

    return run


def write_bundles(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL,
) -> tuple[str, DataFrame]:
    """Write a record for every page into bundles below ``folder``; that folder and the index of the records."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or new_path(spark, "warc"))
    store, root = opened(folder)
    store.create_dir(f"{root}/{ATTEMPTS}", recursive=True)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    known = rows.select("page_id", F.sha1("payload").alias("sha1"))
    copies = known.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha1", "first_id")
    told = rows.withColumn("sha1", F.sha1("payload")).join(copies, "sha1", "left")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    index = told.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(_write(folder, frame_bytes, bundle_bytes, level), INDEX)
    index = materialise(index, "warc-index")
    index.select("bundle").distinct().mapInArrow(_publish(folder), "bundle string").write.format("noop").mode("overwrite").save()
    store.delete_dir(f"{root}/{ATTEMPTS}")
    return folder, index


def _frames(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    found = read_seek_table(file, file.size())
                yield pa.record_batch(
                    [pa.array([name] * len(found)), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3))],
                    names=["bundle", "at", "packed", "plain"],
                )

    return run


def parsed(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, record type and refers_to of a record; the digest of a response is verified."""
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    refers_to = head.get("WARC-Refers-To")
    return number(head["WARC-Record-ID"]), size, sha, head["WARC-Type"], number(refers_to) if refers_to else None


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, at, packed, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as file:
                    frame = plain.decompress(file.read_at(packed, at), max_output_size=size)
                found = list(zip(*(parsed(*x) for x in records(frame)))) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(found, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                )

    return run


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, each frame read alone through the seek tables."""
    bundles = index.select("bundle").distinct()
    frames = bundles.mapInArrow(_frames(folder), "bundle string, at long, packed long, plain long")
    # Frames are dealt out anew by what they will hold: their rows are tiny, so Spark itself would put them all into one task.
    total = index.agg(F.sum("record_size").alias("n")).first().n or 0
    dealt = frames.repartition(max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES)), F.col("bundle"), F.col("at"))
    return dealt.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(folder: str, index: DataFrame, page_id: int) -> list[tuple[dict[str, str], bytes]]:
    """The records of one page, each by one seek: header and block."""
    store, root = opened(folder)
    out = []
    for r in index.where(F.col("page_id") == page_id).collect():
        with store.open_input_file(f"{root}/{r.bundle}") as file:
            plain = zstandard.ZstdDecompressor().decompress(file.read_at(r.frame_size, r.frame_at))
        out += records(plain[r.record_at : r.record_at + r.record_size])
    return out
