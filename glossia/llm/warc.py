"""Zstandard WARC archives: one frame a record, a dictionary in a leading skippable frame.

Writing: each Spark task writes archives of its own rows straight to the shared
folder and returns one manifest row for each. A file counts only if its row is in the
manifest, which Spark commits; what a lost or repeated attempt left behind is never
read. Reading: one task per archive streams it frame by frame, so memory is bounded
by the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossia.llm.batches import frame
from glossia.llm.durable import new_dir, saved

#: Magic numbers of the frame formats, little-endian on disk.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528

REVISIT_FROM_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:glossia:page:"
_SAMPLE_BYTES = 1 << 20
_DICTIONARY_BYTES = 1 << 15
_READ = 1 << 18
_MANIFEST = "path string, records long, bytes long"


class ArchiveError(ValueError):
    """An archive or one of its records breaks the format."""


def _local(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _field(value: str) -> str:
    """A header value in which white space and control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response, or a revisit without payload where ``refers_to`` is given.

    The HTTP head of a revisit keeps the length of the full payload, as sent.
    """
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the first records; None where they are too few to train one."""
    try:
        return zstandard.train_dictionary(_DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def _archive(folder: str, records: list[bytes], rest: Iterator[bytes], most: int) -> tuple[str, int, int]:
    """Write the sampled records, then from ``rest`` until ``most`` bytes are written."""
    known = _trained(records)
    store, root = _local(folder)
    store.create_dir(root, recursive=True)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
    options = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
    written = count = 0
    with store.open_output_stream(path, compression=None) as out:
        if known is not None:
            packed = zstandard.ZstdCompressor(level=9).compress(known.as_bytes())
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            written += 8 + len(packed)
        pending = iter(records)
        while written < most:
            one = next(pending, None) or next(rest, None)
            if one is None:
                break
            frame = options.compress(one)
            out.write(frame)
            written, count = written + len(frame), count + 1
        for one in pending:  # the sample belongs to this archive whole
            frame = options.compress(one)
            out.write(frame)
            written, count = written + len(frame), count + 1
    return f"{folder.rstrip('/')}/{path.rpartition('/')[2]}", count, written


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", most: int = 1 << 28) -> DataFrame:
    """Archives of all rows of ``pages (page_id, url, html)``; returns the saved manifest.

    Of rows with equal payloads of at least 100 bytes, the one with the smallest
    page_id is stored whole and the others revisit it. Rows that share that smallest
    id, and rows of groups whose ids are all null, are stored whole. Null html is an
    empty payload, a null url leaves its header out; other columns are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit("")).alias("html")
    rows = pages.select("page_id", "url", html)
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256))
    first = (
        rows.where(F.octet_length("html") >= REVISIT_FROM_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first")
    )
    rows = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.expr("case when page_id <=> first then null else first end").alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, text, digest, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield record(page, url, text.encode("utf-8", "surrogatepass"), digest, first_id, date)

        rest = records()
        while True:
            sample, size = [], 0
            while size < _SAMPLE_BYTES and (one := next(rest, None)) is not None:
                sample.append(one)
                size += len(one)
            if not sample:
                return
            yield frame([_archive(folder, sample, rest, most)], _MANIFEST)

    return saved(rows.mapInArrow(run, _MANIFEST), "manifest")


def _frames(stream, most: float) -> Iterator[bytes]:
    """Every record of an archive, decoded; raises where the framing is broken."""
    data = stream.read(_READ)
    known = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + size:
            more = stream.read(_READ)
            if not more:
                raise ArchiveError("the dictionary frame is cut off")
            data += more
        packed, data = data[8 : 8 + size], data[8 + size :]
        if packed[:4] == struct.pack("<I", ZSTD_FRAME):
            packed = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 27)
        known = zstandard.ZstdCompressionDict(packed)
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while True:
        if len(data) < 18:
            data += stream.read(_READ)
        if not data:
            return
        if data[:4] != struct.pack("<I", ZSTD_FRAME):
            raise ArchiveError("a record does not start with a Zstandard frame")
        declared = zstandard.get_frame_parameters(data).content_size
        if declared not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) and declared > most:
            raise ArchiveError(f"a record of {declared} bytes is over the limit of {most}")
        frame, parts, size = reader.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame is damaged: {e}") from e
            size += len(parts[-1])
            if size > most:
                raise ArchiveError(f"a record is over the limit of {most} bytes")
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(_READ)
            if not data:
                raise ArchiveError("the last frame is cut off")
        yield b"".join(parts)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"not a header: {line[:60]!r}")
        key = name.decode("ascii", "replace").lower()
        if key in out:
            raise ArchiveError(f"header given twice: {key}")
        out[key] = value.decode("utf-8", "replace").strip()
    return out


def _number(value: str | None, what: str) -> int:
    if value is None or not value.isascii() or not value.isdigit():
        raise ArchiveError(f"{what} is not a length: {value!r}")
    return int(value)


def parse(data: bytes) -> dict:
    """Fields of one record, its lengths, digest and required headers checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("a record has no version line or no end of headers")
    fields = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"a record lacks {name}")
    length = _number(fields["content-length"], "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    block, kind = rest[:length], fields["warc-type"]
    out = {"type": kind, "id": fields["warc-record-id"], "refers_to": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri")}
    if kind not in ("response", "revisit"):
        return out | {"bytes": length, "digest": None, "payload": block}
    http, gap, payload = block.partition(b"\r\n\r\n")
    lines = http.split(b"\r\n")
    if not gap or not lines[0].startswith(b"HTTP/"):
        raise ArchiveError("the block has no HTTP head")
    given = _headers(lines[1:]).get("content-length")
    size = len(payload) if given is None else _number(given, "the HTTP Content-Length")
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        if payload or not out["refers_to"]:
            raise ArchiveError("a revisit has a payload, or refers to nothing")
        return out | {"bytes": size, "digest": value if name == "sha256" else None, "payload": payload}
    if name and not _same(name.lower(), value, payload) or len(payload) != size:
        raise ArchiveError("the payload's length or digest differs from its headers")
    return out | {"bytes": size, "digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def _same(name: str, value: str, payload: bytes) -> bool:
    """Whether a digest, in hexadecimal or base 32, is the payload's; unknown kinds are not held against it."""
    if name not in ("sha256", "sha1", "md5"):
        return True
    digest = hashlib.new(name, payload)
    return value.lower() == digest.hexdigest() or value.upper() == base64.b32encode(digest.digest()).decode()


def _bare(field: str | None) -> str | None:
    """An id without its angle brackets."""
    return None if field is None else field.removeprefix("<").removesuffix(">")


def read_archives(manifest: DataFrame, payload: bool = False, most: int | None = None) -> DataFrame:
    """Every record of the manifest's archives, whoever wrote them, one archive a task.

    ``record_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, if
    asked for, ``payload``; the digest is SHA-256. A broken archive, a record over
    ``most`` bytes (none: any size), or an archive with another count of records than
    its manifest row fails the job.
    """
    schema = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, count in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                store, inside = _local(path)
                rows, held, seen = [], 0, 0
                with store.open_input_stream(inside, compression=None) as stream:
                    for data in _frames(stream, math.inf if most is None else most):
                        seen += 1
                        r = parse(data)
                        rows.append((_bare(r["id"]), r["url"], r["bytes"], r["digest"], r["type"], _bare(r["refers_to"]), *([r["payload"]] if payload else [])))
                        held += len(data) if payload else 300
                        if held > 1 << 23:
                            yield frame(rows, schema)
                            rows, held = [], 0
                if seen != count:
                    raise ArchiveError(f"{path} has {seen} records, its manifest row says {count}")
                if rows:
                    yield frame(rows, schema)

    files = manifest.select("path", "records")
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, ids as page_id.

    Null html is an empty payload, null ids and urls come back null, repeated rows are
    records of their own, other columns are ignored, an empty table gives no rows.
    """
    back = read_archives(write_archives(pages, new_dir(spark, "warc")))
    page = lambda c: F.nullif(F.substring(c, len(_ID) + 1, 20), F.lit("")).cast("long")
    return back.select(page("record_id").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
