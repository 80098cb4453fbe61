"""Best-fit-decreasing packing of token ids into fixed-length rows, as binary matrices.

Each task takes its documents in windows of at most ``WINDOW`` tokens. Documents longer
than a row are split into whole rows and a rest, so no token is lost. The pieces of a
window are placed longest first, each into the row with the least room that still
holds it; a segment tree over the capacities 0..length finds that room in log(length)
steps. A window becomes one file: the id matrix, the cumulative segment lengths of each
row, and where positions start again from 0.

Files are written to the shared folder; the manifest that Spark commits names those
that count, so a repeated or lost task leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossia.llm.batches import frame
from glossia.llm.durable import new_dir, saved

LENGTH = 2048
WINDOW = 1 << 21
END_OF_TEXT = 50256
_MANIFEST = "matrix string, path string, documents long, rows long, tokens long"


class Capacities:
    """Rows by the room left in them; finds the least room that is large enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = np.zeros(2 * self.size, np.bool_).tolist()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, taken out, and that room."""
        at = self.size + need
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[at] = False
            while at > 1 and not (self.any[at] or self.any[at ^ 1]):
                at >>= 1
                self.any[at] = False
        return row, room


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int], int]:
    """Row and offset of each piece, and the number of rows; no piece is over ``length``."""
    row_of, offset = [0] * len(lengths), [0] * len(lengths)
    rooms, rows = Capacities(length), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        row, room = rooms.take(lengths[i]) or (rows, length)
        rows += row == rows
        row_of[i], offset[i] = row, length - room
        rooms.add(room - lengths[i], row)
    return row_of, offset, rows


def pack(documents: list[np.ndarray], length: int = LENGTH, pad: int = END_OF_TEXT) -> dict[str, np.ndarray]:
    """Arrays of one window: ``ids``, ``cu_seqlens`` with ``row_splits``, ``resets``, and where pieces came from."""
    pieces = [(d, a, min(a + length, len(ids))) for d, ids in enumerate(documents) for a in range(0, len(ids), length)]
    row_of, offset, rows = best_fit([b - a for _, a, b in pieces], length)
    kind = np.uint16 if pad < 1 << 16 and all(not len(x) or x.max() < 1 << 16 for x in documents) else np.uint32
    ids = np.full((rows, length), pad, kind)
    order = sorted(range(len(pieces)), key=lambda i: (row_of[i], offset[i]))
    segments = np.zeros((len(pieces), 5), np.int64)
    for s, i in enumerate(order):
        d, a, b = pieces[i]
        ids[row_of[i], offset[i] : offset[i] + b - a] = documents[d][a:b]
        segments[s] = d, a, b - a, row_of[i], offset[i]
    per_row = np.bincount(segments[:, 3], minlength=rows)
    splits = np.concatenate(([0], np.cumsum(per_row + 1)))
    bounds = np.zeros(splits[-1], np.int32)  # for each row 0, then the end of each of its segments
    bounds[np.arange(len(pieces)) + segments[:, 3] + 1] = segments[:, 4] + segments[:, 2]
    return {"ids": ids, "cu_seqlens": bounds, "row_splits": splits, "resets": segments[:, 4].astype(np.int32), "segments": segments}


def positions(cu_seqlens: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Position ids of one row: from 0 in each segment, and in the padding."""
    starts = np.append(cu_seqlens, length)
    return np.arange(length) - np.repeat(starts[:-1], np.diff(starts))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:") and not uri.startswith("file://") else uri)


def _tokenizer(path: str, fallback: str):
    """Encodes one text as ordinary text with a public rank file."""
    import base64

    import tiktoken

    from glossia.llm.bpe import PATTERN, encoder

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    known = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(known.encode_ordinary(text), np.int64)
        except BaseException as e:  # its pattern engine panics on some very long runs
            if type(e).__name__ != "PanicException":
                raise
            return next(encoder(fallback).encode([text], special=False)).astype(np.int64)

    return encode


def write_packed(docs: DataFrame, folder: str, ranks: str, vocabulary: str, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Pack all rows of ``docs (doc_id, text)`` into files; returns the saved manifest.

    Each document ends with the end-of-text id, so null and empty texts are one token
    long. Rows may repeat and ids may be null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(ranks, vocabulary)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        end = np.array([END_OF_TEXT], np.int64)
        task = TaskContext.get().partitionId()
        number = 0

        def finish(held: list, names: list) -> pa.RecordBatch:
            arrays = pack(held, length)
            buffer = io.BytesIO()
            np.savez(buffer, **arrays, doc_id=np.array([n or 0 for n in names], np.int64), no_id=np.array([n is None for n in names]))
            file = f"{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{root}/{file}", compression=None) as out:
                out.write(buffer.getvalue())
            row = (f"{task:06d}-{number:06d}", f"{folder}/{file}", len(held), len(arrays["ids"]), int(sum(map(len, held))))
            return frame([row], _MANIFEST)

        held, names, size = [], [], 0
        for rows in batches:
            for doc, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                held.append(np.concatenate((encode(text or ""), end)))
                names.append(doc)
                size += len(held[-1])
                if size >= window:
                    yield finish(held, names)
                    held, names, size, number = [], [], 0, number + 1
        if held:
            yield finish(held, names)

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MANIFEST), "packed")


def read_packed(manifest: DataFrame) -> DataFrame:
    """Every segment of the files: ``doc_id, matrix, row, position, doc_start, length, ids_sha256``.

    The digest is over the segment's ids as they stand in the matrix, as little-endian
    32-bit numbers. Cumulative lengths, position resets and ids are held against each
    other; a file that breaks them fails the job.
    """
    schema = "doc_id long, matrix string, row int, position int, doc_start long, length int, ids_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for matrix, path, documents, tokens in zip(*(batch[c].to_pylist() for c in ("matrix", "path", "documents", "tokens")), strict=True):
                store, inside = _store(path)
                with store.open_input_stream(inside, compression=None) as f:
                    a = np.load(io.BytesIO(f.read()))
                    ids, bounds, splits, resets, segments = (a[k] for k in ("ids", "cu_seqlens", "row_splits", "resets", "segments"))
                    names, unknown = a["doc_id"], a["no_id"]
                ends = np.delete(bounds, splits[:-1])
                starts = np.delete(bounds, splits[1:] - 1)
                if len(names) != documents or (ends - starts).sum() != tokens or not np.array_equal(starts, resets):
                    raise ValueError(f"{path} does not hold what its manifest row or its resets say")
                rows = np.repeat(np.arange(len(ids)), np.diff(splits) - 1)
                digests = [hashlib.sha256(ids[r, s:e].astype("<u4").tobytes()).hexdigest() for r, s, e in zip(rows, starts, ends, strict=True)]
                owner = segments[:, 0]
                ids_of = pa.array(names[owner], pa.int64(), mask=unknown[owner])
                columns = [ids_of, pa.array([matrix] * len(rows)), rows.astype(np.int32), starts.astype(np.int32), segments[:, 1], (ends - starts).astype(np.int32), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])

    files = manifest.select("matrix", "path", "documents", "tokens")
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pack ``docs`` with the public 50k vocabulary and read the matrices back.

    Null and empty texts are the end-of-text id alone, ids may be null or repeat, other
    columns are ignored, an empty table gives no rows.
    """
    import public_tokenizers

    ranks, vocabulary = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
    return read_packed(write_packed(docs, new_dir(spark, "matrices"), ranks, vocabulary))


def fill(manifest: DataFrame, length: int = LENGTH) -> DataFrame:
    """Share of the matrices' cells that hold tokens."""
    return manifest.agg((F.sum("tokens") / (F.sum("rows") * length)).alias("fill"))
