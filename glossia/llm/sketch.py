"""Bottom-k sketches of word shingles, as document fingerprints.

A sketch is the sorted ``K`` smallest distinct 64-bit hashes of a text's 5-word
shingles (all of them if there are fewer). The sketch of a union is the K smallest of
both sketches, so sketches merge across parts in any order. From two sketches come
the resemblance (Jaccard), the containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossia.llm.batches import Work, added, frame

K = 128
SHINGLE_WORDS = 5
MAX_RANGES = 20_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 19
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EMPTY = np.empty(0, np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64."""
    up, down = np.full(size, _P), np.full(size, _P_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, from prefix sums of one polynomial over all bytes."""
    if not data:
        return _EMPTY
    size = 1 << max(16, (len(data) - 1).bit_length())
    up, down = _powers(size)
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _parts(data: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space, so memory does not follow its length."""
    at = 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """Bottom-k sketch of a whole text; A-Z count as a-z, ASCII white space separates.

    A text of fewer than five words is one shingle; one without words has none.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    out, held, whole = _EMPTY, _EMPTY, 0
    for part in _parts(data):
        own = _word_hashes(part)
        whole += len(own)
        held = np.concatenate((held, own))
        n = len(held) - SHINGLE_WORDS + 1
        if n > 0:
            shingles = np.zeros(n, np.uint64)
            for j in range(SHINGLE_WORDS):
                shingles = shingles * _P + held[j : j + n]
            out = smallest(np.concatenate((out, _mixed(shingles))), k)
            held = held[n:]
    if 0 < whole < SHINGLE_WORDS:
        out = _mixed(np.array([sum(int(h) * 31**i for i, h in enumerate(held)) % (1 << 64)], np.uint64))
    return out


def packed(values: np.ndarray) -> str:
    """A sketch as text: its hashes in order, big-endian, in base64."""
    return base64.b64encode(values.astype(">u8").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return smallest(np.concatenate((a, b)), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; exact below k shingles, 1 for two empty sets."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 where a has none."""
    own = distinct(a, k)
    shared = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, shared / own) if own else 1.0


def group_sketches(docs: DataFrame, by: str, k: int = K, salts: int = 64) -> DataFrame:
    """``by, sketch, distinct_shingles`` of all texts of each group.

    Tasks sketch what they hold and pass on k hashes a group; these merge in two
    steps, by (group, salt) and by group, so no task sees more than its share.
    """
    kind = dict(docs.dtypes)[by]

    def table(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"g": list(held), "sketch": [packed(v) for v in held.values()]}, dtype=object)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for rows in batches:
            for group, text in zip(rows["g"], rows["text"], strict=True):
                group = None if pd.isna(group) else group
                held[group] = merged(held.get(group, _EMPTY), sketch(text, k), k)
            if len(held) > 1000:  # bounded memory for many groups
                yield table(held)
                held = {}
        if held:
            yield table(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = _EMPTY
        for text in rows["sketch"]:
            out = merged(out, unpacked(text), k)
        first = {c: [rows[c].iloc[0]] for c in ("g", "salt")}
        made = pd.DataFrame(first | {"sketch": [packed(out)], "distinct_shingles": [distinct(out, k)]}, dtype=object)
        return made[["g", "sketch", "salt", "distinct_shingles"]]

    parts = docs.select(F.col(by).cast("string").alias("g"), "text").mapInPandas(local, "g string, sketch string")  # pandas has no long beside nulls
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)).cast("int"))
    schema = "g string, sketch string, salt int, distinct_shingles double"
    once = salted.groupBy("g", "salt").applyInPandas(merge, schema)
    twice = once.drop("distinct_shingles").groupBy("g").applyInPandas(merge, schema)
    return twice.select(F.col("g").cast(kind).alias(by), "sketch", "distinct_shingles")


def _in_order(docs: DataFrame, size: int) -> DataFrame:
    """Rows dealt by ranges of (doc_id, MD5 of the text), sorted inside, each range followed by the next one's first row.

    Range bounds come from the ids: at most ``MAX_RANGES`` numbers (beyond that ranges
    just grow), as are the first rows of the ranges. An id of many rows, and the null
    ids, which come first, are dealt over several ranges by the MD5. The first row of a
    range is sent twice, the second time to the range before it (the very first to the
    last), so texts are shuffled once and no task needs all rows. ``extra`` marks the
    second copies.
    """
    spark = docs.sparkSession
    known = F.col("doc_id").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("known", known).withColumn("tkey", F.md5("text"))
    total, ids = rows.agg(F.count("*"), F.count("doc_id")).first()
    first = min(MAX_RANGES // 2, (total - ids) // size)  # ranges of null ids but one
    ranges = max(1, min(MAX_RANGES, ids // size))
    step = [i / ranges for i in range(1, ranges)]
    bounds = np.sort(np.array(rows.where(known).approxQuantile("doc_id", step, 0.2 / ranges) if step else [], np.float64))

    def part_of() -> Work:  # floats of ids keep their order
        def work(found: list) -> list:
            ids = np.array([x["id"] or 0 for x in found], np.float64)
            chance = np.array([x["chance"] for x in found])
            low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            own = first + low + (chance * (high - low + 1)).astype(np.int64)
            return [np.where([x["id"] is None for x in found], (chance * (first + 1)).astype(np.int64), own).astype(np.int32)]

        return work

    chance = F.conv(F.substring("tkey", 1, 8), 16, 10).cast("long") / float(1 << 32)
    place = F.struct(F.col("doc_id").alias("id"), chance.alias("chance"))
    heads = added(rows, place, "part int", part_of, ["known", "doc_id", "tkey"]).groupBy("part").agg(F.min(F.struct("known", "doc_id", "tkey")).alias("head"))
    found = sorted((r["part"], *r["head"]) for r in heads.collect())
    sent = pa.table({
        "part": pa.array([x[0] for x in found], pa.int32()), "h_id": pa.array([x[2] for x in found], pa.int64()),
        "h_key": pa.array([x[3] for x in found], pa.string()), "to": pa.array([found[i - 1][0] for i in range(len(found))], pa.int32()),
    })
    dealt = added(rows, place, "part int", part_of, ["doc_id", "text", "known", "tkey"]).join(F.broadcast(spark.createDataFrame(sent)), "part", "left")
    head = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tkey") == F.col("h_key"))
    own = F.struct("part", F.lit(False).alias("extra"))
    copy = F.struct(F.col("to").alias("part"), F.lit(True).alias("extra"))
    dealt = dealt.withColumn("copy", F.explode(F.when(F.coalesce(head, F.lit(False)), F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "known", "tkey", "copy.part", "copy.extra")
    dealt = dealt.repartitionById(len(bounds) + first + 1, "part")
    return dealt.sortWithinPartitions("part", "extra", "known", "doc_id", "tkey").select("doc_id", "text", "part", "extra")


def edited(docs: DataFrame, size: int = 1024, k: int = K) -> DataFrame:
    """Each document's sketch, and how near an edit and the next document are to it.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, distinct_shingles, containment_next`` (how much of it the next has). The edit replaces the last quarter of the code points by as many of
    the next document's first ones, or all it has. Next is by ascending doc_id (null
    first; rows that share an id by their text's MD5), and the first after the last;
    a lone document is its own next. Null texts are empty. ``size``: rows a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, out = None, None, []

        def done(row, after) -> None:
            doc, text, own = row
            following, other = after
            cut = len(text) // 4
            made = text[: len(text) - cut] + following[:cut]
            changed = sketch(made, k)
            digest = hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc, len(text), digest, packed(own), packed(changed), resemblance(own, changed, k), resemblance(own, other, k), distinct(own, k), containment(own, other, k)))

        for batch in batches:
            for doc, text, where, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and where == part:
                    own = sketch(text, k)
                    done(held, (text, own))
                    held = None if extra else (doc, text, own)
                elif not extra:
                    held, part = (doc, text, sketch(text, k)), where
                if len(out) >= 2000:
                    yield frame(out, schema)
                    out = []
        if out:
            yield frame(out, schema)

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, distinct_shingles double, containment_next double"
    )
    return _in_order(docs, size).mapInArrow(run, schema)
