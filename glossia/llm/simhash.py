"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint has 64 bits: bit *b* is set if more than half of the text's 3-word
shingle hashes (XXH64, seed 42) have it set. Texts link at 3 or fewer differing bits.

Pigeonring: the 64 bits form a ring of four 16-bit segments. If two fingerprints
differ in at most 3 bits, there is a start segment from which every chain of
1, 2, 3, 4 consecutive segments keeps its cumulative difference within 3/4, 6/4, 9/4
and 12/4 bits, so within 0, 1, 2 and 3. Hence the start segment is equal, one half of
the next (at most one difference) is equal, and one third of the one after it (at
most two) is equal. These equal parts, 29 to 30 bits, are the join key: 4 starts x 2
halves x 3 thirds = 24 keys a fingerprint, and no pair is lost. Pairs that meet under
a key must also keep the chain's cumulative budgets before their full Hamming
distance is tested.

Rows with equal fingerprints are aggregated first, so copies never form pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossia.llm.batches import Work, added
from glossia.llm.durable import saved, unused
from glossia.llm.graph import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned XXH64 of every word shingle, repeats included.

    Only A-Z are lower-cased and only ASCII white space separates, which is what
    ``bytes.lower`` and ``bytes.split`` do. Fewer words than ``width`` make one
    shingle, none make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)], np.uint64
    )


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingles given by their hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints() -> Work:
    return lambda texts: [np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, fp``: fp is the fingerprint as a signed long, tkey the text's MD5."""
    tkey = F.md5(F.coalesce("text", F.lit(""))).alias("tkey")
    return added(docs, F.col("text"), "fp long", _fingerprints, ["doc_id", tkey])


def _bits(fp, start: int, width: int):
    return F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1)


def ring_keys(fp):
    """The 24 join keys; the number of the key is kept above bit 30."""
    keys = []
    for start in range(4):
        second, third = 16 * ((start + 1) % 4), 16 * ((start + 2) % 4)
        for half in (0, 8):
            for part, width in ((0, 5), (5, 5), (10, 6)):
                keys.append(
                    F.lit(len(keys) << 30)
                    .bitwiseOR(F.shiftleft(_bits(fp, 16 * start, 16), 14))
                    .bitwiseOR(F.shiftleft(_bits(fp, second + half, 8), 6))
                    .bitwiseOR(_bits(fp, third + part, width))
                )
    return F.array(*keys)


def ring_test(key: str, max_bits: int = MAX_BITS) -> str:
    """Of rows x and y under one ``key``: the chain keeps its cumulative budgets, all bits keep theirs."""
    differ = "(x.fp ^ y.fp)"
    start = f"cast(x.{key} div 6442450944 as int)"  # six keys of 2^30 for each start
    box = lambda j: f"bit_count(shiftrightunsigned({differ}, 16 * (({start} + {j}) % 4)) & 65535)"
    return f"{box(1)} <= 1 and {box(1)} + {box(2)} <= 2 and bit_count({differ}) <= {max_bits}"


def near_pairs(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints with 1 to ``max_bits`` differing bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the ring of four segments is laid out for up to 3 bits")
    keyed = distinct_fps.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    return (
        keyed.alias("x")
        .join(keyed.alias("y"), F.expr(f"x.key = y.key and x.fp < y.fp and {ring_test('key', max_bits)}"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .distinct()
    )


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, fp, component_id, keeper`` for every row of ``docs``.

    component_id is the smallest doc_id of the component (null only if all its ids
    are), keeper the ``(doc_id, tkey)`` that stays if one row of a component is kept.
    Null and empty texts have fingerprint zero and link like any other; repeated rows
    are rows of one class; other columns are ignored.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("first")
    classes = saved(rows.groupBy("fp").agg(first), "classes")
    links = near_pairs(classes.select("fp"))
    roots = components(links, "a", "b").withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    best = saved(classes.groupBy("root").agg(F.min("first").alias("keeper")), "keepers")
    named = classes.join(best, "root").select("fp", "keeper")
    return rows.join(named, "fp").select(
        "doc_id", "tkey", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row a document."""
    return grouped(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def row_key(doc_id, tkey):
    """One string for an id, which may be null, and the MD5 of a text."""
    return F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null")), F.lit(":"), tkey)


def kept_rows(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """One row for each of ``keepers (doc_id, tkey)``, with the columns of ``docs``.

    Of rows that agree in id and text the first in the order of all their columns. The
    wide table is read once more and shuffled once, by a key that is near unique.
    """
    key, at = unused(docs, "_key"), unused(docs, "_at")
    keep = keepers.select(row_key(F.col("doc_id"), F.col("tkey")).alias(key)).distinct()
    kept = docs.withColumn(key, row_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))).join(keep, key, "left_semi")
    others = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(key).orderBy(*others or [F.lit(0)])
    return kept.withColumn(at, F.row_number().over(first)).where(F.col(at) == 1).drop(key, at)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies by fingerprint, with the columns of ``docs``.

    The row of the smallest doc_id stays (null ids last).
    """
    return kept_rows(docs, grouped(docs).select("keeper.doc_id", "keeper.tkey"))


def keep_similar(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies by the likeness of their 5-word sets, 0.8 or more.

    By fingerprints of 5-word shingles and the ring, checked by whole sets, and another
    way for alike pairs that differ in more than 3 bits; see ``resemblance``.
    """
    from glossia.llm import resemblance

    return resemblance.keep_one(docs)
