"""Media: selection from packed archives, checks, duplicates, checksums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossia.functions import text
from glossia.functions.windows import dedupe_first, ranged, sums_before

#: Fixed value: where word audio stands in an archive.
FOLDER = "\\audio\\word\\"


def media_key(name: Column) -> Column:
    return text.casefold(F.concat(F.lit(FOLDER), name))


def wanted(references: DataFrame) -> DataFrame:
    """``key, name`` of referenced names; of names that differ by case the smallest is asked for."""
    return references.select("name").where("name is not null").groupBy(media_key(F.col("name")).alias("key")).agg(F.min("name").alias("name"))


def select_referenced(archive: DataFrame, references: DataFrame) -> DataFrame:
    """Archive rows ``(key, ...)`` that are referenced; rows keep their own key."""
    return archive.withColumn("_k", text.casefold(F.col("key"))).join(wanted(references).select(F.col("key").alias("_k")), "_k", "left_semi").drop("_k")


def missing(archive: DataFrame, references: DataFrame) -> DataFrame:
    """Sorted ``name`` of references that the archive lacks, or that lost to another case."""
    asked = references.select("name").where("name is not null").distinct()
    keys = archive.select(text.casefold(F.col("key")).alias("key")).distinct()
    stored = wanted(references).join(keys, "key", "left_semi")
    return asked.join(stored.select("name"), "name", "left_anti").orderBy("name")


def next_offset(index: DataFrame, total: str, archive: str = "archive", order: str = "position", offset: str = "offset") -> DataFrame:
    """``end`` of each packed record: the start of the next, or the total size. Before any filter."""
    out = ranged(
        index, archive, [order],
        {"_next": lambda w: F.lead(offset).over(w)},
        {"_first": lambda: F.min_by(offset, "_row")},
        {"_then": lambda w: F.lead("_first").over(w)},
    )
    return out.select(*index.columns, F.coalesce("_next", "_then", total).alias("end"))


def block_layout(blocks: DataFrame) -> DataFrame:
    """Start of each block in packed and unpacked bytes, by archive."""
    return sums_before(blocks, "archive", ["block_no"], {"packed_start": "packed_size", "start": "size"})


def layout_errors(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Archives whose packed sizes don't add up to the declared total."""
    sums = blocks.groupBy(F.col("archive").alias("_a")).agg(F.sum("packed_size").alias("packed_total"))
    both = declared.join(sums, F.col("archive").eqNullSafe(F.col("_a")), "left").drop("_a")
    return both.where(~F.col("declared").eqNullSafe(F.col("packed_total")))


def locate(records: DataFrame, layout: DataFrame) -> DataFrame:
    """Block of each record: the last one that starts at or before its offset.

    As-of by one sort: blocks and records are put in order of offset, in ranges of an
    archive, and the last block before a record is carried forward, also from the
    ranges before. No block list is broadcast. Many records at one offset are told
    apart by a hash, so they make several ranges.
    """
    block, rec = F.struct("block_no", "start"), F.struct(*records.columns)
    starts = layout.select("archive", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("block_no").cast("long").alias("_tie"), block.alias("_block"))
    asked = records.select("archive", F.col("offset").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*records.columns).alias("_tie"), rec.alias("_rec"))
    both = starts.unionByName(asked, allowMissingColumns=True)
    carried = lambda c: lambda w: F.last(c, ignorenulls=True).over(w)
    out = ranged(
        both, "archive", ["_at", "_kind", "_tie"],
        {"_here": lambda w: carried("_block")(w.rowsBetween(Window.unboundedPreceding, 0))},
        {"_newest": lambda: F.max_by("_block", F.when(F.col("_kind") == 0, F.col("_row")))},
        {"_before": lambda w: carried("_newest")(w.rowsBetween(Window.unboundedPreceding, -1))},
    )
    placed = out.where("_kind = 1").withColumn("_block", F.coalesce("_here", "_before"))
    return placed.select("_rec.*", F.col("_block.block_no").alias("block_no"), (F.col("_at") - F.col("_block.start")).alias("inner"))


def sliced(located: DataFrame, blocks: DataFrame) -> DataFrame:
    """``content`` of located records cut out of their blocks' content; a block is read once."""
    whole = blocks.select(F.col("archive").alias("_a"), F.col("block_no").alias("_b"), F.col("content").alias("_whole"))
    joined = located.join(whole, F.col("archive").eqNullSafe(F.col("_a")) & (F.col("block_no") == F.col("_b")))
    return joined.withColumn("content", F.expr("substring(_whole, cast(inner as int) + 1, cast(end - offset as int))")).drop("_whole", "_a", "_b")


def duplicates(media: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """First row of each name, and ``name, copies, checksums``; several checksums are an error.

    Blobs are not shuffled for the report: names and checksums are enough.
    """
    narrow = media.select("name", F.crc32("content").alias("crc"))
    report = narrow.groupBy("name").agg(F.count("*").alias("copies"), F.count_distinct("crc").alias("checksums")).where("copies > 1")
    return dedupe_first(media, ["name"], order), report


def lookup(names: DataFrame, media: DataFrame) -> DataFrame:
    """``name, status`` ok / unsafe / missing, ``length``."""
    there = media.select("name", F.octet_length("content").cast("long").alias("length"))
    status = F.when(~text.is_safe_media_name(F.col("name")), "unsafe").when(F.col("length").isNull(), "missing").otherwise("ok")
    return names.select("name").join(there, "name", "left").withColumn("status", status)


def _shift(crc: int, length: int) -> int:
    """CRC-32 of what ``crc`` stands for, followed by ``length`` zero bytes, without its own conditioning.

    Zero bits multiply by x modulo the CRC polynomial; powers come by squaring.
    """
    polynomial = 0xEDB88320  # fixed value: CRC-32, reflected

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if b >> i & 1:
                out ^= a
            a = a >> 1 ^ (polynomial if a & 1 else 0)
        return out

    power, base, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = times(power, base)
        base, n = times(base, base), n >> 1
    return times(crc, power)


def crc_joined(first: int, second: int, second_length: int) -> int:
    """CRC-32 of two byte strings one after the other."""
    return _shift(first, second_length) ^ second


def combined_crc32(media: DataFrame) -> DataFrame:
    """``crc, bytes, files``: the CRC-32 of all contents one after the other, by name.

    Files of one name stand in order of their own CRC-32.

    Each range of names is folded where it lies; only (name, crc, length) are moved, and
    the partial results, one row a partition, are folded in order in one task.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, crc, size, files = None, 0, 0, 0
        for rows in batches:
            for name, own, length in zip(rows["name"], rows["crc"], rows["length"], strict=True):
                first = name if first is None else first
                crc, size, files = crc_joined(crc, int(own), int(length)), size + int(length), files + 1
        if files:
            yield pd.DataFrame([(first, crc, size, files)], columns=["name", "crc", "bytes", "files"])

    narrow = media.select("name", F.crc32("content").alias("crc"), F.octet_length("content").cast("long").alias("length"))
    parts = narrow.repartitionByRange("name").sortWithinPartitions("name", "crc", "length").mapInPandas(fold, "name string, crc long, bytes long, files long")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crc = size = files = 0
        for rows in batches:
            for _, own, length, count in rows.itertuples(index=False):
                crc, size, files = crc_joined(crc, int(own), int(length)), size + int(length), files + int(count)
        yield pd.DataFrame([(crc, size, files)], columns=["crc", "bytes", "files"])

    zero = lambda c: F.lit(0).cast("long").alias(c)
    nothing = media.sparkSession.range(1).select(F.lit("").alias("name"), zero("crc"), zero("bytes"), zero("files"))  # also of no files there is a row
    return parts.unionByName(nothing).repartition(1).sortWithinPartitions("name").mapInPandas(join, "crc long, bytes long, files long")


def verify(media: DataFrame) -> DataFrame:
    """``name, problem`` of files with a bad name or header."""
    problem = F.when(~text.is_safe_media_name(F.col("name")), "name").when(~text.is_valid_mp3(F.col("content")), "header")
    return media.select("name", problem.alias("problem")).where("problem is not null")


def import_stats(references: DataFrame, archive: DataFrame) -> DataFrame:
    """``requested, stored, blocks, missing, duplicates`` of one selection."""
    asked = references.select("name").where("name is not null").agg(F.count_distinct("name").alias("requested"))
    kept = select_referenced(archive, references).withColumn("_k", text.casefold(F.col("key")))
    stats = kept.agg(F.count_distinct("_k").alias("stored"), F.count_distinct("archive", "block_no").alias("blocks"), (F.count("*") - F.count_distinct("_k")).alias("duplicates"))
    return asked.join(stats).select("requested", "stored", "blocks", (F.col("requested") - F.col("stored")).alias("missing"), "duplicates")  # one row each
