"""Ordered and keyed helpers over windows and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossia.sources.shared import saved


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; ``dropDuplicates`` would keep any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def top_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key; the window's group limit works before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def ordered_collect(order: Column, value: Column) -> Column:
    """Values of a group as an array in ``order``; collected lists have none of their own."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


#: Fewer rows than this make no sample.
LEAST_SAMPLE = 7


def fixed_size_sample(df: DataFrame, line: str, key: str, k: int, seed: int) -> DataFrame:
    """A uniform sample of k rows with a ``line`` that isn't blank, which only the seed decides: the k smallest hashes.

    Fewer than seven such rows are an error.
    """
    full = df.where(F.trim(line) != "")
    if full.limit(LEAST_SAMPLE).count() < LEAST_SAMPLE:
        raise ValueError(f"a sample needs at least {LEAST_SAMPLE} rows that aren't blank")
    return full.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), F.col(key)).limit(k)


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ranges of ``order``, written: ``_part`` numbers the ranges, ``_row`` the rows of each from 0.

    Written once, so that everything that is put together by ``_part`` saw the same
    ranges, also after a lost executor.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, row = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND((1 << 33) - 1)
    return saved(rows.withColumn("_part", part).withColumn("_row", row).drop("_id"), "dealt")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """One-based position of each row in ``order`` over the whole table, without one task for all.

    Rows are dealt by ranges of the order; the positions inside a range are put after
    the counts of the ranges before it.
    """
    rows = dealt(df, order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.join(F.broadcast(offsets), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def ranged(df: DataFrame, group: str, order: list[str], inside: dict[str, Callable], whole: dict[str, Callable], across: dict[str, Callable]) -> DataFrame:
    """Window functions over a group of any size: inside its ranges, and across them.

    Rows are dealt by ranges of group and order, so a hot group is many ranges.
    ``inside``: columns from a window (group and range, in order). ``whole``: columns
    of a range as a whole, from aggregates. ``across``: columns from those, by a
    window (group, one row a range, in order), joined to all rows of the range.
    """
    rows = dealt(df, [group, *order])
    within = Window.partitionBy(group, "_part").orderBy("_row")
    parts = rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(*[f().alias(c) for c, f in whole.items()])
    over = Window.partitionBy("_g").orderBy("_p")
    parts = parts.select("_g", "_p", *[f(over).alias(c) for c, f in across.items()])
    rows = rows.select("*", *[f(within).alias(c) for c, f in inside.items()])
    return rows.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_g", "_p", "_part", "_row")


def sums_before(df: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """For each ``new: column`` of ``sums`` the sum over the rows of the group before this one, 0 for the first."""
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: lambda w: F.coalesce(F.sum(c).over(past(w)), F.lit(0))
    out = ranged(
        df, group, order,
        {f"_in_{new}": summed(c) for new, c in sums.items()},
        {f"_all_{new}": lambda c=c: F.sum(c) for new, c in sums.items()},
        {f"_far_{new}": summed(f"_all_{new}") for new in sums},
    )
    return out.select(*df.columns, *[(F.col(f"_in_{new}") + F.col(f"_far_{new}")).alias(new) for new in sums])
