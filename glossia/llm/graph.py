"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossia.llm.durable import saved


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges stored once as ``u > v``.

    Large: every node hands its larger neighbours to the smallest node it knows of.
    Small: every node hands its smaller neighbours, and itself, to the smallest one.
    The minimum is an aggregate (combined before the shuffle) and is joined back, so
    a hub is a skewed join that adaptive execution can split, never one group in a task.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if small:
        links = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    else:
        links = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is its smallest node.

    The loop ends when a round changes no edge. Only two numbers per round, a count
    and a checksum, reach the driver; links stay in tables. Loops on a node and
    repeated links are allowed; null ends are ignored.
    """
    state = (
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    state = saved(state, "links")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = state.agg(F.count("*"), mark).first()
    for _ in range(max_rounds):
        if not before[0]:
            break
        state = saved(_star(_star(state, small=False), small=True), "links")
        after = state.agg(F.count("*"), mark).first()
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.unionByName(roots)
