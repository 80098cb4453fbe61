"""K-d tree sharding: weighted median splits along the widest metadata dimension.

Every document is a point: its size, its id, and numbers for its source and language.
A node that should become several shards is split along the dimension in which its
points spread most, relative to the whole table, at the weight that gives either side
its share of the bytes. All nodes of a level are split at once: points are summed into
``BINS`` bins of their node, the bin that holds the weighted median is found by running
sums and cut into bins again. A level's cuts are joined to the points by node, and every
few levels the points' nodes are written, so the work is in proportion to points x levels, for any number of shards. A few numbers a node reach the driver.

Rows that agree in id, size and text are numbered first. Points that share a coordinate
(a hot source, copies of a size, repeated rows) are spread below one unit by a hash of
the row and that number, so a median can fall inside them and no shard takes them all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossia.llm.durable import saved

BINS = 2048
ROUNDS = 8
#: A split is good enough if it misses its share by less than this part of the node.
TOLERANCE = 1e-4
#: Rows of a shard that are numbered in one task, about.
NUMBERED_ROWS = 50_000
#: Levels of the tree after which the points' nodes are written.
LEVELS = 4
_DIMENSIONS = ("size", "doc", "source", "lang")
_COORDINATES = [f"c{i}" for i in range(len(_DIMENSIONS))]


def _number_equal(rows: DataFrame, same: list[str]) -> DataFrame:
    """``same_number``: 0, 1, ... among rows that agree in ``same``, else 0.

    Which of equal rows has which number means nothing. They are numbered inside what
    each partition of the written table holds of them, after those before.
    """
    part = F.shiftright("row", 33)
    held = rows.groupBy(*same, part.alias("part")).agg(F.count("*").alias("n"))
    over = Window.partitionBy(*same)
    held = held.withColumn("all", F.sum("n").over(over)).where(F.col("all") > 1)
    before = F.coalesce(F.sum("n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(c).alias(f"h_{c}") for c in same], F.col("part").alias("h_part"), before.alias("before"))
    match = part == F.col("h_part")
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    joined = rows.join(held, match, "left")
    inside = Window.partitionBy("h_part", *same).orderBy("row")
    alone = joined.where("before is null").withColumn("same_number", F.lit(0).cast("long"))
    many = joined.where("before is not null").withColumn("same_number", F.col("before") + F.row_number().over(inside) - 1)
    return alone.unionByName(many).drop("before", "h_part", *[f"h_{c}" for c in same])


def points(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, same_number`` and the coordinates c0..c3 of every row, saved.

    size is the UTF-8 bytes of the text, none for null, plus 1. Null metadata count as
    zero; columns ``source`` and ``lang`` may be absent; others are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    category = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in docs.columns else F.lit(0)  # noqa: E731, E501
    raw = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), category("source").alias("s"), category("lang").alias("l"))  # noqa: E501
    raw = saved(raw.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = _number_equal(raw, ["doc_id", "size", "text_crc32"])
    least = raw.agg(F.min("doc_id")).first()[0] or 0
    doc = F.coalesce(F.try_subtract("doc_id", F.lit(least)).cast("double"), F.col("doc_id").cast("double") - F.lit(float(least)), F.lit(0.0))
    values = (F.col("size"), doc, F.col("s"), F.col("l"))
    spread = lambda i: F.pmod(F.xxhash64("doc_id", "text_crc32", "same_number", F.lit(i)), F.lit(1 << 20)) / float(1 << 20)
    coordinates = [(v.cast("double") + spread(i)).alias(c) for i, (v, c) in enumerate(zip(values, _COORDINATES, strict=True))]
    return saved(rows.select("doc_id", "size", "text_crc32", "same_number", *coordinates), "points")


def _at(dimension: Column) -> Column:
    """The coordinate of the dimension."""
    return F.coalesce(*[F.when(dimension == i, F.col(c)) for i, c in enumerate(_COORDINATES)])


@dataclass
class Median:
    """Where the weighted median of a node lies: in [low, high), with the weight below low; ``closed`` takes in high."""

    node: int
    half: int
    dimension: int
    weight: int
    goal: float
    low: float
    high: float
    below: int = 0
    closed: bool = True
    cut: float = 0.0

    def narrow(self, bin_: int, w: int, n: int, upto: int) -> bool:
        """The bin that holds the median, its weight and rows, and the weight up to its end; True if that will do."""
        edge = lambda b: self.high if b >= BINS else self.low + (self.high - self.low) * b / BINS
        start, end = edge(bin_), edge(bin_ + 1)
        before, after = self.goal - (upto - w), upto - self.goal
        self.cut = start if before <= after else end
        done = min(before, after) <= TOLERANCE * self.weight or n == 1 or start >= end or (start <= self.low and end >= self.high)
        self.below, self.closed = upto - w, self.closed and bin_ == BINS - 1
        self.low, self.high = start, end
        return done


def _table(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    """A row for each node of a level, with its size known to the optimizer."""
    return spark.createDataFrame(pa.table({n: [getattr(r, n) for r in rows] for n in names}))


def _begun(rows: DataFrame, nodes: dict[int, int], extents: list[float]) -> list[Median]:
    """For each of ``nodes`` that has points its widest dimension, and where its median lies: anywhere yet."""
    measures = [f(c).alias(f"{name}_{c}") for c in _COORDINATES for name, f in (("low", F.min), ("high", F.max))]
    out = []
    for r in rows.groupBy("node").agg(F.sum("size").alias("weight"), *measures).collect():
        shards = nodes[r["node"]]
        if shards > 1:
            wide = [(r[f"high_{c}"] - r[f"low_{c}"]) / (x or 1.0) for c, x in zip(_COORDINATES, extents, strict=True)]
            i = wide.index(max(wide))
            half = shards // 2
            out.append(Median(r["node"], half, i, r["weight"], r["weight"] * half / shards, r[f"low_c{i}"], r[f"high_c{i}"]))
    return out


def _holding(rows: DataFrame, state: list[Median]) -> DataFrame:
    """``node, bin, w, n, upto``: of each node the first bin up to whose end the goal is reached."""
    spots = _table(rows.sparkSession, state, ["node", "dimension", "low", "high", "closed", "below", "goal"])
    here = rows.join(spots, "node").withColumn("at", _at(F.col("dimension")))
    here = here.where((F.col("at") >= F.col("low")) & ((F.col("at") < F.col("high")) | (F.col("closed") & (F.col("at") == F.col("high")))))
    width = F.col("high") - F.col("low")
    edge = lambda b: F.when(b >= BINS, F.col("high")).otherwise(F.col("low") + width * b / BINS)
    near = F.least(F.floor((F.col("at") - F.col("low")) / width * BINS), F.lit(BINS - 1))
    here = here.withColumn("near", F.when(width > 0, near).otherwise(0).cast("int"))
    off = F.when(F.col("at") < edge(F.col("near")), -1).when((F.col("at") >= edge(F.col("near") + 1)) & (F.col("near") < BINS - 1), 1).otherwise(0)
    bin_ = F.col("near") + off  # what lies in a bin lies between its edges, also where they are a rounding apart
    sums = here.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("below").alias("below"), F.first("goal").alias("goal"))
    over = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("upto", F.sum("w").over(over) + F.col("below")).where(F.col("upto") >= F.col("goal"))
    return running.groupBy("node").agg(F.min(F.struct("bin", "w", "n", "upto")).alias("hit")).select("node", "hit.*")


def cuts(rows: DataFrame, nodes: dict[int, int], extents: list[float]) -> list[Median]:
    """The cut of every node of a level that has points and becomes several shards; ``rows`` know their node."""
    state = _begun(rows, nodes, extents)
    open_ = {m.node: m for m in state}
    for _ in range(ROUNDS):
        if not open_:
            break
        hits = {r["node"]: r for r in _holding(rows, list(open_.values())).collect()}
        done = [k for k, m in open_.items() if k not in hits or m.narrow(hits[k]["bin"], hits[k]["w"], hits[k]["n"], hits[k]["upto"])]
        for k in done:
            del open_[k]
    return state


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with the number of their shard, 0 to ``shards`` - 1, as ``node``.

    A node has the number of the first shard it will become; its left part keeps it. A
    row for each node of a level reaches the driver, nothing else.
    """
    measures = [f(c).alias(f"{name}_{c}") for c in _COORDINATES for name, f in (("low", F.min), ("high", F.max))]
    whole = rows.agg(*measures).first()
    extents = [(whole[f"high_{c}"] or 0.0) - (whole[f"low_{c}"] or 0.0) for c in _COORDINATES]
    rows, nodes, level = rows.withColumn("node", F.lit(0).cast("long")), {0: shards}, 0
    while max(nodes.values()) > 1:
        found = cuts(rows, nodes, extents)
        if not found:
            break
        split = _table(rows.sparkSession, found, ["node", "half", "dimension", "cut"])
        right = F.coalesce(_at(F.col("dimension")) >= F.col("cut"), F.lit(False))
        moved = rows.join(split, "node", "left").withColumn("node", F.col("node") + F.when(right, F.col("half")).otherwise(0))
        rows, level = moved.drop("half", "dimension", "cut"), level + 1
        if level % LEVELS == 0:
            rows = saved(rows, "placed")
        parts = {k: n for k, n in nodes.items() if n > 1}
        nodes = nodes | {k: n // 2 for k, n in parts.items()} | {k + n // 2: n - n // 2 for k, n in parts.items()}
    return rows


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``shards``, or as many as leave ``target_bytes`` to each. Sizes of shards are near
    equal. Slots number the rows of a shard from 0 without gaps: rows are numbered inside
    buckets of a shard, after the rows of the buckets before. Repeated rows are rows of
    their own; an empty table gives no rows.
    """
    rows = points(docs)
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if shards is None:
        shards = max(1, math.ceil((whole["bytes"] or 0) / target_bytes))
    found = placed(rows, shards).select("doc_id", "size", "text_crc32", "same_number", F.col("node").cast("int").alias("shard"))
    buckets = max(16, math.ceil(whole["n"] / shards / NUMBERED_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "same_number"), F.lit(buckets)).cast("int")
    found = found.withColumn("bucket", bucket)
    sizes = found.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "same_number")
    numbered = found.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
