"""Merkle manifest of a corpus: a trie over exact ranks, and a proof for every document.

A leaf is the digest of a document. The leaves of a source stand in order of doc_id;
every ``FANOUT`` consecutive nodes (the last run may be shorter) become one, until one is
left, the source's subroot. Subroots, in order of source, become the root the same way.

Ranks come without a global sort. Keys are strings of hexadecimal digits; a histogram of
their first digits counts the keys of every prefix, running sums among the prefixes under
one parent say how many keys come before, and prefixes that hold more than ``BUCKET`` keys
are split by their next digits, past what all their keys have in common. A hot source is
many prefixes, and no task sorts more than a bucket.

The digits of a rank in base ``FANOUT`` are its place in the trie, and a node's parent is
its key without the last digit. Nodes are reduced longest key first, ``BLOCK_LEVELS``
levels at a time: a block holds the nodes that agree in all digits but the last
``BLOCK_LEVELS``, so it is bounded whatever the source's size. On the way down each block
is given the siblings on the way from it to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossia.llm.batches import frame
from glossia.llm.durable import saved

FANOUT = 3
#: Levels of the trie that are reduced together; a block has FANOUT ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 6
#: Keys of a prefix that are put in order in one task.
BUCKET = 512
#: Digits by which a prefix is split at most in one round.
DIGITS = 3
_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, height int, rank long, digest string"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document: each column as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    values = [F.col(c) for c in _COLUMNS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*map(_field, values)), 256)


def _ordered(number: Column) -> Column:
    """Hexadecimal digits that sort as the long does, null first."""
    return F.concat(F.when(number.isNull(), "0").otherwise("1"), F.lpad(F.coalesce(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), F.lit("")), 16, "0"))


def _alike(low: Column, high: Column) -> Column:
    """How many first characters two strings have in common."""
    size = F.least(F.length(low), F.length(high))
    same = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1)))
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, size).otherwise(first - 1)


def ranked(rows: DataFrame, group: str, key: Column) -> DataFrame:
    """``rows`` with ``rank``: how many rows of the group have a smaller key.

    ``key``: strings that differ inside a group, none of them empty; ``group`` is never null.
    """
    names = rows.columns
    rows = rows.withColumn("_prefix", F.lit(""))
    summary = (F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
    nodes = rows.groupBy(group, "_prefix").agg(*summary).withColumn("_before", F.lit(0).cast("long"))
    digits = F.least(F.greatest(F.ceil(F.log(F.col("_n") / BUCKET) / F.log(F.lit(16.0))), F.lit(1)), F.lit(DIGITS)).cast("int")
    large = (F.col("_n") > BUCKET) & (F.col("_low") != F.col("_high"))
    ready = []
    while True:
        nodes = saved(nodes.select(group, "_prefix", "_before", F.when(large, _alike(F.col("_low"), F.col("_high")) + digits).alias("_depth")), "histogram")
        met = saved(rows.join(nodes, [group, "_prefix"]), "prefixes")
        ready.append(met.where("_depth is null").drop("_depth"))
        if nodes.where("_depth is not null").isEmpty():
            break
        rows = met.where("_depth is not null").withColumnRenamed("_prefix", "_above").withColumn("_prefix", F.substr(key, F.lit(1), F.col("_depth")))
        histogram = rows.groupBy(group, "_above", "_prefix").agg(*summary, F.first("_before").alias("_start"))
        past = Window.partitionBy(group, "_above").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        nodes = histogram.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(past), F.lit(0)))
        rows = rows.select(*names, "_prefix")
    inside = Window.partitionBy(group, "_prefix").orderBy(key)
    return reduce(DataFrame.unionByName, ready).select(*names, (F.col("_before") + F.row_number().over(inside) - 1).cast("long").alias("rank"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree with n leaves."""
    powers = F.array(*[F.lit(FANOUT**i).cast("long") for i in range(64) if FANOUT**i < 1 << 63])
    return F.size(F.filter(powers, lambda p: p < n))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (tree, block) after the other; they come sorted."""
    held: list[dict] = []
    for batch in batches:
        for _, rows in groupby(batch.to_pylist(), key=lambda r: (r["tree"], r["block"])):
            found = list(rows)
            if held and (held[0]["tree"], held[0]["block"]) != (found[0]["tree"], found[0]["block"]):
                yield held
                held = []
            held += found
    if held:
        yield held


def _in_blocks(nodes: DataFrame, run: Callable, schema: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(run, schema)


def _block() -> Column:
    return F.floor(F.col("rank") / F.lit(FANOUT**BLOCK_LEVELS)).cast("long")


def _reduced(nodes: list[str], levels: int) -> Iterator[list[str]]:
    """The nodes, and those of each level above them; ``nodes`` are a block's in order, so i's parent is i // FANOUT."""
    yield nodes
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        yield nodes


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes, each ``BLOCK_LEVELS`` levels above the one before; the last has one node a tree.

    ``nodes``: saved ``tree, height, rank, digest`` of the leaves, and columns that stay behind.
    """
    tallest = nodes.agg(F.max("height")).first()[0] or 0
    tables = [nodes]
    for base in range(0, max(tallest, 1), BLOCK_LEVELS):

        def up(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            out = []
            for rows in _blocks(batches):
                levels = min(BLOCK_LEVELS, max(0, rows[0]["height"] - base))
                *_, top = _reduced([r["digest"] for r in rows], levels)
                out.append((rows[0]["tree"], rows[0]["height"], rows[0]["block"], top[0]))
                if len(out) >= 1000:
                    yield frame(out, _NODE)
                    out = []
            yield frame(out, _NODE)

        blocks = tables[-1].select("tree", "height", "rank", "digest", _block().alias("block"))
        tables.append(saved(_in_blocks(blocks, up, _NODE), "nodes"))
    return tables


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """On each level the digests left and right of the node in its run."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])))
        at //= FANOUT
    return out


def _packed(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{a}.{b}" for a, b in path)


def _unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split(".")) for level in path.split(",")] if path else []


def folded(own: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and the siblings on its way give."""
    for before, after in path:
        own = digest(before + own + after)
    return own


def _down(tables: list[DataFrame], tops: DataFrame, carried: str, finish: Callable, schema: str) -> DataFrame:
    """Hand the siblings above each block down to the leaves of the trees.

    ``tops``: ``tree, path, subroot, root`` of each tree, where path has the siblings from
    its last node to the root. ``finish(rows, levels, above, top)`` gives the result's
    rows of a block of leaves, which have the columns ``carried`` too.
    """
    plain, more = "tree string, block long, path string, subroot string, root string", [c.split()[0] for c in carried.split(", ")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for at in range(len(tables) - 2, -1, -1):
        base, last = at * BLOCK_LEVELS, at == 0

        def run(batches: Iterator[pa.RecordBatch], base: int = base, last: bool = last) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for top, *rows in _blocks(batches):
                levels = list(_reduced([r["digest"] for r in rows], min(BLOCK_LEVELS, max(0, rows[0]["height"] - base))))
                far = _unpacked(top["path"])
                if last:
                    out += finish(rows, levels, far, top)
                else:
                    for i, r in enumerate(rows):
                        out.append((r["tree"], r["rank"], _packed(_siblings(levels, i) + far), top["subroot"], top["root"]))
                if len(out) >= 2000:
                    yield frame(out, schema if last else plain)
                    out = []
            yield frame(out, schema if last else plain)

        nodes = tables[at].select("tree", "height", "rank", "digest", _block().alias("block"), *(more if last else []))
        paths = above.select("tree", "block", "path", "subroot", "root", F.lit(-1).cast("long").alias("rank"))
        above = _in_blocks(nodes.unionByName(paths, allowMissingColumns=True), run, schema if last else plain)
        above = above if last else saved(above, "paths")
    return above


def _trees(docs: DataFrame, presented: Column | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node tables of the sources' trees and of the tree of their subroots."""
    other = F.lit(None).cast("string") if presented is None else F.when(~F.col("text").eqNullSafe(presented), leaf(presented))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf().alias("digest"), other.alias("presented"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    key = F.concat(_ordered(F.col("doc_id")), F.col("digest"), _ordered(F.col("row")))
    heights = rows.groupBy("tree").agg(_height(F.count("*")).alias("height"))
    leaves = ranked(rows, "tree", key).join(heights, "tree")
    tables = climbed(saved(leaves.select("tree", "height", "rank", "digest", "doc_id", "presented"), "ranked"))
    roots = tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    number = F.lit(roots.count())
    roots = ranked(saved(roots, "subroots"), "tree", F.concat(F.lit("1"), F.hex("source"))).withColumn("height", _height(number))
    return tables, climbed(saved(roots, "sources"))


def _source(tree: Column) -> Column:
    return F.when(tree != "", F.substr(tree, F.lit(2)))


def manifest(docs: DataFrame) -> DataFrame:
    """``source, level, rank, digest``: the stored nodes, a table to keep beside the corpus.

    Level 0 has all leaves, then every ``BLOCK_LEVELS``-th level, and last the subroot at
    the tree's height; the root is in the row of source null, level -1.
    """
    tables, sources = _trees(docs, None)
    level = lambda i: F.least(F.col("height"), F.lit(i * BLOCK_LEVELS)).alias("level")
    parts = [t.select(_source(F.col("tree")).alias("source"), level(i), "rank", "digest") for i, t in enumerate(tables)]
    root = sources[-1].select(F.lit(None).cast("string").alias("source"), F.lit(-1).alias("level"), "rank", "digest")
    return reduce(DataFrame.unionByName, [*parts, root]).distinct()


def proved(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``presented``: the text that is shown in place of ``text`` when the row is verified;
    its leaf is folded with the original siblings, and ``verified`` says whether that gives
    the root. The proof's digest is that of all siblings, level by level from the leaf,
    left to right.

    Null columns have a mark of their own, so null and empty texts differ. Null doc_ids come
    first; rows that share a doc_id stand in order of their leaf, equal rows are leaves of
    their own. Null is a source of its own and the first. Other columns are ignored; an
    empty table gives no rows.
    """
    tables, sources = _trees(docs, presented)
    root = sources[-1].select("tree", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def name_path(rows: list[dict], levels: list, far: list, top: dict) -> list[tuple]:
        return [(r["source"], _packed(_siblings(levels, i) + far), r["digest"], top["root"]) for i, r in enumerate(rows)]

    tops = saved(_down(sources, root, "source string", name_path, "tree string, path string, subroot string, root string"), "tops")

    def prove(rows: list[dict], levels: list, far: list, top: dict) -> list[tuple]:
        rest = "".join(a + b for a, b in far)
        known: dict[str, str] = {}
        out = []
        for i, r in enumerate(rows):
            near = _siblings(levels, i)
            block = folded(r["presented"] or r["digest"], near)
            if block not in known:
                known[block] = folded(block, far)
            proof = digest("".join(a + b for a, b in near) + rest)
            out.append((r["doc_id"], r["digest"], top["subroot"], top["root"], proof, known[block]))
        return out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    found = _down(tables, tops, "doc_id long, presented string", prove, schema)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
