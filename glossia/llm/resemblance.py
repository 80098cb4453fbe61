"""Near copies by likeness: word sets of five at a Jaccard similarity of 0.8 or more.

A text stands for its set of 5-word shingles (XXH64), for the set's SimHash and for the
parities of its members by bucket, 512 bits. A member that only one of two sets has turns
one bit, so alike sets, which differ in at most a ninth of their sizes' sum, differ in at
most as many bits: a Hamming test that loses no pair, before whole sets are compared.

First the search of ``simhash``: fingerprints meet under the 24 keys of the ring, keep the
chain's cumulative budgets and differ in at most 3 bits; pairs that are alike are linked.
But at that likeness fingerprints differ in 9.7 +- 2.9 bits, and a ring that loses no pair
would have to allow about 24, where it prunes next to nothing. So sets that the ring left in
different components are searched another way, which makes the result whole.

There candidates share a shingle of their prefixes. Under a common order of all shingles,
two alike sets share one among the first ``n / 5 + 1`` of either, and mostly far
earlier: a prefix ends where the chance that all before it differ is below ``MISS``.
Shingles that are frequent in a sixteenth of the texts come last in the order, so a
common line or passage is seldom in a prefix. The order only decides the work.

Under the ring's keys and then under shingles each set is compared with ``LEADS`` of the sets
that it shares the key with, others for each key. Then, under shingles that still join several
components, sets of different components are compared. So a large group of near copies makes links in
proportion to its size, and the components are those of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossia.llm.batches import Work, added
from glossia.llm.durable import saved
from glossia.llm.graph import components
from glossia.llm.simhash import fingerprint_of, kept_rows, ring_keys, ring_test, row_key, shingle_hashes

SHINGLE_WORDS = 5
#: Chance for each alike pair that it shares no prefix shingle.
MISS = 1e-9
LEADS = 3
#: One text in so many is counted for the order, and how often a shingle is frequent there.
SAMPLE, FREQUENT, MOST = 16, 4, 50_000
#: Words of 64 bits in the map of texts to compare: 1 MB, whatever the input.
_MAP = 1 << 17


def _set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def _prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first members of a set, as many as two alike sets need to meet.

    At most a fifth of the members are not shared. If all of them are among the rare
    ones, each of the first is one of them with chance ``n / 5 / rare``.
    """
    n = rare = len(own)
    if not n:
        return own
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        seen = np.where(frequent[at] == own, counts[at], 0)
        own, rare = own[np.lexsort((own, seen))], int((seen == 0).sum())
    size = n - (4 * n + 4) // 5 + 1
    if rare > n / 5:
        size = min(size, math.ceil(math.log(MISS) / math.log(n / 5 / rare)))
    return own[:size]


def _parity(own: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the members in its bucket."""
    odd = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _tkey():
    return F.md5(F.coalesce("text", F.lit(""))).alias("tkey")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of the sample, ascending, and their counts; at most ``MOST``."""

    def make() -> Work:
        return lambda texts: [[_set(t).view(np.int64) for t in texts]]

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    tokens = added(sample, F.col("text"), "tokens array<long>", make, []).select(F.explode("tokens").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "token").limit(MOST).collect()
    tokens = np.array([r.token for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r.n for r in top], np.int64)[order]


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, skey, n, fp, parity, prefix``: skey hashes the whole set of n shingles, fp is its SimHash."""
    frequent, counts = _frequent(docs)

    def make() -> Work:
        def work(texts: list) -> list:
            own = [_set(t) for t in texts]
            skey = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in own], np.uint64).view(np.int64)
            prefix = [_prefix(s, frequent, counts).view(np.int64) for s in own]
            fp = np.array([fingerprint_of(s) for s in own], np.uint64).view(np.int64)
            return [skey, np.array([len(s) for s in own], np.int32), fp, [_parity(s) for s in own], prefix]

        return work

    return added(docs, F.col("text"), "skey long, n int, fp long, parity array<long>, prefix array<long>", make, ["doc_id", _tkey()])


def _shingles(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``skey, n, shingles`` of all sets of the ``pairs (a, b)``, from one text each.

    A map of bits, of one size for any input, lets few other texts into the join.
    """
    skeys = pairs.select(F.explode(F.array("a", "b")).alias("skey")).distinct()
    wanted = classes.join(skeys, "skey", "left_semi").select("skey", row_key(F.col("first.doc_id"), F.col("first.tkey")).alias("k"))
    wanted = saved(wanted, "wanted")
    word = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(_MAP))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64({c}) & 63 as int))")
    bits = wanted.select(word("k").alias("w"), bit("k").alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    rows = docs.select(row_key(F.col("doc_id"), _tkey()).alias("row"), "text")
    may = rows.join(F.broadcast(bits), word("row") == F.col("w")).where(F.col("bits").bitwiseAND(bit("row")) != 0)
    some = may.select("row", "text").join(wanted, F.col("row") == F.col("k"))
    some = some.groupBy("skey").agg(F.first("text").alias("text"))

    def make() -> Work:
        return lambda texts: [[_set(t).view(np.int64) for t in texts]]

    return saved(added(some, F.col("text"), "shingles array<long>", make, ["skey"]).select("skey", F.size("shingles").alias("n"), "shingles"), "shingles")


def _alike(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of ``(a, b)`` whose sets have the likeness, by whole sets."""
    side = lambda key: shingles.select(F.col("skey").alias(key), F.col("n").alias(f"{key}_n"), F.col("shingles").alias(f"{key}_shingles"))
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    full = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return full.where(both * 5 >= (F.col("a_n") + F.col("b_n") - both) * 4).select("a", "b")


#: How many parity bits differ, and that neither they nor the sizes rule the likeness out.
_TURNED = " + ".join(f"bit_count(x.parity[{i}] ^ y.parity[{i}])" for i in range(8))
_CLOSE = f"x.n * 5 >= y.n * 4 and y.n * 5 >= x.n * 4 and ({_TURNED}) * 9 <= x.n + y.n"


def _near(pairs: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` of rows ``x`` and ``y``, saved."""
    return saved(pairs.select(F.least("x.skey", "y.skey").alias("a"), F.greatest("x.skey", "y.skey").alias("b")).distinct(), "near")


def _shared(classes: DataFrame, keys, *about: str) -> DataFrame:
    """``token, skey`` and columns of the sets by those of their ``keys`` that another set has too; saved."""
    keyed = classes.select("skey", F.explode(keys).alias("token"))
    shared = keyed.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token")
    return saved(keyed.join(shared, "token").join(classes.select("skey", *about), "skey"), "members")


def _led(members: DataFrame, test: str) -> DataFrame:
    """Close pairs of a set and a lead of a token that both have, and that meet the test."""
    about = [c for c in members.columns if c != "token"]
    chances = [F.struct(F.xxhash64("skey", "token", F.lit(i)).alias("chance"), *about) for i in range(LEADS)]
    leads = members.groupBy("token").agg(*[F.min(c).alias(f"lead{i}") for i, c in enumerate(chances)])
    leads = leads.select("token", F.explode(F.array_distinct(F.array(*[F.struct(*[f"lead{i}.{c}" for c in about]) for i in range(LEADS)]))).alias("lead")).select("token", "lead.*")
    return _near(members.alias("x").join(leads.alias("y"), F.expr(f"x.token = y.token and x.skey <> y.skey and {test} and {_CLOSE}")))


def by_ring(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, root`` of the sets that the ring of their fingerprints links to a set that is like them."""
    near = _led(_shared(classes, ring_keys(F.col("fp")), "n", "fp", "parity"), ring_test("token"))
    return saved(components(_alike(near, _shingles(docs, classes, near)), "a", "b"), "components")


def roots(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, root`` of the sets that are like another one.

    ``classes``: skey, first, n, fp, parity, prefix; a row for each set.
    """
    members = _shared(classes, F.col("prefix"), "n", "parity")

    def placed(known: DataFrame) -> DataFrame:
        """Members under the tokens that join several components."""
        own = members.join(known.withColumnRenamed("node", "skey"), "skey", "left").withColumn("root", F.coalesce("root", "skey"))
        mixed = own.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
        return saved(own.join(mixed.select("token"), "token").select("token", "skey", "n", "parity", "root"), "mixed")

    def joined(known: DataFrame, near: DataFrame) -> DataFrame:
        stars = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return saved(components(stars.unionByName(_alike(near, _shingles(docs, classes, near))), "a", "b"), "components")

    known = by_ring(docs, classes)
    known = joined(known, _led(placed(known), "x.root <> y.root"))
    apart = placed(known)
    return joined(known, _near(apart.alias("x").join(apart.alias("y"), F.expr(f"x.token = y.token and x.skey < y.skey and x.root <> y.root and {_CLOSE}"))))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``.

    Groups are components of pairs that are alike. The row of the smallest doc_id stays
    (null ids last), and of rows that agree in doc_id and text the first in the order of
    all their columns. Texts without words, null ones too, are one group.
    """
    rows = saved(sets(docs), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("first")
    same = [F.first(c).alias(c) for c in ("n", "fp", "parity", "prefix")]
    classes = saved(rows.groupBy("skey").agg(first, *same), "classes")
    found = roots(docs, classes).withColumnRenamed("node", "skey")
    best = classes.select("skey", "first").join(found, "skey", "left").groupBy(F.coalesce("root", "skey")).agg(F.min("first").alias("keeper"))
    return kept_rows(docs, best.select("keeper.doc_id", "keeper.tkey"))
