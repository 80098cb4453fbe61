"""Benchmark decontamination by greedy string tiling with Karp-Rabin seeds.

Texts become numbers of benchmark words. Windows of ``LEAST`` words are hashed with
one polynomial (Karp-Rabin: every window from prefix sums) and joined with the hashed
windows of the benchmark, which finds the few documents and items that share seeds.
For such a pair, seeds on a diagonal grow into maximal matches, and the longest match
is marked again and again, never over marked words; what is left of a match that is
partly marked returns to the queue with its shorter length. Where words repeat so much
that there are many pairs of seeds, the longest width that still matches is searched for
instead, all its tiles are marked, and so on with smaller widths. The share of an item's
words that tiles cover does not depend on the order of its passages.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words (or one longer item), so
the broadcast is bounded. With several blocks each pass over the documents is written
before the next block is read, so one block is alive at a time; a larger benchmark means
more passes, nothing else.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossia.llm.batches import Work, added
from glossia.llm.durable import saved, unused

#: Shortest tile, in words; items with fewer words are never reported.
LEAST = 5
#: Share of an item's words that a document must cover.
MIN_COVERAGE = 0.5
BLOCK_WORDS = 500_000

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
#: Up to so many pairs of equal windows are looked at one by one; more are searched by length.
_PAIRS = 1 << 12


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _spread(ids: np.ndarray) -> np.ndarray:
    values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(31))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of every window of ``width`` ids."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    values = _spread(ids)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for j in range(width):
        out = out * _BASE + values[j : j + len(out)]
    return out


def _runs(pattern: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Maximal matches of at least ``least`` words: pattern start, text start, length in words; None if there are many.

    Equal windows are paired and joined along their diagonals at once.
    """
    mine, theirs = window_hashes(pattern, least), window_hashes(text, least)
    order = np.argsort(mine, kind="stable")
    low, high = np.searchsorted(mine[order], theirs, "left"), np.searchsorted(mine[order], theirs, "right")
    count = high - low
    if count.sum() > _PAIRS:
        return None
    at = np.repeat(np.arange(len(theirs)), count)
    start = order[np.repeat(low, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]
    real = np.ones(len(at), np.bool_)
    for j in range(least):  # hashes may collide
        real &= (pattern[start + j] == text[at + j]) & (text[at + j] >= 0)
    start, at, windows = _along(start[real], at[real], np.ones(int(real.sum()), np.int64))
    return start, at, windows + least - 1


class _Windows:
    """Hashes of the windows of any width of one sequence, from prefix sums, and which of its words are free."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, ids >= 0
        up, down = np.full(len(ids) + 1, _BASE), np.full(len(ids) + 1, _INVERSE)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_spread(ids) * np.cumprod(up)[:-1])))

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of free words start, and their hashes."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[width:] == taken[:-width])
        return at, (self.sums[at + width] - self.sums[at]) * self.down[at]

    def longest(self) -> int:
        """The longest run of free words."""
        edges = np.flatnonzero(np.diff(np.concatenate(([False], self.free, [False]))))
        return int((edges[1::2] - edges[::2]).max(initial=0))


def _by_length(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles by running Karp-Rabin: the longest width at which free windows are equal, all its tiles, then the next.

    Widths are found by halving, as a match of some width has matches of all smaller
    ones in it. Tiles of one width are taken from the left; a window of the text that
    overlaps a tile is never looked at again. So a width takes time in proportion to the
    words, however often they repeat.
    """
    mine, theirs = _Windows(pattern), _Windows(text)
    out, high = [], min(mine.longest(), theirs.longest())
    shared = lambda width: np.isin(mine.of(width)[1], theirs.of(width)[1]).any()
    while high >= least:
        low = least - 1  # the widest known to be shared, or none
        while low < high:
            width = (low + high + 1) // 2
            low, high = (width, high) if shared(width) else (low, width - 1)
        if low < least:
            break
        (at, own), (places, hashes) = mine.of(low), theirs.of(low)
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        some, end, passed = np.flatnonzero(last > first), 0, {}
        for i in some.tolist():
            p = int(at[i])
            if p < end:
                continue
            k = passed.get(first[i], int(first[i]))
            while k < last[i] and not (theirs.free[places[k]] and theirs.free[places[k] + low - 1]):
                k += 1
            passed[first[i]] = k
            while k < last[i]:
                t = int(places[k])
                if theirs.free[t] and theirs.free[t + low - 1] and np.array_equal(pattern[p : p + low], text[t : t + low]):
                    mine.free[p : p + low] = theirs.free[t : t + low] = False
                    out.append((p, t, low))
                    end = p + low
                    break
                k += 1
        high = min(low - 1, mine.longest(), theirs.longest())
    return out


def _along(start: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that continue one another on a diagonal, joined."""
    by = np.lexsort((start, at - start))
    start, at, size = start[by], at[by], size[by]
    if not len(start):
        return start, at, size
    ends = start + size
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at - start) != 0) | (start[1:] != ends[:-1]))))
    return start[first], at[first], np.add.reduceat(size, first)


def tiles(pattern: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(pattern start, text start, length)``, longest first, ties from the left.

    Negative ids match nothing.
    """
    few = _runs(pattern, text, least)
    if few is None:
        return _by_length(pattern, text, least)
    start, at, length = few
    queue = [(-int(n), int(p), int(t)) for n, p, t in zip(length, start, at, strict=True)]
    heapq.heapify(queue)
    in_pattern, in_text = np.zeros(len(pattern), np.bool_), np.zeros(len(text), np.bool_)
    out = []
    while queue:
        n, p, t = heapq.heappop(queue)
        n = -n
        taken = in_pattern[p : p + n] | in_text[t : t + n]
        if not taken.any():
            in_pattern[p : p + n] = in_text[t : t + n] = True
            out.append((p, t, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(queue, (a - b, p + a, t + a))
    return out


class Block:
    """Some benchmark items: their words, their ids, and which item has which seed."""

    def __init__(self, items: list[tuple[int | None, list[str]]], least: int):
        self.least = least
        self.vocab: dict[str, int] = {}
        self.names = [name for name, _ in items]
        self.ids = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in own], np.int64) for _, own in items]
        hashes = [np.unique(window_hashes(x, least)) for x in self.ids]
        seeds = np.concatenate([*hashes, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.known: dict[tuple[int, bytes], int] = {}

    def covered(self, text: str | None) -> Iterator[tuple[int, int]]:
        """Items that share a seed with the text, and how many of their words tiles cover."""
        found = words(text)
        if len(found) < self.least or not len(self.seeds):
            return
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        near = np.zeros(len(ids), np.bool_)
        items: set[int] = set()
        for at in range(0, len(ids), _CHUNK):
            part = ids[at : at + _CHUNK + self.least - 1]
            if len(part) < self.least:
                break
            blank = np.concatenate(([0], np.cumsum(part < 0)))
            whole = np.flatnonzero(blank[self.least :] == blank[: -self.least])
            if not len(whole):
                continue
            hashes = window_hashes(part, self.least)[whole]
            low, high = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
            hit = high > low
            for a, b in set(zip(low[hit].tolist(), high[hit].tolist(), strict=True)):
                items.update(self.owner[a:b].tolist())
            for j in range(self.least):
                near[at + whole[hit] + j] = True
        if not items:
            return
        # only words in seeds can be tiled; a blank stands for what lies between
        keep = near | np.concatenate(([False], near[:-1]))
        passages = np.where(near, ids, -1)[keep]
        for item in sorted(items):
            key = (item, passages.tobytes())
            if key not in self.known:
                if len(self.known) > 5_000:
                    self.known.clear()
                self.known[key] = sum(n for _, _, n in tiles(self.ids[item], passages, self.least))
            yield item, self.known[key]


def blocks(benchmark: DataFrame, least: int, block_words: int) -> Iterator[tuple[Block, bool]]:
    """The benchmark's items, read a block at a time; whether it is the last."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        own = words(row["text"])
        if len(own) < least:
            continue
        if held and size + len(own) > block_words:
            yield Block(held, least), False
            held, size = [], 0
        held.append((row["item_id"], own))
        size += len(own)
    yield Block(held, least), True


def _leaks(shared: Broadcast, min_coverage: float) -> Callable[[], Work]:
    """For each text the items of the block that it leaks: name, covered words, words."""

    def make() -> Work:
        block = shared.value
        least = [min_coverage * len(x) for x in block.ids]
        name = lambda i, n: {"item_id": block.names[i], "covered": n, "words": len(block.ids[i])}
        return lambda texts: [[[name(i, n) for i, n in block.covered(t) if n >= least[i]] for t in texts]]

    return make


_FOUND = "array<struct<item_id: bigint, covered: bigint, words: bigint>>"


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    min_coverage: float = MIN_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, item_id, covered_words, item_words, coverage``: one row per leaked item.

    Words are runs of letters, digits and underscores in the lower-cased text. Null or
    empty texts, on either side, leak nothing; equal items, and repeated documents,
    give a row each; other columns are ignored.
    """
    found = []
    for block, last in blocks(benchmark, least, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = added(docs, F.col("text"), f"found {_FOUND}", _leaks(shared, min_coverage), ["doc_id"]).select("doc_id", F.inline("found"))
        if not last or found:
            rows = saved(rows, "leaks")
            shared.destroy()
        found.append(rows)
    coverage = (F.col("covered") / F.col("words")).alias("coverage")
    return reduce(DataFrame.unionByName, found).select("doc_id", "item_id", F.col("covered").alias("covered_words"), F.col("words").alias("item_words"), coverage)


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    min_coverage: float = MIN_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows of ``docs``, all columns, that leak no item; filtered where they lie, no shuffle."""
    mark, several = unused(docs, "_found"), False
    for block, last in blocks(benchmark, least, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = added(docs, "text", f"`{mark}` {_FOUND}", _leaks(shared, min_coverage)).where(F.size(mark) == 0).drop(mark)
        several |= not last
        if several:
            docs = saved(docs, "clean")
            shared.destroy()
    return docs


def leaked_ids(found: DataFrame) -> DataFrame:
    """Distinct documents of ``overlaps``."""
    return found.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
