"""Packing of a whole corpus into sequences: large pieces are matched, small ones fill the gaps.

Only lengths decide how well pieces pack, and there are no more lengths than a sequence
has tokens. So the plan is made once, for the whole corpus, from the histogram of lengths:

* of pieces above a third of a sequence at most two fit together; from the longest down,
  each is matched with the longest other one that fits;
* the others, longest first, each go into the sequence with the least room that holds
  them (best fit), or into a new one.

Sequences that were filled alike are one group with a count, so the plan's size follows
from the length of a sequence, not from the corpus: at most two groups are added a length,
and at most 90 different lengths fit in 4,096 tokens. Pieces of a length are numbered by
where they were written, and a number's place in the plan is its sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossia.llm.batches import give_back
from glossia.llm.durable import saved

LENGTH = 4096
END = 1
#: Bounds of what a worker remembers: words, and characters of one.
_REMEMBER = 1_000_000
_LONG_WORD = 64
#: Characters of texts that are encoded together, and of a part of a very long text.
_TOGETHER = 1 << 18
_PART = 1 << 20
_RANK_BITS = 44

#: A word and the punctuation that ends it, where the pre-tokenizer parts them too.
_TAIL = re.compile(r"(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)\Z", re.DOTALL)


class Encoder:
    """Ids of whole texts by a public word-level vocabulary; words seen before are remembered.

    The vocabulary's pre-tokenizer drops white space and never joins what stands on either
    side of it, so texts are cut at spaces and line feeds and a piece has the same ids
    wherever it stands. Texts with the start of a special token are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = {t[:2] for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())}
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(1 + max(vocabulary.values()), np.bool_)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = _Known()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words; those of letters only are encoded as one text and cut where words end."""
        plain = [w for w in words if w.isalpha() and len(w) < _LONG_WORD]
        rest = [w for w in words if not (w.isalpha() and len(w) < _LONG_WORD)]
        out = {}
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            (ids,) = self._ids([" ".join(some)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and len(ids) == cuts[-1]:
                out |= zip(some, map(self._bytes, np.split(ids, cuts[:-1])), strict=True)
            else:  # a letter that is more than a letter once it is folded
                rest += some
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            out |= zip(some, map(self._bytes, self._ids(some)), strict=True)
        return out

    def _taught(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't known, by those of the word and of the punctuation that ends it."""
        ends = {w: (m[1], m[2]) for w in words if (m := _TAIL.match(w))}
        parts = {p for pair in ends.values() for p in pair if p not in self.known} | (words - ends.keys())
        own = self._learn(list(parts))
        of = lambda p: own[p] if p in own else self.known[p]
        return own | {w: of(a) + of(b) for w, (a, b) in ends.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``kind``."""
        found: list[list[bytes | None]] = []
        self.known.missed = missed = []
        for text in texts:
            if any(s in text for s in self.special):
                found.append([self._bytes(self._ids([text])[0])])
            else:
                found.append(list(map(self.known.__getitem__, text.replace("\n", " ").split(" "))))
        if missed:
            own = self._taught(set(missed))
            self.known.update((w, v) for w, v in own.items() if len(w) < _LONG_WORD)
            at = iter(missed)
            for ids in found:
                place = -1
                for _ in range(ids.count(None)):
                    place = ids.index(None, place + 1)
                    ids[place] = own[next(at)]
        if len(self.known) > _REMEMBER:
            self.known.clear()
        return list(map(b"".join, found))


class _Known(dict):
    """Ids of words; a word that isn't there is noted, and has none yet."""

    missed: list[str]

    def __missing__(self, word: str) -> None:
        self.missed.append(word)


def _text_parts(text: str, special: set[str]) -> Iterator[str]:
    """A very long text in parts that end at a space, so that memory doesn't follow its length."""
    at = 0
    if len(text) > _PART and any(s in text for s in special):
        yield text
        return
    while at < len(text):
        end = text.find(" ", at + _PART) if at + _PART < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays for the next tasks."""
    return Encoder(path)


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64()),
])
_PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of ``length`` where there are more; saved.

    ``ids`` are little-endian numbers of 16 bits (32 for a larger vocabulary), ``ids_crc32``
    is the CRC-32 of them as numbers of 32 bits. ``part, nth`` number the pieces of a length:
    the task that wrote them and, inside it, 0, 1, ... in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        size, end = np.dtype(own.kind).itemsize, np.array([END], own.kind).tobytes()
        part, counts = TaskContext.get().partitionId(), defaultdict(int)
        step = length * size

        def rows(names: list, texts: list[str]) -> list[tuple]:
            out = []
            parts = [list(_text_parts(t, own.special)) for t in texts]
            flat = iter(own.encode([p for ps in parts for p in ps]))
            for name, ps in zip(names, parts, strict=True):
                ids = b"".join(next(flat) for _ in ps) + end
                for at in range(0, len(ids), step):
                    cut = ids[at : at + step]
                    n = len(cut) // size
                    crc = zlib.crc32(np.frombuffer(cut, own.kind).astype("<u4").tobytes())
                    out.append((name, at // step, at // size, n, crc, cut, part, counts[n]))
                    counts[n] += 1
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(_PIECES)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        names: list = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                names.append(name)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= _TOGETHER or len(texts) >= 2000:
                    yield batch_of(rows(names, texts))
                    names, texts, held = [], [], 0
        if texts:
            yield batch_of(rows(names, texts))
        give_back()

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE_FIELDS), "pieces")


@dataclass
class Group:
    """``count`` sequences from ``first`` that are filled alike and have ``room`` left."""

    first: int
    count: int
    room: int


@dataclass
class Plan:
    """Runs of the pieces of each length: from which number on, into which sequences, where in them."""

    length: int
    counts: dict[int, int]
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.left = dict(self.counts)
        self.rooms: list[int] = []
        self.groups: dict[int, list[Group]] = {}
        self._match()
        for size in sorted((s for s in self.left if 3 * s <= self.length), reverse=True):
            self._fill(size)
        self.runs.sort()

    def _put(self, size: int, group: Group, each: int) -> None:
        """``each`` pieces of a size into every sequence of a group."""
        if each:
            taken = self.counts[size] - self.left[size]
            self.runs.append((size, taken, group.first, each, self.length - group.room))
            self.left[size] -= each * group.count
            group.room -= each * size

    def _new(self, count: int) -> Group:
        group = Group(self.sequences, count, self.length)
        self.sequences += count
        return group

    def _keep(self, group: Group) -> None:
        if group.count:
            if group.room not in self.groups:
                insort(self.rooms, group.room)
                self.groups[group.room] = []
            self.groups[group.room].append(group)

    def _match(self) -> None:
        """Sequences for the pieces above a third: pairs, longest with longest that fits, and single ones."""
        sizes = sorted(s for s in self.left if 3 * s > self.length)
        for size in reversed(sizes):
            while self.left[size]:
                at = bisect_left(sizes, self.length - size + 1) - 1
                while at >= 0 and (not self.left[sizes[at]] or (sizes[at] == size and self.left[size] < 2)):
                    at -= 1
                if at < 0:
                    group = self._new(self.left[size])
                    self._put(size, group, 1)
                elif sizes[at] == size:
                    group = self._new(self.left[size] // 2)
                    self._put(size, group, 2)
                else:
                    other = sizes[at]
                    group = self._new(min(self.left[size], self.left[other]))
                    self._put(size, group, 1)
                    self._put(other, group, 1)
                self._keep(group)

    def _fill(self, size: int) -> None:
        """Pieces of one size, each where the least room holds it."""
        while self.left[size]:
            at = bisect_left(self.rooms, size)
            if at < len(self.rooms):
                room = self.rooms[at]
                group = self.groups[room].pop()
                if not self.groups[room]:
                    del self.groups[room], self.rooms[at]
            else:
                room = self.length
                group = self._new(-(-self.left[size] // (room // size)))
            each = room // size
            full = min(group.count, self.left[size] // each)
            rest = self.left[size] - full * each if full < group.count else 0
            alike, last = Group(group.first, full, room), Group(group.first + full, int(rest > 0), room)
            untouched = Group(group.first + full + last.count, group.count - full - last.count, room)
            if alike.count:
                self._put(size, alike, each)
            if last.count:
                self._put(size, last, rest)
            for g in (alike, last, untouched):
                self._keep(g)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Of each run, sorted: its length with its first number as one key, first number, first sequence, how many a sequence, offset."""
        table = np.array(self.runs, np.int64).reshape(-1, 5)
        return (table[:, 0] << _RANK_BITS) | table[:, 1], *table.T[1:]


def packed(spark: SparkSession, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``: where each piece stands.

    Numbers 0, 1, ... of the pieces of a length: those of the tasks before, then inside
    the task. The histogram that reaches the driver has a row a length.
    """
    by_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    past = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before")), "lengths")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(length, counts).arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, each, offset = plan.value
        for batch in batches:
            size, nth = (batch[c].to_numpy() for c in ("length", "_nth"))
            at = np.searchsorted(keys, size << _RANK_BITS | nth, "right") - 1
            since = nth - first[at]
            added = [pa.array(sequence[at] + since // each[at]), pa.array(offset[at] + since % each[at] * size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*batch.schema.names[:-1], "sequence_id", "offset"])

    names = [c for c in found.columns if c not in ("part", "nth")]
    numbered = found.join(before.drop("n"), ["length", "part"]).select(*names, (F.col("before") + F.col("nth")).alias("_nth"))
    schema = numbered.drop("_nth").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids, cu_seqlens``: the packed sequences, pieces in order of their offset.

    ``ids`` as in ``pieces``; ``cu_seqlens`` has 0 and the end of each piece.
    """
    item = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(item.alias("_p"))
    # concat of an array of binaries in order; a sequence has 4,096 pieces at most
    joined = F.aggregate("_p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    ends = F.transform("_p", lambda x: (x["offset"] + x["length"]).cast("int"))
    return whole.select("sequence_id", joined.alias("ids"), F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"))


def pack(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces of ``docs``.

    A null text is an empty one: the end id alone. Rows that repeat, or have a null doc_id,
    are documents of their own; other columns are ignored; an empty table gives no rows.
    Whole texts of any length are packed; only those above ``length`` ids are cut.
    """
    import public_tokenizers

    found = pieces(docs, public_tokenizers.path("word_bpe_49k.json"), length)
    return packed(spark, found.drop("ids"), length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
