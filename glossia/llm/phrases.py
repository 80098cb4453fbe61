"""Collocations: frequent phrases of 2 to 5 words, mined level by level.

One pass over the texts a length. While phrases of k words are counted, a pass also
hashes the phrases of k + 1 words into buckets (PCY, at every level: DHP). A phrase of
k + 1 words can only be frequent if its bucket is, and if its first and its last k words
are frequent phrases (Apriori); what is left is counted exactly, by its words. Buckets
and frequent phrases reach the tasks as bitmaps of at most ``MAX_BUCKETS`` bits. Bitmaps
only rule out: where they are too full to rule out much, more is counted and the result
is the same.

Counts per bucket are capped at the threshold in each task, so a byte holds one: a sum of
capped counts reaches the threshold exactly if the sum of the counts does.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossia.llm.batches import frame, give_back
from glossia.llm.durable import saved

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Buckets: a power of two, one for so many bytes of text, within bounds.
BYTES_A_BUCKET = 128
MIN_BUCKETS, MAX_BUCKETS = 1 << 16, 1 << 24
_CHUNK = 1 << 16
#: Bytes of text of one language that are worked on together; different phrases and words that a task holds.
_TOGETHER = 1 << 21
_HELD = 200_000
_WORDS = 500_000
#: Phrases whose buckets are added up together.
_PLACES = 1 << 21
_BREAK = b"."
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: ASCII capitals become small letters, the separators of pieces one mark, tabs spaces.
_FOLD = bytes(ord("." if chr(i) in ".,;:!?\n\x0b\x0c\r" else " " if i == 9 else chr(i).lower()) if i < 128 else i for i in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Numbers(dict):
    """Numbers of words as they are met; those that ``rare`` says can't be in a phrase are 0, as a break is."""

    def __init__(self, rare: Callable[[int], bool] | None):
        super().__init__({_BREAK: 0})
        self.rare, self.spelt, self.hashes = rare, [_BREAK], [0]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if self.rare is not None and self.rare(h):
            self[word] = 0
            return 0
        self[word] = n = len(self.spelt)
        self.spelt.append(word)
        self.hashes.append(h)
        return n


class Words:
    """The words of one language that a task has met: their numbers, spelling and hashes."""

    def __init__(self, lang: str, bits: np.ndarray | None):
        seed, mask = int(_seed(lang)), 0 if bits is None else len(bits) - 1
        self.number = _Numbers(None if bits is None else lambda h: not bits[_mixed_int(h ^ seed) & mask])
        self.hashes = np.zeros(1, np.uint64)
        self.counts = np.zeros(1, np.int64)

    def count(self, ids: np.ndarray) -> None:
        self.counts = np.concatenate((self.counts, np.zeros(len(self.hashes) - len(self.counts), np.int64)))
        self.counts += np.bincount(ids, minlength=len(self.counts))

    def rows(self, lang: str) -> Iterator[tuple]:
        return ((lang, w, n) for w, n in islice(zip(self.number.spelt, self.counts.tolist(), strict=False), 1, None))

    def read(self, data: bytes) -> np.ndarray:
        """Numbers of the words in order, 0 between pieces."""
        tokens = data.translate(_FOLD).replace(_BREAK, b" . ").split()  # no other white space is left
        found = np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens))
        new = self.number.hashes[len(self.hashes) :]
        self.hashes = np.concatenate((self.hashes, np.array(new, np.uint64)))
        return found


@dataclass
class Known:
    """What the passes before have found: for each length its frequent buckets and its frequent phrases, as bits."""

    buckets: int
    frequent: dict[int, Broadcast]
    full: dict[int, Broadcast]

    def bits(self, of: dict[int, Broadcast], k: int) -> np.ndarray | None:
        return np.unpackbits(np.frombuffer(of[k].value, np.uint8)).view(np.bool_) if k in of else None


def _mixed_int(x: int) -> int:
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return x ^ (x >> 29)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))


def _hashes(words: np.ndarray, lang: str, k: int) -> np.ndarray:
    """A hash of the phrases of k words from every place on, from the hashes of the words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _PRIME + words[j : j + n]
    return _mixed(out ^ _seed(lang))


def _raw(words: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """For lengths up to ``longest`` a number of the phrase from every place on; ``_hashes`` are these, mixed."""
    out = {1: words}
    for k in range(2, longest + 1):
        out[k] = out[k - 1][:-1] * _PRIME + words[k - 1 :]
    return out


def _survivors(raw: dict[int, np.ndarray], whole: np.ndarray, lang: str, k: int, full: np.ndarray | None, frequent: np.ndarray | None) -> np.ndarray:
    """Where a phrase of k words starts that can be frequent: its bucket is full, its first and its last k - 1 words are frequent.

    ``whole``: of each word whether it is one (not a break, not rare).
    """
    if k == 1:
        return np.flatnonzero(whole)
    seed = _seed(lang)

    def of(at: np.ndarray, size: int, bits: np.ndarray | None) -> np.ndarray:
        return at if bits is None else at[bits[(_mixed(raw[size][at] ^ seed) & np.uint64(len(bits) - 1)).astype(np.int64)]]

    inside = whole
    for j in range(1, k - 1):
        inside = inside[:-1] & whole[j:]
    shorter = np.zeros(len(inside), np.bool_)
    shorter[of(np.flatnonzero(inside), k - 1, frequent)] = True
    return of(np.flatnonzero(shorter[:-1] & shorter[1:]), k, full)


def _counted(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases that start at the places ``at``: one place of each, and how often it stands."""
    _, first, inverse, n = np.unique(hashes[at], return_index=True, return_inverse=True, return_counts=True)
    place = at[first]
    if all(np.array_equal(ids[at + j], ids[place + j][inverse]) for j in range(k)):
        return place, n
    rows = np.stack([ids[at + j] for j in range(k)], 1)  # two phrases share a hash
    _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return at[first], n


_EMITTED = "lang string, phrase binary, n long, chunk int, salt int, bucket_counts binary"


def _pass(docs: DataFrame, k: int, known: Known, longest: int, cap: int) -> DataFrame:
    """Counts of phrases of k words that can be frequent, and of the buckets of those one longer; saved.

    Rows are either ``lang, phrase, n`` (phrase null: all words of the language) or
    ``chunk, salt, bucket_counts``.
    """
    buckets = known.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, frequent = known.bits(known.frequent, 1), known.bits(known.frequent, k - 1) if k > 2 else None
        full = known.bits(known.full, k)
        sums = np.zeros(buckets, np.int32) if k < longest else None
        held: Counter = Counter()
        waiting: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        known_words: dict[str, Words] = {}
        places: list[np.ndarray] = []

        def add_up() -> None:
            if places:
                np.add(sums, np.bincount(np.concatenate(places), minlength=buckets), out=sums, casting="unsafe")
                places.clear()

        def work(lang: str) -> None:
            data = _BREAK.join(waiting.pop(lang))
            del size[lang]
            if lang not in known_words:
                known_words[lang] = Words(lang, single)
            words = known_words[lang]
            ids = words.read(data)
            own = words.hashes[ids]
            whole = ids > 0
            if len(ids) < k:
                return
            raw = _raw(own, min(len(ids), k + (sums is not None)))
            at = _survivors(raw, whole, lang, k, full, frequent)
            spelt = words.number.spelt
            if k == 1:
                held[lang, None] += int(whole.sum())
                words.count(ids)
            elif len(at):
                place, n = _counted(ids, at, raw[k], k)
                for row, count in zip(np.stack([ids[place + j] for j in range(k)], 1).tolist(), n.tolist(), strict=True):
                    held[lang, b" ".join([spelt[i] for i in row])] += count
            if sums is not None and len(ids) > k:
                both = at[:-1][np.diff(at) == 1]
                places.append((_mixed(raw[k + 1][both] ^ _seed(lang)) & np.uint64(buckets - 1)).astype(np.int64))
                if sum(map(len, places)) >= _PLACES:
                    add_up()

        def flush() -> pa.RecordBatch:
            rows = [(lang, phrase, n, None, None, None) for (lang, phrase), n in held.items()]
            held.clear()
            if k == 1:
                rows += [(*row, None, None, None) for lang, w in known_words.items() for row in w.rows(lang)]
            known_words.clear()
            return frame(rows, _EMITTED)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for at, end in _text_parts(data):
                    waiting.setdefault(lang, []).append(data[at:end])
                    size[lang] += end - at
                    if size[lang] >= _TOGETHER:
                        work(lang)
                if size.total() > 2 * _TOGETHER:
                    work(size.most_common(1)[0][0])
                if len(held) > _HELD or sum(len(w.number) for w in known_words.values()) > _WORDS:
                    yield flush()
        for lang in list(waiting):
            work(lang)
        yield flush()
        if sums is not None:
            add_up()
            salt = TaskContext.get().partitionId()
            for chunk, packed in _chunks(np.minimum(sums, cap), cap):
                yield frame([(None, None, None, chunk, salt, packed)], _EMITTED)
        give_back()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, F.col("text").cast("string").alias("text")).where("text is not null")
    return saved(rows.mapInArrow(run, _EMITTED), f"pass{k}")


def _text_parts(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of a text that end where a piece does, of about ``_TOGETHER`` bytes where pieces allow."""
    at = 0
    while at < len(data):
        end = min(at + _TOGETHER, len(data))
        if end < len(data):
            found = data.find(b"\n", end), data.find(b".", end), data.find(b",", end)
            end = min((f for f in found if f >= 0), default=len(data))
        yield at, end
        at = end


def _kind(threshold: int) -> str:
    """The least numbers that hold counts up to the threshold."""
    return "<u1" if threshold < 1 << 8 else "<u4"


def _chunks(counts: np.ndarray, threshold: int) -> Iterator[tuple[int, bytes]]:
    """Counts by chunk, those of zeros left out."""
    for c in range(0, len(counts), _CHUNK):
        own = counts[c : c + _CHUNK]
        if own.any():
            yield c // _CHUNK, zlib.compress(own.astype(_kind(threshold)).tobytes(), 1)


def _merged(parts: DataFrame, fold: str, keys: list[str], threshold: int, most: int) -> DataFrame:
    """One row for each of ``keys`` (chunk first), ``most`` in all, from chunks of counters, read as a stream.

    ``fold`` sum: counters capped at the threshold; bits: which of them reach it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, packed in zip(*(batch[c].to_pylist() for c in [*keys, "bucket_counts"]), strict=True):
                own = np.frombuffer(zlib.decompress(packed), _kind(threshold))
                had = held.get(tuple(key))
                held[tuple(key)] = own if had is None else np.minimum(had.astype(np.uint32) + own, threshold).astype(own.dtype)
        for key, sums in held.items():
            out = np.packbits(sums >= threshold).tobytes() if fold == "bits" else zlib.compress(sums.tobytes(), 1)
            yield frame([(*key, out)], schema)

    schema = ", ".join([*(f"{c} int" for c in keys), "bucket_counts binary"])
    return parts.repartition(*keys).coalesce(most).mapInArrow(run, schema)  # no task without a key


def _bitmap(spark: SparkSession, chunks: DataFrame, buckets: int, threshold: int) -> Broadcast:
    """Bits of the buckets that reach the threshold; a bit a bucket reaches the driver.

    Chunks are merged by salt first: no task merges more than the square root of the tasks' chunks.
    """
    salts = max(1, int(chunks.select("salt").distinct().count() ** 0.5))
    some = chunks.select("chunk", (F.col("salt") % salts).alias("salt"), "bucket_counts")
    most = max(1, buckets // _CHUNK)
    once = _merged(some, "sum", ["chunk", "salt"], threshold, most * salts)
    twice = _merged(once.select("chunk", "bucket_counts"), "bits", ["chunk"], threshold, most)
    bits = bytearray(buckets // 8)
    for r in twice.collect():  # one job; an iterator takes one for each partition
        bits[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = r["bucket_counts"]
    return spark.sparkContext.broadcast(bytes(bits))


def _marked(spark: SparkSession, phrases: DataFrame, buckets: int) -> Broadcast:
    """Bits of the buckets of frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(buckets, np.bool_)
        for batch in batches:
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                own = phrase.encode("utf-8", "surrogatepass").split(b" ")
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64)
                bits[int(_hashes(hashes, lang, len(own))[0]) & (buckets - 1)] = True
        for chunk, packed in _chunks(bits, 1):
            yield frame([(chunk, TaskContext.get().partitionId(), packed)], "chunk int, salt int, bucket_counts binary")

    return _bitmap(spark, saved(phrases.select("lang", "phrase").mapInArrow(run, "chunk int, salt int, bucket_counts binary"), "marks"), buckets, 1)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, n`` of all phrases of 1 to ``longest`` words that stand ``min_count`` times or more, and ``lang, words``."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    buckets = min(max(1 << max(size // BYTES_A_BUCKET, 1).bit_length(), MIN_BUCKETS), MAX_BUCKETS)
    known, found, totals = Known(buckets, {}, {}), [], None
    for k in range(1, longest + 1):
        made = _pass(docs, k, known, longest, min_count)
        counts = made.where("chunk is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            totals = saved(made.where("chunk is null and phrase is null").groupBy("lang").agg(F.sum("n").alias("words")), "words")
        own = counts.where((F.col("n") >= min_count) & F.col("phrase").isNotNull())
        own = saved(own.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), "n"), f"frequent{k}")
        found.append(own)
        if k == longest or own.isEmpty():
            break
        known.frequent[k] = _marked(spark, own, buckets)
        chunks = made.where("chunk is not null").select("chunk", "salt", "bucket_counts")
        known.full[k + 1] = _bitmap(spark, chunks, buckets, min_count)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return saved(out, "frequent"), totals


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, n, score`` of phrases of two words or more: of all cuts in two the one that scores least.

    The score of a cut is floor(1000 * a * n / (l * r)), in decimals of 38 digits, which
    are exact as long as a * n stays below 10^35.
    """
    long = frequent.where("k > 1").withColumnRenamed("n", "a")
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda at, n: F.array_join(F.slice(_words(F.col("phrase")), at, n), " ")
    cuts = cuts.select("*", part(F.lit(1), F.col("cut")).alias("_first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_rest"))
    side = lambda key, n: frequent.select("lang", F.col("phrase").alias(key), F.col("n").alias(n))
    cuts = cuts.join(side("_first", "l"), ["lang", "_first"]).join(side("_rest", "r"), ["lang", "_rest"]).join(totals.withColumnRenamed("words", "n"), "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("_top", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("_bottom", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("_top div _bottom"))
    best = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def unabsorbed(found: DataFrame) -> DataFrame:
    """Phrases that stand more often than every longer one in ``found`` that holds their words side by side."""
    parts = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.array_join(F.slice("_w", at, n), " ")),
    ))
    inside = found.where("k > 2").withColumn("_w", _words(F.col("phrase"))).select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("a").alias("_longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    return found.join(most, ["lang", "phrase"], "left").where("_longer is null or 100 * _longer < 100 * a").drop("_longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count and spelling.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces
    into words at spaces and tabs; phrases don't cross pieces. Null texts are empty, a
    null language is ``und``; repeated rows count again; other columns are ignored. No
    frequent phrase, as in an empty table: no rows.
    """
    frequent, totals = frequent_phrases(docs, min_count, longest)
    kept = unabsorbed(saved(scored(frequent, totals), "scored"))
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
