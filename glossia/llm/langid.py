"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed bigrams and trigrams by language in one distributed pass;
the log-probability matrix (languages x buckets, float32) is all that is broadcast.
Its size is fixed by ``BUCKETS`` and checked against ``MAX_LANGUAGES``. Scoring
hashes many texts at once, gathers the matrix rows of the n-grams that occur and adds
them up by text, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossia.llm.batches import ROWS, Work, added, frame, give_back, turn_to
from glossia.llm.durable import unused

BUCKETS = 1 << 15
#: Languages that a model may have; more is an error, as the matrix is broadcast.
MAX_LANGUAGES = 500
#: Bound of the training sample: about so many labelled documents of each language.
MAX_TRAINING_DOCS = 5_000
UNKNOWN = "und"
#: In the pipeline, texts below this posterior are rejected.
MIN_SCORE = 0.5

_BATCH_CHARS = 1 << 19
_BATCH_TEXTS = 1000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start positions and buckets of the bigrams, then of the trigrams.

    Other characters count as one blank. A bigram needs a letter, a trigram needs one
    in its first two characters, so with two blanks between texts none is counted
    that spans two texts.
    """
    letter = _letters()[codes]
    code = np.where(letter, codes, 32).astype(np.uint32)
    pair = letter[:-1] | letter[1:]
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    at2, at3 = np.flatnonzero(pair), np.flatnonzero(pair[:-1])
    spread = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    return at2, spread(two[at2]), at3, spread(three[at3])


def _pieces(text: str) -> Iterator[str]:
    """The lower-cased text in pieces; two blanks end it, two characters overlap."""
    text = text.lower() + "  "
    for at in range(0, max(1, len(text) - 2), _BATCH_CHARS):
        yield text[at : at + _BATCH_CHARS + 2]


def _batches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many pieces, where each piece starts, and the text it is of."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size > _BATCH_CHARS:
                yield _joined(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _joined(held, owner)


def _joined(held: list[str], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    return _codes("".join(held) + "  "), np.cumsum(lengths) - lengths, np.array(owner)


def _in_piece(at: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Drops what starts in a piece's last two characters: blanks, or the next piece's."""
    ends = np.append(starts[1:], total) - 2
    return at < ends[np.searchsorted(starts, at, "right") - 1]


def counts(texts: list[str]) -> np.ndarray:
    """n-grams of all the texts by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for codes, starts, _ in _batches(texts):
        for at, bucket in zip(*[iter(_grams(codes))] * 2, strict=True):
            out += np.bincount(bucket[_in_piece(at, starts, len(codes) - 2)], minlength=BUCKETS)
    return out


def score(texts: list[str], weights: np.ndarray, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the best class, its posterior, and whether there was any letter."""
    sums = np.tile(priors.astype(np.float64), (len(texts), 1))
    found = np.zeros(len(texts), np.bool_)
    for codes, starts, owner in _batches(texts):
        for at, bucket in zip(*[iter(_grams(codes))] * 2, strict=True):
            inside = _in_piece(at, starts, len(codes) - 2)
            at, bucket = at[inside], bucket[inside]
            if not len(at):
                continue
            piece = np.searchsorted(starts, at, "right") - 1
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            np.add.at(sums, owner[piece[first]], np.add.reduceat(weights[bucket], first, axis=0, dtype=np.float64))
            found[owner[piece[first]]] = True
    best = sums.argmax(axis=1)
    posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return best, posterior, found


def held_out() -> F.Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Languages in order, log priors, and log probabilities by bucket and language."""

    def __init__(self, languages: list[str], priors: np.ndarray, weights: np.ndarray):
        self.languages, self.priors, self.weights = languages, priors, weights


def fit(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Learn from ``text`` and ``lang`` of the labelled rows that aren't held out.

    All labelled rows are counted for the priors. n-grams are counted over a sample of
    about ``max_docs`` rows of each language, chosen by a hash of doc_id; a language
    with fewer is used whole. Null and empty texts teach nothing. A table without any
    usable row gives a model without languages.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model would outgrow its broadcast")
    languages = [r["lang"] for r in sizes]
    totals = np.array([r["count"] for r in sizes], np.float64)
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    sample = rows.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(__name__)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                texts: dict[str, list[str]] = {}
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    sums[lang] = sums.get(lang, 0) + counts(own)
        rows = [(lang, int(b), int(values[b])) for lang, values in sums.items() for b in np.flatnonzero(values)]
        yield frame(rows, "lang string, bucket int, n long")
        give_back()

    found = (
        sample.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most languages x buckets rows
    )
    matrix = np.ones((BUCKETS, len(languages)))  # add-one smoothing
    np.add.at(matrix, (found["bucket"].to_numpy(), found["lang"].map(languages.index).to_numpy(np.int64)), found["n"].to_numpy())
    weights = np.log(matrix / matrix.sum(axis=0)).astype(np.float32)
    return Model(languages, np.log(totals / totals.sum()), weights)


def predict(docs: DataFrame, model: Model, keep: Sequence[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of every row plus the language and its posterior, called ``names``.

    Only the text is looked at. A null text, one without any letter, or a model
    without languages gives ``und`` with score 0; the row count never changes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.priors, model.weights))

    def make() -> Work:
        languages, priors, weights = shared.value
        labels = np.array([*languages, UNKNOWN], object)

        def work(texts: list) -> list:
            if not languages:
                return [[UNKNOWN] * len(texts), np.zeros(len(texts))]
            out = []
            for at in range(0, len(texts), _BATCH_TEXTS):
                best, posterior, found = score([t or "" for t in texts[at : at + _BATCH_TEXTS]], weights, priors)
                out.append((labels[np.where(found, best, len(languages))], np.where(found, posterior, 0.0)))
            return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], []]

        return work

    return added(docs, "text", f"`{names[0]}` string, `{names[1]}` double", make, keep)


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Null texts and those without letters are ``und`` with score 0, a null doc_id is never
    held out, repeated rows have a row each, other columns are ignored.
    """
    out = predict(docs, fit(docs), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows whose language is known with at least even odds, all columns as they were."""
    lang, odds = unused(docs, "_lang"), unused(docs, "_score")
    out = predict(docs, fit(docs), keep=["*"], names=(lang, odds))
    return out.where((F.col(lang) != UNKNOWN) & (F.col(odds) >= MIN_SCORE)).drop(lang, odds)
