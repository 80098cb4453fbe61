"""Near copies by exact 5-word likeness, against all pairs."""

import random

import pytest

pytest.importorskip("xxhash")

from glossia.llm import resemblance, simhash  # noqa: E402


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute_keepers(docs):
    """Ids that stay: the smallest of each component of pairs with Jaccard >= 0.8."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * every:
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[b] = a
    return sorted({docs[find(i)][0] for i in range(len(docs))})


def made(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(12)]
    texts = [None, "", "  ", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for _ in range(40):
        own = line + [word() for _ in range(rng.choice([6, 20, 60, 200]))]
        texts.append(" ".join(own))
        for _ in range(rng.randrange(4)):  # chains of edits, about the bound
            own = list(own)
            for _ in range(max(1, len(own) // rng.choice([30, 45, 60]))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_match_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(resemblance, "SAMPLE", 2)
    docs = made(random.Random(seed))
    got = resemblance.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == brute_keepers(docs)


def test_stage_drops_copies_of_more_than_three_bits(spark):
    import corpus_pipeline

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("thegn") for _ in range(6)) for _ in range(120))
    docs = spark.createDataFrame([(5, text, "en"), (66, text + " mail a.b@c.org now", "en"), (7, "other", "en")], "doc_id long, text string, lang string")
    assert (simhash.fingerprint(text) ^ simhash.fingerprint(text + " mail a.b@c.org now")).bit_count() > simhash.MAX_BITS
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [5, 7]


def test_repeated_rows_and_missing_ids(spark):
    rows = [(3, "x y z", "b"), (3, "x y z", "a"), (None, "x y z", "c"), (None, "alone here", "d"), (None, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, resemblance.keep_one(docs).collect()), key=str) == [(3, "x y z", "a"), (4, "", "f"), (None, "alone here", "d")]
    assert resemblance.keep_one(docs.limit(0)).count() == 0


def test_ring_of_fingerprints_links_close_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for i in range(30):
        own = [word() for _ in range(400)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, word()]))]
    bits = [(simhash.fingerprint_of(resemblance._set(a)) ^ simhash.fingerprint_of(resemblance._set(b))).bit_count() for (_, a), (_, b) in zip(docs[::2], docs[1::2], strict=True)]
    close = sum(b <= simhash.MAX_BITS for b in bits)
    assert 0 < close
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    classes = resemblance.sets(rows).selectExpr("*", "struct(false as no_id, doc_id, tkey) as first").drop("doc_id", "tkey")
    assert resemblance.by_ring(rows, classes).count() == 2 * close
    assert resemblance.roots(rows, classes).count() == 60


def test_ring_links_nothing_unlike(spark):
    """Fingerprints within 3 bits of each other, as short sets may have, are no links before whole sets agree."""
    docs = [(1, "a b c d e"), (2, "f g h i j"), (3, ""), (4, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    classes = resemblance.sets(rows).where("doc_id < 4").selectExpr("*", "struct(false as no_id, doc_id, tkey) as first").drop("doc_id", "tkey")
    assert resemblance.by_ring(rows, classes.withColumn("fp", classes.fp * 0)).count() == 0
