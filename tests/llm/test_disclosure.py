"""Terms that give personal data away, where entities are rare or terms far off."""

import random

from glossia.llm import pii

SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(60)}" for _ in range(n))


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def corpus(rng, own):
    texts = own + [prose(rng, 30) for _ in range(300)]
    return list(enumerate(texts))


def test_contexts_inside_one_text_count(spark):
    rng = random.Random(1)
    one = " ".join(f"{prose(rng, 60)} nightjar bob@example.org {prose(rng, 60)}" for _ in range(6))
    clean = texts_of(pii.sanitised(spark.createDataFrame(corpus(rng, [one]), SCHEMA)))
    assert "nightjar" not in clean[0] and clean[0].count("[EMAIL]") == 6


def test_rare_entities_go_by_their_domain(spark):
    rng = random.Random(2)
    own = [f"{prose(rng, 9)} nightjar user{i}@birds.example {prose(rng, 9)}" for i in range(8)] + ["once eve@other.example only"]
    clean = texts_of(pii.sanitised(spark.createDataFrame(corpus(rng, own), SCHEMA)))
    assert all("nightjar" not in clean[i] and "[EMAIL]" in clean[i] for i in range(8))
    assert clean[8] == "once [EMAIL] only"


def test_copies_are_no_evidence(spark):
    rng = random.Random(3)
    own = ["once eve@other.example only"] * 8
    clean = texts_of(pii.sanitised(spark.createDataFrame(corpus(rng, own), SCHEMA)))
    assert all(clean[i] == "once [EMAIL] only" for i in range(8))


def test_terms_are_marked_far_from_the_entity(spark):
    rng = random.Random(4)
    own = [f"{prose(rng, 9)} nightjar bob@example.org {prose(rng, 9)}" for _ in range(6)]
    own.append(f"😀 Nightjar {prose(rng, 200)} bob@example.org {prose(rng, 200)} NIGHTJAR end")
    docs = spark.createDataFrame(corpus(rng, own), SCHEMA)
    clean = texts_of(pii.sanitised(docs))
    assert all("nightjar" not in clean[i].lower() for i in range(7)) and clean[6].startswith("😀 [WORD] w")
    spans = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    assert "term:2:10" in spans[6].split(",")
