"""Ids and columns that pass unchanged, bounds that change nothing, and brute force beside them."""

import hashlib
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("glossia.llm")

from glossia.llm import bpe, decontam, langid, packing, pii, resemblance, rollup, simhash, sketch, warc  # noqa: E402
from glossia.llm.durable import new_dir  # noqa: E402

BIG = 9007199254740993
CLASH = "k_text string, k_row long, extra string, _key string, _at long, _text string, _lang string, _score double, _found long, _marks long, many array<struct<x: long>>"


def docs_of(spark, texts=("alpha beta gamma delta epsilon zeta", None, "write to bob@x.org now", "alpha beta gamma delta epsilon zeta")):
    rows = [((BIG + 2 * i if i != 1 else None), t, "en", BIG, None, "a", 1, "b", "c", 2, "d", "e", 0.5, 3, 4, [(BIG,), (None,)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, n_chars long, source string, {CLASH}").coalesce(1)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_large_ids_beside_nulls(spark):
    docs = docs_of(spark)
    want = sorted([BIG, None, BIG + 4, BIG + 6], key=str)
    assert ids(simhash.near_duplicates(docs)) == want
    assert ids(langid.identified(docs)) == want
    assert ids(bpe.encoded(docs, bpe.default_vocabulary(), ["doc_id"], ids=False)) == want
    assert ids(sketch.edited(docs, size=1)) == want
    assert ids(packing.packed(spark, docs)) == want
    assert ids(pii.found(docs)) == want
    pages = docs.selectExpr("doc_id as page_id", "cast(null as string) as url", "concat(text, repeat('y', 200)) as html")
    back = {(r.page_id, r.refers_to) for r in warc.archived(spark, pages).collect()}
    assert back == {(BIG, None), (None, None), (BIG + 4, None), (BIG + 6, BIG)}
    bench = spark.createDataFrame([(BIG, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()) == [(BIG, BIG), (BIG + 6, BIG)]


@pytest.mark.parametrize("stage", ["language", "fingerprints", "near", "leaks", "personal"])
def test_stages_keep_columns_that_clash(spark, stage):
    docs = docs_of(spark)
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    run = {
        "language": lambda d: langid.keep_identified(d), "fingerprints": simhash.keep_one, "near": resemblance.keep_one,
        "leaks": lambda d: decontam.keep_clean(d, bench), "personal": pii.sanitised,
    }[stage]
    got = run(docs)
    assert got.dtypes == docs.dtypes
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    kept = [r.asDict() for r in got.collect()]
    want = {"language": {BIG, BIG + 4, BIG + 6}, "fingerprints": {BIG, None, BIG + 4}, "near": {BIG, None, BIG + 4}, "leaks": {None, BIG + 4}, "personal": set(before)}
    assert {r["doc_id"] for r in kept} == want[stage] and len(kept) == len(want[stage])
    for r in kept:
        if stage == "personal" and r["doc_id"] == BIG + 4:
            assert (r.pop("text"), r.pop("n_chars")) == ("write to [EMAIL] now", 20)
        assert all(before[r["doc_id"]][c] == v for c, v in r.items())
    assert run(docs.limit(0)).count() == 0


def test_naive_bayes_is_that_of_the_definition(spark):
    """Log priors and add-one smoothed log probabilities of hashed n-grams, in plain Python."""
    rng = random.Random(1)
    say = {"en": "the and ing tion of was", "fr": "les que éau ment oui dans", "de": "der und ich sch nicht über"}
    rows = [(i, " ".join(rng.choice(say[k].split()) for _ in range(rng.randrange(1, 6))), k) for i in range(120) for k in [rng.choice(list(say))]]
    docs = spark.createDataFrame([*rows, (500, "the über, les-mots 12", None)], "doc_id long, text string, lang string")
    m32 = (1 << 32) - 1

    def grams(text):
        own = [ord(c) if c.isalpha() else 32 for c in text.lower() + "  "]
        for i in range(len(own) - 2):
            a, b, c = own[i : i + 3]
            if a == b == 32:
                continue
            two = (a * 0x9E3779B1 + b * 0x85EBCA77) & m32
            three = (two * 0xC2B2AE3D + c * 0x27D4EB2F + 1) & m32
            for x in (two, three):
                yield ((x ^ x >> 15) * 0x2C1B3C6D & m32) >> (32 - langid.BUCKETS.bit_length() + 1)

    import zlib

    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {k: Counter(g for _, t, lang in learnt if lang == k for g in grams(t)) for k in say}
    prior = Counter(lang for _, _, lang in learnt)
    for r in langid.identified(docs).collect():
        text = next(t for i, t, *_ in [*rows, (500, "the über, les-mots 12")] if i == r.doc_id)
        logs = {k: math.log(prior[k] / len(learnt)) + sum(math.log((counts[k][g] + 1) / (sum(counts[k].values()) + langid.BUCKETS)) for g in grams(text)) for k in say}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best
        assert abs(r.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


def test_tiles_do_not_depend_on_how_pairs_are_taken(monkeypatch):
    rng = random.Random(2)
    cases = [(np.array([rng.randrange(3) for _ in range(30)]), np.array([rng.randrange(-1, 3) for _ in range(60)])) for _ in range(60)]
    whole = [decontam.tiles(p, t, 3) for p, t in cases]
    monkeypatch.setattr(decontam, "_PAIRS", 7)
    assert [decontam.tiles(p, t, 3) for p, t in cases] == whole


def test_tiles_of_repeated_words_at_length():
    assert decontam.tiles(np.zeros(1000, np.int64), np.zeros(20_000, np.int64)) == [(0, 0, 1000)]


def test_special_text_is_text_when_packed(monkeypatch):
    import public_tokenizers

    one = bpe.Encoder(bpe.default_vocabulary())
    known = packing._tokenizer(*(public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json")))
    for text in ["<|endoftext|> hi", "a <|endoftext|>", "x<|endoftext|>y z", "plain words"]:
        assert next(one.encode([text], special=False)).tolist() == known(text).tolist()
    ids = known("<|endoftext|> hi" + "\n" * 10**6)
    assert packing.END_OF_TEXT not in ids and len(ids) > 10


def test_memory_of_long_pieces_is_bounded():
    one = bpe.Encoder(bpe.default_vocabulary())
    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) + " " + "z" * 100 for _ in range(30)]
    first = [x.tolist() for x in one.encode(texts)]
    one.held["pieces"] = one.held["words"] = bpe._REMEMBER_CHARS + 1
    one._forget()
    assert all(len(k) <= bpe._LONG_PIECE for k in [*one.pieces, *one.words])
    assert one.held["words"] == sum(map(len, one.words))
    assert [x.tolist() for x in one.encode(texts)] == first


def test_edits_of_shared_and_missing_ids(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(99)) for _ in range(rng.randrange(12)))) for i in [None] * 25 + [7] * 30 + list(range(20, 40))]
    rows += rows[:3] + rows[30:33]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, md5(r[1])))
    want = Counter()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        cut = len(a) // 4
        want[i, len(a), hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()] += 1
    for size in (4, 1000):
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in sketch.edited(docs, size=size).collect()) == want


def test_archives_of_others_are_read(spark, tmp_path):
    """A record without HTTP length, one with a SHA-1 digest, and one that is no response."""
    payload = b"<p>" + b"x" * 50
    sha1 = __import__("base64").b32encode(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + payload
    head = lambda kind, more, block: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: d\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    records = [head(b"warcinfo", b"", b"software: x"), head(b"response", b"WARC-Payload-Digest: sha1:" + sha1 + b"\r\n", http), head(b"response", b"", http)]
    path, count, _ = warc._archive(f"file://{tmp_path}", records, iter([]), 1 << 30)
    manifest = spark.createDataFrame([(path, count, 0)], warc._MANIFEST)
    got = warc.read_archives(manifest, payload=True).collect()
    assert [(r.record_type, r.record_id) for r in got] == [("warcinfo", "urn:uuid:1"), ("response", "urn:uuid:1"), ("response", "urn:uuid:1")]
    assert got[1].payload == payload and got[2].payload_digest == hashlib.sha256(payload).hexdigest()
    with pytest.raises(warc.ArchiveError):
        warc.parse(head(b"response", b"WARC-Payload-Digest: sha1:AAAA\r\n", http))


def test_a_tokenizer_version_of_rollups(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    docs = docs_of(spark)
    counts = rollup.counted(docs, vocabularies={"byte_bpe_50k": path})
    root = new_dir(spark, "test-tokens")
    assert rollup.apply(spark, root, "load", rollup.changes(counts, "byte_bpe_50k", 1))
    total = rollup.totals(spark, root).first()
    tk = Tokenizer.from_file(path)
    assert (total.documents, total.tokens) == (4, sum(len(tk.encode(r.text or "").ids) for r in docs.collect()))


def test_a_batch_that_is_committed_in_between_counts_once(spark):
    root = new_dir(spark, "test-race")
    counts = rollup.counted(docs_of(spark))
    rollup.apply(spark, root, "one", rollup.changes(counts, "words@1", 1))
    staged = f"{root}/staged/late"
    rollup.changes(counts, "words@1", 1).write.parquet(staged)
    assert not rollup._renamed(spark, staged, f"{root}/batch/one")
    assert [r.documents for r in rollup.totals(spark, root).collect()] == [4]


def test_parities_differ_no_more_than_sets():
    rng = random.Random(5)
    for _ in range(50):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(1, 400))}
        b = set(list(a)[: rng.randrange(len(a) + 1)]) | {rng.getrandbits(64) for _ in range(rng.randrange(60))}
        bits = [resemblance._parity(np.sort(np.array(list(x), np.uint64))) for x in (a, b)]
        turned = sum((x ^ y).bit_count() for x, y in zip(*(struct.unpack("<8Q", v.tobytes()) for v in bits)))
        assert turned <= len(a ^ b)


def test_encoder_holds_what_it_is_told_to():
    one, rng = bpe.Encoder(bpe.default_vocabulary(), remember=400), random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)) for _ in range(20)]
    got = [x.tolist() for x in one.encode(texts)]
    assert len(one.pieces) <= 400 and len(one.words) <= 100 and len(one.stable_pairs) <= 400
    assert got == [x.tolist() for x in bpe.encoder(bpe.default_vocabulary()).encode(texts)]
