"""Each operator against a brute-force version, and on nulls, blanks, ties and empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("glossia.llm")

from glossia.llm import bpe, decontam, graph, kdtree, langid, packing, pii, rollup, simhash, sketch, warc  # noqa: E402
from glossia.llm.durable import new_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
ODD = [None, "", " ", "\n\t", "a", "A b", "x" * 3000, "😀 é ß", "same text here", "same text here"]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, ["en", "fr", None][k % 3], "s", None if t is None else len(t), 0.5, "k") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, pool=60):
    return " ".join(rng.choice([f"w{i}" for i in range(pool)]) for _ in range(n))


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


# SimHash


def plain_fingerprint(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(12):
        base = words(rng, 120).split()
        for _ in range(6):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    got = rows(simhash.near_duplicates(frame(spark, texts)))
    fps = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[i] = root[j] = min(root[i], root[j])
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_pigeonring_keys_lose_no_pair(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(400):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    assert got == want


def test_keep_one(spark):
    docs = frame(spark, ["a b c d", "a b c d", None, "", "other words here now", "a b c d"], [5, 3, 8, 2, 9, 3])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(edges, "a", "b").collect()} == {(i, 0) for i in range(n + 1)}


# WARC


def test_warc_round_trip(spark):
    same = "<p>" + "y" * 200
    html = [None, "", "short", "short", same, same, same, "é" * 80, "z" * 99, "z" * 99, "q" * 300_000]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i} \n", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.archived(spark, pages).collect()}
    data = [(h or "").encode() for h in html]
    assert len(got) == len(html)
    for i, d in enumerate(data):
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(d), hashlib.sha256(d).hexdigest())
        first = data.index(d)
        revisit = len(d) >= 100 and first < i
        assert (got[i].record_type, got[i].refers_to) == (("revisit", first) if revisit else ("response", None))
    assert warc.archived(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("damage", ["cut", "flip", "magic"])
def test_warc_damage_is_found(tmp_path, damage):
    records = [warc.record(i, "u", b"p" * 500 + str(i).encode(), hashlib.sha256(b"p" * 500 + str(i).encode()).hexdigest(), None, "d") for i in range(300)]
    path, count, _ = warc._archive(f"file://{tmp_path}", records, iter([]), 1 << 30)
    file = path[7:]
    data = bytearray(open(file, "rb").read())
    assert data[:4] == b"\x5d\x2a\x4d\x18" and count == 300
    assert list(warc._frames(open(file, "rb"), 1 << 20)) == records
    if damage == "cut":
        data = data[:-5]
    elif damage == "flip":
        data[-6] ^= 255
    else:
        data[0] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(warc.ArchiveError):
        list(warc._frames(open(file, "rb"), 1 << 20))


@pytest.mark.parametrize("old,new", [(b"Content-Length: ", b"Content-Length: 9"), (b"WARC/1.1", b"WARC/9"), (b"sha256:", b"sha256:0"), (b"WARC-Date", b"WARC Date:")])
def test_warc_headers_are_validated(old, new):
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d")
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(warc.ArchiveError):
        warc.parse(good.replace(old, new, 1))


# Language ID


def test_language_id(spark):
    rng = random.Random(3)
    say = {"en": "the and ing tion of was", "fr": "les que éau ment oui dans", None: "zz"}
    data = [(i, " ".join(rng.choice(say[lang].split()) for _ in range(30)), lang, "s", 1, 0.1, "k") for i in range(300) for lang in [["en", "fr", None][i % 3]]]
    data += [(1000 + i, t, "en", "s", 1, 0.1, "k") for i, t in enumerate([None, "", "123 !!", "the and"])]
    docs = spark.createDataFrame(data, SCHEMA)
    got = rows(langid.identified(docs))
    assert len(got) == len(data)
    assert all(got[d[0]]["lang_pred"] == d[2] for d in data[:300] if d[2])
    assert [got[1000 + i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_batches_do_not_change_scores(monkeypatch):
    texts = ["abc def ghi", "", "é à", "hello world " * 20]
    weights = np.random.default_rng(0).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    one = [langid.score([t], weights, np.zeros(3))[1][0] for t in texts]
    monkeypatch.setattr(langid, "_BATCH_CHARS", 7)
    assert np.allclose(langid.score(texts, weights, np.zeros(3))[1], one)


# BPE


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    tk = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["a", "th", "e", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "'", "é", "ß", "中", "😀", "12", "½", "_", "--", "<|endoftext|>", "<|", "\x00", "́", "the"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800)] + [" " * 2000, "ab " * 3000, "-" * 1500, "\n\n x"]
    got = rows(bpe.encoded(frame(spark, texts), path, ["doc_id"]))
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u2").tolist() == ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBER", 20)
    monkeypatch.setattr(bpe, "_PENDING", 30)
    small, rng = bpe.Encoder(bpe.default_vocabulary()), random.Random(5)
    texts = [words(rng, 40, 500) for _ in range(30)]
    assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in bpe.encoder(bpe.default_vocabulary()).encode(texts)]
    assert small.decode(np.array([200, 201], np.uint16)) == bytes(small.bytes_of[200] + small.bytes_of[201]).decode("utf-8", "replace").encode()


# Decontamination


def brute_tiles(p, t, least):
    """Greedy string tiling as its definition says: search all maximal matches, mark the longest."""
    mp, mt, out = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] >= 0 and not mp[i + k] and not mt[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return out
        k, i, j = best[0], -best[1], -best[2]
        mp[i : i + k] = mt[j : j + k] = [True] * k
        out += k


def test_tiling_matches_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        t = [rng.randrange(-1, 4) for _ in range(rng.randrange(1, 40))]
        assert sum(n for _, _, n in decontam.tiles(np.array(p), np.array(t), 3)) == brute_tiles(p, t, 3)


def test_reordered_passages_are_caught(spark):
    rng = random.Random(7)
    items = [words(rng, 40, 4000) for _ in range(8)]
    halves = items[0].split()
    texts = ODD + [f"{words(rng, 50, 4000)} {items[1].upper()}! more", " ".join(halves[20:] + ["between"] + halves[:20]), words(rng, 300, 4000), " ".join(halves[:12])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(10, 1): 40, (11, 0): 40}
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench, block_words=60).collect()} == set(got)
    kept = decontam.keep_clean(docs, bench, block_words=60)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {10, 11}
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.overlaps(docs.limit(0), bench).count() == 0


# Sketches


def test_edits_in_order_of_ids(spark):
    rng = random.Random(8)
    texts = ODD + [words(rng, rng.randrange(1, 300), 5000) for _ in range(90)]
    ids = rng.sample(range(10_000), len(texts))
    got = rows(sketch.edited(frame(spark, texts, ids), size=7))
    order = sorted(zip(ids, [t or "" for t in texts]))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        cut = len(a) // 4
        made = a[: len(a) - cut] + b[:cut]
        x, y = shingles(a), shingles(made)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a), hashlib.sha256(made.encode()).hexdigest())
        assert abs(got[i]["near_edited"] - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.16
    assert len(got) == len(texts)
    one = sketch.edited(frame(spark, ["a b c d e f g h"])).collect()
    assert one[0].near_next == 1.0 and sketch.edited(frame(spark, [])).count() == 0
    assert sketch.edited(frame(spark, ["a", "b", None], [None, None, 3])).count() == 3


def test_sketches_merge(spark, monkeypatch):
    rng = random.Random(9)
    a, b = words(rng, 3000, 9000), words(rng, 2000, 9000)
    both = a + " " + b
    assert abs(sketch.distinct(sketch.sketch(both)) / 4996 - 1) < 0.25
    merged = sketch.merged(sketch.sketch(a), sketch.sketch(b))
    assert sketch.resemblance(merged, sketch.sketch(both)) > 0.95
    assert abs(sketch.containment(sketch.sketch(a), sketch.sketch(both)) - 1) < 0.2
    whole = sketch.sketch(both)
    monkeypatch.setattr(sketch, "_CHUNK", 100)
    assert np.array_equal(sketch.sketch(both), whole)
    got = {r.source: r.distinct_shingles for r in sketch.group_sketches(frame(spark, ["a b c d e f", "b c d e f g", None]), "source").collect()}
    assert got == {"s": 3.0}
    big = frame(spark, ["a b c d e f", "x", "b c d e f g"], [9007199254740993, None, 9007199254740993])
    assert {(r.doc_id, r.distinct_shingles) for r in sketch.group_sketches(big, "doc_id").collect()} == {(9007199254740993, 3.0), (None, 1.0)}


# Rollups


def test_rollup_batches_are_idempotent(spark):
    root = new_dir(spark, "test-rollup")
    counts = rollup.counted(frame(spark, ["a b c", None, "d-e"]))
    assert rollup.apply(spark, root, "one", rollup.changes(counts, "words@1", 1))
    assert not rollup.apply(spark, root, "one", rollup.changes(counts, "words@1", 1))
    total = lambda: sorted((r.lang or "", r.tokenizer, r.documents, r.tokens) for r in rollup.totals(spark, root).collect())
    assert total() == [("", "words@1", 1, 1), ("en", "words@1", 1, 3), ("fr", "words@1", 1, 0)]
    rollup.compact(spark, root)
    gone = counts.where("doc_id = 2")
    rollup.apply(spark, root, "two", rollup.changes(gone, "words@1", -1).unionByName(rollup.changes(gone, "words@2", 1)))
    assert not rollup.apply(spark, root, "one", rollup.changes(counts, "words@1", 1))
    rollup.compact(spark, root)
    rollup.apply(spark, root, "none", rollup.changes(counts.limit(0), "words@1", 1))
    assert total() == [("", "words@2", 1, 3), ("en", "words@1", 1, 3), ("fr", "words@1", 1, 0)]


# K-d tree


def test_shards_have_near_equal_bytes(spark):
    rng = random.Random(10)
    texts = ODD + ["hot " * 50] * 300 + [words(rng, rng.randrange(1, 60)) for _ in range(700)]
    got = kdtree.shard(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) < 4000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdtree.shard(frame(spark, [])).count() == 0
    assert kdtree.shard(frame(spark, [None], [None])).count() == 1
    by_bytes = kdtree.shard(frame(spark, texts), shards=None, target_bytes=20_000).collect()
    assert len({r.shard for r in by_bytes}) == -(-sum(sizes.values()) // 20_000)


def brute_shards(points, first, shards, extents):
    """Shards by the recursion as it is defined: widest dimension, exact weighted median."""
    if shards == 1 or not points:
        return {p: first for p in points}
    low_high = [(min(p[i] for p in points), max(p[i] for p in points)) for i in range(4)]
    wide = [(b - a) / (x or 1.0) for (a, b), x in zip(low_high, extents)]
    own = sorted(points, key=lambda p: p[wide.index(max(wide))])
    half, upto, at = shards // 2, 0, 0
    goal = sum(p[4] for p in own) * half / shards
    while upto + own[at][4] < goal:
        upto, at = upto + own[at][4], at + 1
    at += upto + own[at][4] - goal < goal - upto
    return brute_shards(own[:at], first, half, extents) | brute_shards(own[at:], first + half, shards - half, extents)


def test_shards_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "TOLERANCE", 0.0)
    rng = random.Random(20)
    docs = frame(spark, ODD + [words(rng, rng.randrange(1, 400)) for _ in range(200)])
    rows = kdtree.points(docs)
    points = [(*[r[f"c{i}"] for i in range(4)], r["size"]) for r in rows.collect()]
    extents = [max(p[i] for p in points) - min(p[i] for p in points) for i in range(4)]
    got = {(*[r[f"c{i}"] for i in range(4)], r["size"]): r["node"] for r in kdtree.placed(rows, 6).collect()}
    assert got == brute_shards(points, 0, 6, extents)


def test_repeated_rows_are_spread(spark):
    rng = random.Random(21)
    texts = ["x" * 500] * 2000 + [words(rng, 50) for _ in range(48)]
    got = kdtree.shard(frame(spark, texts, [7] * 2000 + list(range(100, 148))).repartition(3)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 2048 and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) < 5000
    assert len({(r.shard, r.slot) for r in got}) == 2048
    ids = [9007199254740993, None, None, None, -9223372036854775807]
    assert sorted((r.doc_id for r in kdtree.shard(frame(spark, ["a"] * 5, ids)).collect()), key=str) == sorted(ids, key=str)


# Personal data


def test_the_ratio_is_that_of_the_definition(spark):
    import math

    rng = random.Random(22)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(pool) for _ in range(12)) + (f" {'secret ' * rng.randrange(1, 4)}bob{rng.randrange(2)}@x.org" * (i % 5 == 0)) for i in range(100)]
    texts += [texts[0], texts[5]] + [f"odd{i} secret" for i in range(2)]
    docs = frame(spark, texts)
    rows = pii.keyed(docs)
    base = pii.base_spans(rows)
    held = pii._texts(rows, base)
    terms = pii.terms_of(held)
    own = lambda t: re.findall(r"[a-z0-9]+", re.sub(r"bob[01]@x\.org", " ", t))
    total, copies = len(texts), Counter(texts)
    names = {t: set(re.findall(r"bob[01]@x\.org", t)) for t in copies}
    teams = defaultdict(set)
    for name in {n for own in names.values() for n in own}:
        teams[frozenset(t for t in copies if name in names[t])].add(name)
    teams = list(teams)
    want = {}
    for level in ("own", "class"):
        for team in teams if level == "own" else [frozenset(t for t in copies if names[t])]:
            n_held, contexts = sum(copies[t] for t in team), len(team)
            for term in {w for t in team for w in own(t)}:
                seen = sum(min(1, own(t).count(term)) for t in team)
                outside = sum(n for t, n in copies.items() if term in own(t) and t not in team)
                n, z2 = seen + outside, 1.645**2
                p = seen / n
                wilson = (p + z2 / (2 * n) - math.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
                bound = min(wilson, p * 0.05 ** (1 / seen))
                ratio = 1 + math.log(bound) / math.log(total / n_held)
                if bound >= pii.CERTAIN and ratio >= 0.2 and (level == "own" or contexts < pii.SUPPORT):
                    for t in team:
                        want[t, term] = max(want.get((t, term), 0), ratio)
    got = {(r.tkey, r.term): r.ratio for r in pii.disclosing(rows, held, base, terms, threshold=0.2).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got.keys() == {(md5(t), term) for t, term in want} and any(term == "secret" for _, term in want)
    assert all(abs(got[md5(t), term] - ratio) < 1e-9 for (t, term), ratio in want.items())


def test_terms_that_disclose(spark):
    rng = random.Random(11)
    texts = [f"{words(rng, 9)} project nightjar{i % 2 and '' or ','} write bob@example.org {words(rng, 9)}" for i in range(6)]
    texts += [words(rng, 30) for _ in range(300)] + ODD + ["bob@example.org alone", "call +1 (415) 555-2671 or 1.2.3.4, card 4539578763621486"]
    docs = frame(spark, texts)
    got = rows(pii.found(docs))
    assert len(got) == len(texts)
    assert all("term:" in got[i]["spans"] for i in range(6)) and got[len(texts) - 1]["n_card"] == 1
    assert not any(got[i]["spans"] for i in range(6, 306))
    clean = rows(pii.sanitised(docs))
    assert len(clean) == len(texts) and all("nightjar" not in clean[i]["text"] and "[EMAIL]" in clean[i]["text"] for i in range(6))
    assert clean[len(texts) - 1]["text"] == "call [PHONE] or [IP], card [CARD]" and clean[len(texts) - 1]["n_chars"] == 33
    assert all(clean[i]["text"] == texts[i] for i in range(6, 306 + len(ODD)))
    assert pii.found(docs.limit(0)).count() == 0 and pii.sanitised(docs.limit(0)).columns == docs.columns


def test_base_spans_match_the_plain_patterns(spark):
    def luhn(d):
        return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ]
    rng = random.Random(12)
    parts = [*"ab129.@-+ ()%_é😀\n", "4539578763621486", "a@b.c", "1.2.3.4", "+1 (415) 555-2671", "256", ".."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["9" * 30000, "1 " * 9000, "a" * 30000 + "@b.cc", "+1" + "(" * 9000]
    got = rows(pii.found(frame(spark, texts)))
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p, ok in plain for m in re.finditer(p, t) if ok(m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


# Packing


def test_best_fit_decreasing():
    rng = random.Random(13)
    for _ in range(40):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 120))]
        got = packing.best_fit(lengths, 64)
        rooms, where = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(64 - lengths[i])
        assert got[2] == len(rooms)
        used = defaultdict(list)
        for n, row, at in zip(lengths, got[0], got[1]):
            used[row].append((at, at + n))
        assert all(b <= c for spans in used.values() for (_, b), (c, _) in zip(sorted(spans), sorted(spans)[1:]))
        assert all(max(e for _, e in spans) <= 64 for spans in used.values()), where


def test_packing_is_lossless(spark):
    import public_tokenizers

    rng = random.Random(14)
    texts = ODD + [words(rng, rng.randrange(1, 900)) for _ in range(60)]
    paths = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json")]
    manifest = packing.write_packed(frame(spark, texts), new_dir(spark, "test-packed"), *paths, length=256, window=5000)
    segments = packing.read_packed(manifest).collect()
    one = bpe.encoder(paths[1])
    by_doc = defaultdict(list)
    for s in segments:
        by_doc[s.doc_id].append(s)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*next(one.encode([t])).tolist(), packing.END_OF_TEXT]
        own = sorted(by_doc[i], key=lambda s: s.doc_start)
        assert sum(s.length for s in own) == len(ids) and all(s.length <= 256 for s in own)
        for s in own:
            part = np.array(ids[s.doc_start : s.doc_start + s.length], "<u4")
            assert s.ids_sha256 == hashlib.sha256(part.tobytes()).hexdigest()
    assert packing.positions(np.array([0, 2, 5]), 7).tolist() == [0, 1, 0, 1, 2, 0, 1]
    assert packing.read_packed(packing.write_packed(frame(spark, []), new_dir(spark, "test-none"), *paths)).count() == 0
