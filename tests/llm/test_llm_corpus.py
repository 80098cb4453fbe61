"""Merkle manifest, best-fit packing and collocations against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("glossia.llm")

from glossia.llm import matching, merkle, phrases  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank double, tree string, part string, phrase string, k string"
EXTRA = (0.5, "t", "p", "x y", "k")
ODD = [None, "", " ", "\n\n", "a\nb", "x" * 3000, "😀 é\nß", "same text", "same text", "<|endoftext|>, x"]


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with columns whose names clash."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


# Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(doc, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Levels from the leaves to the one node that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return out


def plain_proofs(rows, shown):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = defaultdict(list)
    for r, s in zip(rows, shown, strict=True):
        doc, text, lang, source, n = r
        by[source].append((doc, plain_leaf(doc, source, lang, n, text), plain_leaf(doc, source, lang, n, s)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = climb([x[1] for x in by[source]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for i, source in enumerate(order):
        for at, (doc, leaf, other) in enumerate(by[source]):
            path = way(trees[source], at) + way(top, i)
            own = other
            for a, b in path:
                own = sha(a + own + b)
            out.append((doc, leaf, trees[source][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), own, own == top[-1][0]))
    return sorted(out, key=repr)


def documents(rng, n):
    texts = ODD + [f"text {i}\n{rng.random()}" for i in range(n)]
    sources = ["hot"] * 6 + [None, "", "a", "ab", "é", "z" * 40]
    rows = [(rng.choice([None, -5, 7, i, i * 1_000_003, (1 << 62) + i, -(1 << 63)]), t, rng.choice(["en", None]), rng.choice(sources), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + rows[:6] + [rows[12]] * 8


@pytest.mark.parametrize(("bucket", "levels"), [(512, 6), (3, 2), (1, 1)])
def test_proofs_match_brute_force(spark, monkeypatch, bucket, levels):
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = documents(random.Random(bucket), 90)
    shown = [None if r[1] is None else r[1].replace("\n", "") for r in rows]
    got = merkle.proved(frame(spark, rows), F.replace("text", F.lit("\n"), F.lit("")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_proofs(rows, shown)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {w[-1] for w in want} == {True, False}


def test_proofs_of_one_and_of_no_document(spark):
    one = [(1, "x", "en", "s", 1)]
    (got,) = merkle.proved(frame(spark, one)).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified and got.proof_sha256 == sha("")
    assert merkle.proved(frame(spark, one).limit(0)).count() == 0


def test_manifest_has_all_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rows = [(i, str(i), "en", ["s", None][i % 4 == 0], 1) for i in range(60)]
    got = merkle.manifest(frame(spark, rows)).collect()
    leaves = [plain_leaf(*r[:1], r[3], r[2], r[4], r[1]) for r in rows if r[3]]
    levels = climb(leaves)
    assert {(r.level, r["rank"], r.digest) for r in got if r.source} == {(k, i, d) for k in (0, 2, 4) for i, d in enumerate(levels[k])}
    subroot = climb([plain_leaf(*r[:1], r[3], r[2], r[4], r[1]) for r in rows if not r[3]])[-1][0]
    assert [r.digest for r in got if r.level == -1] == [sha(subroot + levels[-1][0])]


def test_ranks_of_long_common_prefixes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET", 4)
    rng = random.Random(5)
    keys = list({"0" * 40 + f"{rng.getrandbits(rng.choice([8, 20, 60])):x}" for _ in range(300)})
    rows = spark.createDataFrame([(k, "g" if i % 3 else "h") for i, k in enumerate(keys)], "key string, own string")
    got = {(r.own, r.key): r["rank"] for r in merkle.ranked(rows, "own", F.col("key")).collect()}
    for own in "gh":
        mine = sorted(k for o, k in got if o == own)
        assert [got[own, k] for k in mine] == list(range(len(mine)))


# Best-fit packing


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_match_the_library(vocabulary):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(vocabulary)
    rng = random.Random(3)
    letters = "aZé9 .,'\n\t<|>İßΣ́#-  "
    texts = ["", "İ, a İstanbul, x", "é, e ́b á.", "a\tb  c", "it's, 'save' they'LL go'", "<|endoftext|> x<|endoftext|>, y", "한국어, 日本語。!", "a" * 5000, "x, " * 3000, "５, ①. ² ½!", "##$$%% a## b$$, c", "\x00a \x1cb\x85c"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    own = matching.Encoder(vocabulary)
    for _ in range(2):  # the second time words are known
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = [f"w{i % 50}, word{i}" for i in range(400)]
    whole = matching.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(matching, "_REMEMBER", 20)
    own = matching.Encoder(vocabulary)
    assert [x for i in range(0, 400, 10) for x in own.encode(texts[i : i + 10])] == whole


def first_principles(lengths, capacity):
    """Best fit decreasing, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_sound_and_tight(seed):
    rng = random.Random(seed)
    capacity = 60
    kinds = [lambda: rng.randint(1, 60), lambda: rng.randint(20, 41), lambda: rng.choice([20, 21, 40, 39]), lambda: rng.choice([1, 60, 7]), lambda: rng.randint(1, 20), lambda: rng.choice([21, 22, 38, 5])]
    counts = Counter(kinds[seed]() for _ in range(500))
    plan = matching.Plan(capacity, dict(counts))
    placed = defaultdict(list)
    keys, first, sequence, each, offset = plan.arrays()
    for size, n in counts.items():
        for nth in range(n):
            at = int(np.searchsorted(keys, size << matching._RANK_BITS | nth, "right")) - 1
            since = nth - int(first[at])
            placed[int(sequence[at]) + since // int(each[at])].append((int(offset[at]) + since % int(each[at]) * size, size))
    assert sum(map(len, placed.values())) == sum(counts.values())
    assert set(placed) == set(range(plan.sequences))
    for inside in placed.values():
        end = 0
        for start, size in sorted(inside):
            assert start == end
            end += size
        assert end <= capacity
        assert sum(3 * size > capacity for _, size in inside) <= 2
    lengths = list(counts.elements())
    assert plan.sequences <= first_principles(lengths, capacity) + 1
    assert plan.sequences >= -(-sum(lengths) // capacity)


def test_large_pieces_are_matched_as_often_as_can_be():
    rng = random.Random(9)
    for _ in range(40):
        sizes = [rng.randint(21, 60) for _ in range(9)]

        def best(left):
            if not left:
                return 0
            head, rest = left[0], left[1:]
            return min([1 + best(rest)] + [1 + best(rest[:i] + rest[i + 1 :]) for i, x in enumerate(rest) if head + x <= 60])

        assert matching.Plan(60, dict(Counter(sizes))).sequences == best(sorted(sizes))


def test_packing_keeps_every_id(spark, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta,", "x9"]) for _ in range(rng.choice([3, 40, 300, 900]))) for _ in range(60)]
    docs = frame(spark, [(i if i % 9 else None, t, None, "s", 1) for i, t in enumerate(texts)]).repartition(3)
    found = matching.pieces(docs, vocabulary, 512)
    placed = matching.packed(spark, found, 512)
    rows = placed.collect()
    known = Tokenizer.from_file(vocabulary)
    want = Counter(tuple([*known.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts)
    whole = defaultdict(bytes)
    got = Counter()
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        ids = np.frombuffer(r.ids, "<u2")
        assert r.length == len(ids) <= 512 and r.start == 512 * r.piece and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        if r.doc_id is not None:
            whole[r.doc_id] += r.ids
    got.update(tuple(np.frombuffer(x, "<u2").tolist()) for x in whole.values())
    assert got == want - Counter(tuple([*known.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts[::9])
    sequences = {r.sequence_id: r for r in matching.sequences(placed).collect()}
    for r in rows:
        s = sequences[r.sequence_id]
        assert s.ids[2 * r.offset : 2 * (r.offset + r.length)] == r.ids
        assert r.offset in s.cu_seqlens and r.offset + r.length in s.cu_seqlens
    total = sum(r.length for r in rows)
    assert sum(len(s.ids) // 2 for s in sequences.values()) == total and len(sequences) <= -(-total // 512) + 1


def test_packing_does_not_follow_partitions(spark):
    docs = frame(spark, [(i, "word " * (i * 37 % 900), None, "s", 1) for i in range(80)])
    counts = [matching.pack(spark, docs.repartition(n)).select("sequence_id").distinct().count() for n in (1, 7)]
    assert counts[0] == counts[1]
    assert matching.pack(spark, docs.limit(0)).count() == 0


# Collocations


def plain_collocations(rows, least, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            own = [w for w in re.split(r"[ \t]+", piece) if w]
            words[lang] += len(own)
            for k in range(1, 6):
                counts[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, all_ in counts.items():
        f = {p: n for p, n in all_.items() if n >= least}
        found = {}
        for p, a in f.items():
            if len(p) > 1:
                found[p] = min((1000 * a * words[lang] // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))
        longer = Counter()
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], f[p])
        kept = [(p, f[p], s) for p, s in found.items() if 100 * longer[p] < 100 * f[p]]
        kept.sort(key=lambda x: (-x[2][0], -x[1], " ".join(x[0]).encode()))
        out += [(lang, i + 1, " ".join(p), a, s[2], s[3], words[lang], s[0]) for i, (p, a, s) in enumerate(kept[:top])]
    return sorted(out)


def chatter(rng, n):
    pool = ["a", "B", "é", "cc", "d d", "ß", "x'", "\x1c"] + [f"w{i}" for i in range(12)]
    said = ["in the beginning was", "Of The", "once upon a time there", "😀 b"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(pool), rng.choice(said)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;"]) for _ in range(rng.randrange(60)))
        rows.append((i % 7, text, rng.choice(["en", "en", "de", None]), "s", 1))
    return rows + [(1, t, "en", None, 1) for t in ODD]


@pytest.mark.parametrize("buckets", [1 << 16, 64])
def test_collocations_match_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(phrases, "MIN_BUCKETS", buckets)
    monkeypatch.setattr(phrases, "MAX_BUCKETS", buckets)
    rows = chatter(random.Random(6), 120)
    for least, top in ((4, 2000), (12, 5)):
        got = phrases.collocations(frame(spark, rows).repartition(3), least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = plain_collocations(rows, least, top)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 8


def test_small_parts_and_forgetting_words_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_TOGETHER", 50)
    monkeypatch.setattr(phrases, "_WORDS", 10)
    monkeypatch.setattr(phrases, "_HELD", 5)
    rows = chatter(random.Random(8), 60)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), 3).collect())) == plain_collocations(rows, 3)


def test_phrases_that_share_a_hash_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int32)
    place, n = phrases._counted(ids, np.arange(7), np.zeros(7, np.uint64), 3)
    assert {tuple(ids[p : p + 3].tolist()): c for p, c in zip(place.tolist(), n.tolist(), strict=True)} == {(1, 2, 3): 2, (2, 3, 1): 1, (3, 1, 2): 1, (1, 2, 4): 1, (2, 4, 1): 1, (4, 1, 2): 1}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**14
    frequent = spark.createDataFrame([("en", "a", 1, 3 * big + 1), ("en", "b", 1, 2 * big + 7), ("en", "a b", 2, big + 3)], "lang string, phrase string, k int, n long")
    totals = spark.createDataFrame([("en", 10**16 + 9)], "lang string, words long")
    (got,) = phrases.scored(frequent, totals).collect()
    assert got.score == 1000 * (big + 3) * (10**16 + 9) // ((3 * big + 1) * (2 * big + 7))


def test_no_frequent_phrase(spark):
    docs = frame(spark, [(1, "only once here", "en", "s", 1), (2, None, None, None, None)])
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_bitmaps_take_few_jobs(spark):
    """What the passes learn reaches the driver by a job or two, however many partitions a shuffle has."""
    docs = spark.createDataFrame([(i, "alpha beta gamma delta, one two three", "en") for i in range(8)], "doc_id long, text string, lang string")
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        spark.sparkContext.setJobGroup("bitmaps", "bitmaps")
        frequent, _ = phrases.frequent_phrases(docs, min_count=4)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmaps"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert frequent.where("k = 4").count() == 1
    assert 0 < jobs < 120
