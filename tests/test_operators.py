"""Single operators on small inputs: records, markup, redirects, look-ups, media, audit."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossia.functions import text, windows
from glossia.operators import audit, extract, index, markup, media, records, redirects
from glossia.sources import files

def sense(en, zh, *inside, marks=""):
    return f'<div class="o-sense">{"".join(inside)}<p class="o-sense-define"><b class="o-sense-head">{marks}</b><u class="o-def-simp">{zh}</u><u class="o-def-eng">{en}</u></p></div>'


def quotes(*pairs):
    return '<ol class="o-example-list">' + "".join(f'<li><q class="o-example-simp">{zh}</q><q class="o-example-eng">{en}</q>' for en, zh in pairs) + "</ol>"


def panel(*inside, kind="", pos="tool"):
    tag = f'<em class="o-pos-tag">{pos}</em>' if pos else ""
    return f'<div class="o-pos-panel {kind}"><div class="o-pos-detail">{"".join(inside)}{tag}</div></div>'


def card(*inside, head="spa·de"):
    return f'<main class="dict-entry">{"".join(inside)}<h2 class="o-head-main">{head}</h2></main>'


DIG = f'<div class="o-idiom"><b class="o-idm">call a spade ˈthat</b>{sense("speak plainly", "直说")}</div>'
ENTRY = card(
    '<div class="o-pronunciation-set" data-pronunciation-for="3"><i class="o-pron-chunk"><a href="sound://audio/word/spade.mp3">play</a><i class="o-pron-phon">/sp/</i><i class="o-pron-geo">BrE</i></i></div>',
    panel(
        sense("to <i>dig</i> with", "铲", quotes(('Dig<!-- no --> <b>here</b>.<a href="sound://audio/example/x.mp3">HEAR</a>', "挖"), ("Only said.", "")), marks='<i class="o-reg">old</i><i class="o-gram">[plural];</i><i class="o-sn-g">4.</i>'),
        DIG, '<div class="o-unbox-panel">' + quotes(("Aside.", "旁")) + '<a href="sound://audio/word/aside.mp3">play</a></div>', kind="o-for-pos-3",
    ),
    panel(f'<div class="o-idiom"><b class="o-idm">apart</b>{sense("alone", "独", quotes(("Apart.", "分")))}</div>', kind="o-idiom-collection", pos=""),
)


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def parsed(spark, *contents):
    rows = spark.createDataFrame([(i + 7, f"key {i}", c) for i, c in enumerate(contents)], "record_number long, key string, content string")
    return rows, extract.placed(markup.markup_nodes(rows))


def test_an_entry(spark):
    rows, nodes = parsed(spark, ENTRY, "<p>not one</p>", None)
    x = extract.Layout(nodes, rows, "dict")
    (e,) = extract.assemble(x).collect()
    assert (e.entry_id, e.headword, e.pos, e.entry_type, e.page) == (7169, "spade", "tool", "word", "dict")
    assert [tuple(p) for p in e.pronunciation] == [("UK", "/sp/", "/audio/dict/spade.mp3")]
    (s,) = e.sense
    assert (s["index"], s.definition.en, s.labels.grammar, s.labels.register) == ("4", "to dig with", ["plural"], ["old"])
    assert [tuple(q) for q in s.examples] == [("Dig here.", "挖")]
    assert [c.headword for c in e.child_idioms] == ["call a spade that"]
    assert {r.name for r in extract.audio_references(nodes).collect()} == {"spade.mp3", "aside.mp3"}
    assert {(r.rec, r.reason) for r in x.failed.collect()} == {(8, "not an entry"), (9, "not an entry")}
    (m,) = extract.record_metrics(x).collect()
    want = dict.fromkeys(extract.METRICS, 0) | {"definition_pairs": 2, "raw_examples": 4, "retained_examples": 2, "retained_example_lists": 1, "excluded_examples": 2, "missing_chinese_examples": 1}
    assert m.asDict() == {"rec": 7} | want
    assert extract.orphan_examples(x).count() == 0


def test_rules_that_fail_a_record(spark):
    twice = f'<div class="o-idiom o-phrasal"><b class="o-idm">both</b><b class="o-pv">both</b>{sense("two", "二", quotes(("Two.", "两")))}</div>'
    derived = '<div class="o-relations"><div class="o-relation-item"><b class="o-relation-head">{}</b></div></div>'
    second = '<main class="dict-entry dict-supplemental-entry">{}<ul class="sense_single"><li class="sense"><p class="sensetop"><b class="def">{}</b><deft><chn>地</chn></deft></p><a href="entry://else">else</a></li></ul></main>'
    records = {
        card(panel(DIG.replace('<b class="o-idm">call a spade ˈthat</b>', ""))): "embedded entry without headword",
        card(panel(derived.format("bare"))): "derivative without headword",
        card(panel(derived.format('<b class="o-dr">named</b>'))): None,
        second.format("", "place"): "supplemental record without headword",
        second.format('<h3 class="o-headword">Town</h3>', ""): "supplemental record without bilingual sense",
        second.format('<h3 class="o-headword">Town</h3>', "place"): None,
        card(panel('<div class="o-sense">x</div>')): "sense without definition block",
        card(panel(DIG.replace("o-sense-define", "else"), kind="o-idiom-collection", pos=""), panel(twice)): None,  # what isn't read breaks nothing
    }
    rows, nodes = parsed(spark, *records)
    x = extract.Layout(nodes, rows, "dict")
    want = {i + 7: reason for i, reason in enumerate(records.values()) if reason}
    assert {r.rec: r.reason for r in x.failed.collect()} == want
    entries = {r.rec: r for r in extract.assemble(x).collect()}
    assert set(entries) == set(range(7, 15)) - set(want)
    assert (entries[12].headword, entries[12].sense[0].definition.zh, entries[12].sense[0].cross_references[0].target) == ("Town", "地", "else")
    assert [len(entries[14][c]) for c in ("child_idioms", "child_phrasal_verbs")] == [1, 1]
    m = {r.rec: r for r in extract.record_metrics(x).collect()}
    assert (m[14].retained_examples, m[14].duplicate_example_imports, m[14].definition_pairs) == (1, 1, 2)
    assert (m[12].definition_pairs, m[12].cross_references) == (1, 1)


def test_tag_soup(spark):
    rows = spark.createDataFrame([(1, "<nav><a href=x>n</a></nav><p>a<p>b <b>c<div class=ad>d</div><script>var t='<p>';</script>&amp;<ul><li>1<li>2")], "record_number long, content string")
    n = markup.markup_nodes(rows, markup.Selectors(prune=("ad",), prune_tags=("nav",), tags=("p", "li", "a")))
    got = [(r.tag, r.text_spaced, r.depth) for r in n.orderBy("pre").collect()]
    assert got == [("a", "", 1), ("p", "a", 0), ("p", "b c", 0), ("div", "", 0), ("li", "1", 1), ("li", "2", 1)]
    assert markup.prune_sections(n).count() == 4


def test_redirects(spark):
    rows = spark.createDataFrame(
        [(1, "sample", "<p>"), (2, "Alias", "\x00@@@LINK=SAMPLE\n\x00"), (3, "chain", "@@@LINK=alias"), (4, "a", "@@@LINK=b"), (5, "b", "@@@LINK=a"), (6, "x", "@@@LINK=none")],
        "record_number long, key string, content string",
    )
    led, rest = records.split_redirects(rows)
    assert rest.count() == 1
    direct = spark.createDataFrame([("sample", 1025)], "key string, entry_id long")
    resolved = redirects.resolve(led, direct)
    assert {r.key for r in resolved.collect()} == {"sample", "alias", "chain"}
    assert {r.record_number for r in redirects.unresolved(led, direct).collect()} == {4, 5, 6}
    own = spark.createDataFrame([(1025, "sample")], "entry_id long, alias string")
    assert {r.alias for r in redirects.aliases(led, resolved, own).collect()} == {"sample", "Alias", "chain"}
    assert [tuple(r) for r in redirects.cycles(led, direct).collect()] == [("a|b", 2, 0)]


def test_lookups(spark):
    entries = spark.createDataFrame([(1, "Answer", "word"), (2, "Straße", "word")], "entry_id long, headword string, entry_type string")
    child = "array<struct<headword: string>>"
    for c in index.FIELDS:
        entries = entries.withColumn(c, F.array().cast(child))
    entries = entries.withColumn("pronunciation", F.array(F.struct(F.lit("/x/").alias("notation"))))
    aliases = spark.createDataFrame([(1, "answer alias"), (1, "ANSWER"), (1, " ")], "entry_id long, alias string")
    rows = index.index_rows(entries, aliases)
    assert {(r.headword, r.headword_normalized) for r in rows.collect()} == {("Answer", "answer"), ("answer alias", "answer alias"), ("Straße", "strasse")}
    words = spark.createDataFrame([("ANSWER",), ("STRASSE",), ("missing",)], "word string")
    assert {(r.word, r.entry_id, r.total) for r in index.lookup_words(words, rows).collect()} == {("ANSWER", 1, 1), ("STRASSE", 2, 1), ("missing", None, 0)}
    ids = spark.createDataFrame([("not-an-id",), ("0",), ("9999",), ("1",), ("1\n",)], "id string")
    got = {r.id: r.status for r in index.lookup_entries(ids, entries).collect()}
    assert got == {"not-an-id": "invalid", "0": "invalid", "9999": "missing", "1": "ok", "1\n": "invalid"}


def test_media(spark):
    rng = random.Random(1)
    blobs = [(f"n{i:03d}.mp3", rng.randbytes(rng.randrange(0, 300))) for i in range(50)]
    rows = spark.createDataFrame(blobs, "name string, content binary").repartition(5)
    r = media.combined_crc32(rows).first()
    whole = b"".join(b for _, b in sorted(blobs))
    assert (r.crc, r.bytes, r.files) == (zlib.crc32(whole), len(whole), 50)
    assert media.combined_crc32(rows.limit(0)).first().crc == zlib.crc32(b"")
    mixed = spark.createDataFrame([("a.mp3", b"ID3x"), ("a.mp3", b"ID3x"), ("b.mp3", b"\xff\xe2"), ("b.mp3", b"\xff\x02"), ("..\\c.mp3", b"ID3")], "name string, content binary")
    assert {(x.name, x.problem) for x in media.verify(mixed).collect()} == {("b.mp3", "header"), ("..\\c.mp3", "name")}
    assert {tuple(x) for x in media.duplicates(mixed, ["content"])[1].collect()} == {("a.mp3", 2, 1), ("b.mp3", 2, 2)}
    archive = spark.createDataFrame([("\\AUDIO\\Word\\X.mp3",), ("\\audio\\word\\y.mp3",)], "key string")
    asked = spark.createDataFrame([("x.mp3",), ("X.MP3",), ("z.mp3",), (None,)], "name string")
    assert media.select_referenced(archive, asked).count() == 1
    assert [x.name for x in media.missing(archive, asked).collect()] == ["x.mp3", "z.mp3"]
    blocks = spark.createDataFrame([("s", 0, b"abcdef"), ("s", 1, b"ghij")], "archive string, block_no int, content binary")
    layout = media.block_layout(blocks.select("archive", "block_no", F.length("content").cast("long").alias("size"), F.lit(1).cast("long").alias("packed_size")))
    recs = spark.createDataFrame([("s", 1, 2, 6), ("s", 2, 7, 9)], "archive string, id int, offset long, end long")
    cut = media.sliced(media.locate(recs, layout), blocks)
    assert {(x.id, bytes(x.content)) for x in cut.collect()} == {(1, b"cdef"), (2, b"hi")}


def test_packed_offsets_of_a_hot_archive(spark, uncoalesced):
    """One archive with most rows is laid out in several ranges, as if in one."""
    rng = random.Random(3)
    rows = [(a, i, i // 16, rng.choice([0, 0, 1, 5, 90])) for a, n in (("hot", 3000), ("cold", 40), (None, 25), ("one", 1)) for i in range(n)]
    files = spark.createDataFrame(rows, "archive string, position int, block_no int, n int").repartition(5)
    dealt = windows.dealt(files, ["archive", "position"])
    assert dealt.where("archive = 'hot'").select("_part").distinct().count() > 1
    at, want, total = windows.sums_before(files, "archive", ["position"], {"offset": "n"}), {}, {}
    for a, i, _, n in rows:
        want[a, i] = total.get(a, 0)
        total[a] = want[a, i] + n
    assert {(r.archive, r.position): r.offset for r in at.collect()} == want
    ends = media.next_offset(at.withColumn("total", F.lit(-1)), "total")
    assert {(r.archive, r.position): r.end for r in ends.collect()} == {(a, i): want.get((a, i + 1), -1) for a, i in want}
    blocks = files.groupBy("archive", "block_no").agg(F.sum("n").alias("size"), F.count("*").alias("packed_size"))
    start = {}
    for a, i, b, _ in rows:
        start.setdefault((a, b), want[a, i])
    layout = media.block_layout(blocks)
    assert {(r.archive, r.block_no): r.start for r in layout.collect()} == start
    for r in media.locate(at.select("archive", "position", "offset"), layout).collect():
        block = max(b for (a, b), s in start.items() if a == r.archive and s <= r.offset)
        assert (r.block_no, r.inner) == (block, r.offset - start[r.archive, block])
    assert windows.sums_before(files.limit(0), "archive", ["position"], {"offset": "n"}).count() == 0


def test_gate_and_contract(spark):
    totals = spark.createDataFrame([("entries", 8), ("orphans", 1)], "name string, value long")
    wanted = spark.createDataFrame([("entries", 8), ("records", 5)], "name string, expected long")
    assert {(r.name, r.message) for r in audit.gate(totals, wanted, ["orphans"]).collect()} == {("records", "expected 5, got none"), ("orphans", "must be 0, got 1")}
    assert audit.gate(totals, wanted.where("name = 'entries'"), []).count() == 0
    lists = spark.createDataFrame([("failures", 0), ("cycles", 2)], "name string, value long")
    assert {tuple(r) for r in audit.gate(totals, wanted.where("name = 'entries'"), [], lists).collect()} == {("cycles", "must be empty, has 2")}


def test_samples_need_seven_lines(spark):
    lines = spark.createDataFrame([(" ",)] * 5 + [(f"line {i}",) for i in range(7)], "line string")
    assert windows.fixed_size_sample(lines, "line", "line", 100, 1).count() == 7
    with pytest.raises(ValueError):
        windows.fixed_size_sample(lines.where("line <> 'line 3'"), "line", "line", 100, 1)


def test_a_damaged_file_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/kind"
    spark.range(50).coalesce(1).write.json(folder)
    said = spark.createDataFrame(files.manifest(spark, [folder], 1).collect(), "kind string, version int, path string, length long, crc string")
    check = lambda: files.verified(said, files.manifest(spark, [folder], 1)).first()
    assert check().sound and check().files == 1
    (part,) = (tmp_path / "kind").glob("part-*")
    assert said.first().crc == f"{zlib.crc32(part.read_bytes()):08x}"
    part.write_bytes(part.read_bytes().replace(b"7", b"8"))
    assert not check().sound


def test_scalars(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "s string").select(f(F.col("s"))).first()[0]
    assert one(text.clean_text, "\x1c a　 b\n") == "a b"
    assert one(text.normalize_headword, " ﬁ  STRAßE ") == "fi strasse"
    assert one(text.casefold, "İß") == "i̇ss"
    assert one(text.percent_decoded, "a+b%20c") == "a+b c" and one(text.percent_decoded, "50%") == "50%"
    assert one(text.redirect_target, "plain") is None and one(text.redirect_target, "\n@@@LINK= x \x00") == "x"


def test_normalisation_is_idempotent_and_order_free(spark):
    rows = spark.createDataFrame([(" Ä  ﬁx ",), ("plain  text",), ("İ",)], "s string")
    once = rows.select(text.normalize_headword(F.col("s")).alias("s"))
    assert sorted(r.s for r in once.collect()) == sorted(r.s for r in once.select(text.normalize_headword(F.col("s")).alias("s")).collect())
    data = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    first = lambda d: sorted(map(tuple, windows.dedupe_first(d, ["k"], ["id"]).collect()))
    assert first(data) == first(data.repartition(9)) == [(k, k) for k in range(7)]
    got = windows.numbered(data.repartition(5), ["id"], "at")
    assert got.where("at <> id + 1").count() == 0 and got.count() == 500


def test_plans(spark):
    data = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = windows.top_n(data, ["k"], ["id"], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    lines = data.select(F.col("id").cast("string").alias("line"))
    assert windows.fixed_size_sample(lines, "line", "line", 5, 1)._jdf.queryExecution().toString().count("TakeOrderedAndProject") > 0
