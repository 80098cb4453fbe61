"""What is published, what is refused, stored look-ups, and the contract at every level."""

from pyspark.sql import functions as F

from glossia.jobs import derived, publish
from glossia.operators import audit, contract, extract, index, markup, media
from glossia.schemas import ENTRY
from glossia.sources import files

CARD = (
    '<main class="dict-entry"><section class="o-pos-panel"><div class="o-pos-detail"><b class="o-pos-tag">noun</b><article class="o-sense"><div class="o-sense-define">'
    '<p class="o-def-eng">thing</p><p class="o-def-simp">物</p></div></article><span class="o-pron-chunk"><a href="sound://audio/word/{0}.mp3">x</a>'
    '<i class="o-pron-phon">/x/</i><sub class="o-pron-geo">BrE</sub></span></div></section><header class="o-head-main"><em class="o-h">{0}</em></header></main>'
)


def build(spark, redirects=(("also", "one"),)):
    records = spark.createDataFrame([(i + 1, w, CARD.format(w)) for i, w in enumerate(("one", "two"))], "record_number long, key string, content string")
    layout = extract.Layout(extract.placed(markup.markup_nodes(records)), records, "dict")
    led = spark.createDataFrame([(10 + i, s, t) for i, (s, t) in enumerate(redirects)], "record_number long, source string, target string")
    return audit.Build(layout, extract.assemble(layout), led)


def archive(spark, *names):
    rows = [(f"\\audio\\WORD\\{n}.mp3", f"{n}.mp3", bytearray(b"ID3" + n.encode())) for n in names]
    return spark.createDataFrame(rows, "key string, name string, content binary")


def test_only_sound_builds_are_published(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    wanted = spark.createDataFrame([("entries", 2), ("redirects", 1)], "name string, expected long")
    assert publish.published(spark, root).count() == 0
    lost = publish.publish(build(spark, [("also", "nothing")]), archive(spark, "one", "two"), root, wanted)
    assert lost.status == "failed" and [tuple(r) for r in lost.errors.collect()] == [("unresolved_redirects", "must be empty, has 1")]
    mute = publish.publish(build(spark), archive(spark, "one"), root, wanted)
    assert {r["name"] for r in mute.errors.collect()} == {"missing_audio", "stored_audio"}
    assert publish.published(spark, root).count() == 0
    good = publish.publish(build(spark), archive(spark, "one", "two", "three"), root, wanted, version=3)
    (row,) = publish.published(spark, root).collect()
    assert (row.build, row.version, row.path, row.entries, row.media) == (good.build, 3, good.path, 2, 2)
    said = {s.build: publish.read_audit(spark, s.path).first() for s in (lost, mute, good)}
    assert [said[s.build].status for s in (lost, mute, good)] == ["failed", "failed", "passed"]
    assert said[good.build].totals["stored_audio"] == 2 and said[mute.build].totals["missing_audio"] == 1
    _, rows = files.read_dictionary(spark, f"{good.path}/dictionary")
    words = spark.createDataFrame([("ALSO",), ("two",)], "word string")
    assert {(r.word, r.entry_id) for r in index.lookup_stored(words, rows).collect()} == {("ALSO", 1025), ("two", 2049)}


def scanned(df):
    """Rows that the scans of a query gave, and the buckets they opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan.toString(), text


def test_stored_look_ups_open_few_buckets(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).selectExpr("concat('Word ', id) as headword", "concat('word ', id) as headword_normalized", "'' as phonetic", "'word' as entry_type", "id + 1 as entry_id", "'' as anchor")
    root = f"file://{tmp_path}/dictionary"
    files.write_dictionary(rows.selectExpr("entry_id", "'{}' as json"), rows, root, 16)
    spark.catalog.clearCache()
    _, stored = files.read_dictionary(spark, root)
    assert stored.count() == n
    words = spark.createDataFrame([("WORD 7",), ("Word 39999",), ("none",)], "word string")
    found = index.lookup_stored(words, stored)
    assert {(r.word, r.entry_id, r.total) for r in found.collect()} == {("WORD 7", 8, 1), ("Word 39999", 40_000, 1), ("none", None, 0)}
    some = stored.where(F.col("headword_normalized").isin("word 7", "word 39999"))
    _, said = scanned(some)
    assert "SelectedBucketsCount: 2 out of 16" in said or "SelectedBucketsCount: 1 out of 16" in said
    assert "PushedFilters: [In(headword_normalized" in said
    many = spark.range(3000).selectExpr("concat('WORD ', id * 3) as word")
    full = index.lookup_stored(many, stored)
    assert full.where("total = 1").count() == 3000


def test_the_contract_holds_of_assembled_entries(spark):
    b = build(spark)
    assert contract.violations(b.entries.drop("rec", "local")).count() == 0
    assert {r.path for r in contract.violations(b.entries.drop("local")).collect()} == {"rec"}


def test_every_level_is_checked(spark):
    schema = spark.createDataFrame([], ENTRY).schema
    paths = {path for path, _ in contract.rules(schema)}
    for above in ("", "child_idioms[].", "child_phrasal_verbs[].", "child_derivatives[]."):
        for inner in ("cross_references[].kind", "sense[].definition", "sense[].examples[]", "sense[].senses[].examples[]", "sense[].senses[].cross_references[].labels.usage[]", "pronunciation[].region", "sense[].title"):
            assert above + inner in paths
    assert {(path, rule) for _, path, rule in derived.CONTRACT_FAULTS} <= set(contract.rules(schema))


def test_slices_of_archives_without_a_name(spark):
    rows = spark.createDataFrame([(None, 0, 0, 3), (None, 1, 3, 5), ("a", 0, 0, 2)], "archive string, position int, offset long, end long")
    blocks = spark.createDataFrame([(None, 0, 0, bytearray(b"abcde")), ("a", 0, 0, bytearray(b"xy"))], "archive string, block_no int, start long, content binary")
    found = media.locate(rows, blocks.select("archive", "block_no", "start"))
    assert {(r.archive, r.position, bytes(r.content)) for r in media.sliced(found, blocks).collect()} == {(None, 0, b"abc"), (None, 1, b"de"), ("a", 0, b"xy")}
    sizes = spark.createDataFrame([(None, 4), ("a", 2)], "archive string, packed_size long")
    declared = spark.createDataFrame([(None, 5), ("a", 2)], "archive string, declared long")
    assert [tuple(r) for r in media.layout_errors(sizes, declared).collect()] == [(None, 5, 4)]
