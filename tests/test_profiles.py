"""Profiles of single operators: fewer nodes, the same results; plain tags are read like any others."""

import os
import re

import pytest
from pyspark.sql import functions as F

from glossia.jobs import derived, queries
from glossia.operators import audit, extract, markup

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")

SOUP = [
    '<div class="o-sense"><ul class="o-example-list"><li class="x y">a &amp; b<li>c</ul></div>',
    '<p class="a">1<p class="b">2<table><tr><td class="c"><p>3<td>4</table>5', '<b class="a"><i>x</b>y</i>z</none>', "<br/><img ><a href=\"sound://audio/example/1.mp3\">HEAR</a><a href=\"\">n</a>",
    '<q class="o-example-eng">it <a href="sound://audio/example/2.mp3">HEAR <u>me</u></a> is</q>', '<div class="o-unbox-panel"><li>in</li></div><li>out', '<a href="x?a=1&amp;b" class="k" class="l">t</a>', "", "no tags &lt", "1 < 2 <b class='s'>x</b>",
]


@pytest.mark.parametrize("html", SOUP)
def test_plain_tags_are_read_as_the_tolerant_parser_does(html, monkeypatch):
    plain = markup._Builder(markup.ENTRY_PROFILE).rows(html)
    monkeypatch.setattr(markup, "_PLAIN", re.compile(r"(?!)"))
    assert plain == markup._Builder(markup.ENTRY_PROFILE).rows(html)


def test_only_named_elements_are_rows(spark):
    rows = spark.createDataFrame([(1, '<li class="a">x<a href="entry://y">y</a></li>')], "record_number long, content string")
    n = markup.markup_nodes(rows, markup.ENTRY_PROFILE.only(("<a>",), ("pre", "href"), ("sense",)))
    assert (n.columns, n.schema["up"].dataType.names) == (["rec", "pre", "href", "up", "error"], ["sense"])
    assert [(r.pre, r.href) for r in n.collect()] == [(1, "entry://y")]


@needs_data
def test_nodes_are_stored_without_moving_them(spark):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    n = derived.nodes(spark, DATA, 3)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    files = n.select(F.input_file_name().alias("f"), (F.pmod(F.hash("rec"), F.lit(3))).alias("b")).distinct().collect()
    assert sorted(r.b for r in files) == [0, 1, 2]  # a bucket is one task's file
    assert "Exchange" not in n.groupBy("rec").count()._jdf.queryExecution().executedPlan().toString()


#: Queries with a profile, and whether what they read is stored.
NARROW = {"extract_examples": True, "extract_pronunciations": False, "example_text": False, "panel_pronunciation_sets": True, "classify_excluded_examples": False, "entry_references": False, "extract_audio_refs": False}


@needs_data
@pytest.mark.parametrize("name", NARROW)
def test_a_profile_changes_no_row(spark, name, monkeypatch):
    full = queries.layout(spark, DATA)
    profiles = []
    whole = queries.narrow
    monkeypatch.setattr(queries, "narrow", lambda *a: profiles.append(a[2:]) or full)
    want = queries.QUERIES[name](spark, DATA).collect()
    monkeypatch.setattr(queries, "narrow", whole)
    if not NARROW[name]:
        monkeypatch.setattr(derived, "bucketed", None)  # nothing is stored
    got = queries.QUERIES[name](spark, DATA).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and [kept for _, kept in profiles] == [NARROW[name]]


@needs_data
def test_only_records_with_phrase_panels_are_assembled(spark, monkeypatch):
    made, layout = [], extract.Layout
    monkeypatch.setattr(extract, "Layout", lambda *a: made.append(layout(*a)) or made[-1])
    got = {r.headword for r in queries.QUERIES["promote_phrase_panels"](spark, DATA).collect()}
    recs = {r.rec for r in made[-1].nodes.select("rec").distinct().collect()}
    sayings = {k for k in range(derived.table(spark, DATA, "part").count()) if k % 50 < 40 and k % 10 == 9}
    assert got == {f"saying {k}" for k in sayings}
    assert {k + 1 for k in sayings} <= recs and all((r - 1) % 10 == 9 or (r - 1) % 50 >= 40 for r in recs)


def test_texts_are_kept_where_they_are_asked_for(spark):
    rows = spark.createDataFrame([(1, '<div class="o-idiom"><b class="o-idm">as one</b><ul class="o-example-list"><li><q class="o-example-eng">it is</q></li></ul></div>')], "record_number long, content string")
    got = {(r.classes[0] if r.classes else r.tag): (r.text_spaced, r.text_joined) for r in markup.markup_nodes(rows, extract.ENTRY_NODES).collect()}
    assert got == {"o-idiom": ("", ""), "o-idm": ("as one", ""), "li": ("", ""), "o-example-eng": ("", "it is")}


CARD = (
    '<main class="dict-entry"><section class="o-pos-panel"><div class="o-pos-detail"><b class="o-pos-tag">noun</b><article class="o-sense"><div class="o-sense-define">'
    '<p class="o-def-eng">thing</p><p class="o-def-simp">物</p></div></article></div></section><header class="o-head-main"><em class="o-h">{0}</em></header></main>'
)


def cards(spark):
    rows = spark.createDataFrame([(i + 1, w, CARD.format(w)) for i, w in enumerate(("one", "two"))], "record_number long, key string, content string")
    return extract.Layout(extract.placed(markup.markup_nodes(rows)), rows, "dict")


def test_entries_of_a_build_and_counters_are_worked_out_once(spark):
    x = cards(spark)
    twice = extract.assemble(x).where("rec = 1").withColumn("rec", F.lit(5).cast("long"))
    b = audit.Build(x, extract.assemble(x).unionByName(twice), spark.createDataFrame([], "record_number long, source string, target string"))
    assert [(r.entry_id, r.rec) for r in b.entries.orderBy("rec").collect()] == [(1025, 1), (2049, 2)]
    assert [(r.entry_id, r.rec) for r in b.collisions.collect()] == [(1025, 5)]
    assert "Window" not in b.entries._jdf.queryExecution().executedPlan().toString()  # ids were ranked before
    assert x.metrics is x.metrics and "Join" not in x.metrics._jdf.queryExecution().executedPlan().toString()


def test_a_part_of_a_layout_is_filtered(spark, monkeypatch):
    x = cards(spark)
    second = x.records.where("record_number = 2")
    want = extract.assemble(extract.Layout(x.nodes.where("rec = 2"), second, "dict")).collect()
    x.metrics, x.failed  # noqa: B018
    for name in ("headwords", "panels", "senses", "parsed_boxes", "parsed_senses", "child_rows", "supplemental", "failures", "record_metrics"):
        monkeypatch.setattr(extract, name, None)  # not called again
    part = x.part(spark.createDataFrame([(2,)], "rec long"), second)
    assert extract.assemble(part).collect() == want and [r.rec for r in want] == [2]
    assert [r.rec for r in part.metrics.collect()] == [2]
