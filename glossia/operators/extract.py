"""Entries out of the node table.

``placed`` gives every row its panel, sense, embedded child and so on, as numbers.
All grouping and joining is by keys that contain the record. Nodes that lie in buckets by
record (``sources.shared.bucketed``) are not moved again by any operator; what several of
them need is written in the same buckets. Lists keep document order: values are collected
with their position and sorted.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossia.functions import text
from glossia.functions.windows import dedupe_first
from glossia.operators.markup import COLLECTIONS, ENTRY_PROFILE, below, has, href, nearest, own_or_nearest, parent_has
from glossia.schemas import BUCKETS, CHILD, EN_ZH, LABELS, NODE, PRON, SENSE, XREF
from glossia.sources.shared import bucketed, saved

#: Class names of the records' layout.
EMBEDDED = ("o-idiom", "o-phrasal", "o-relation-item")
LABEL_CLASSES = (
    ("o-gram", "grammar"), ("o-reg", "register"), ("o-geo", "region"), ("o-sense-usage", "usage"),
    ("o-usage", "usage"), ("o-cf", "construction"), ("o-note", "note"), ("o-help", "note"),
)
IGNORED_TAGS = ("o-sn-g", "o-label-g", "o-gram-g", "o-symbol-tip")
REFERENCE_KIND = "cross-reference"
CHILD_HEADS = {"o-idiom": "o-idm", "o-phrasal": "o-pv", "o-relation-item": "o-dr"}

_APOSTROPHES = ("'", "’")


#: Columns of a placed node; what only the parse needs is left behind.
_PLACES = ("rec", "pre", "last", "parent", "tag", "classes", "parent_classes", "href", "sounds_for", "pruned", "text_spaced", "text_joined", "up")


#: Elements and columns that single operators need of the records; they parse no others into rows.
AUDIO_LINKS = ENTRY_PROFILE.only(("<a>",), ("pre", "tag", "href"))
CHUNKS = ENTRY_PROFILE.only(("<a>", "o-pron-geo", "o-pron-phon"), ("pre", "tag", "classes", "href", "pruned", "text_spaced"), ("panel", "child", "chunk", "pron_set"))
SOUND_SETS = replace(CHUNKS, rows=(*CHUNKS.rows, "o-pronunciation-set"), fields=(*CHUNKS.fields, "sounds_for"))
EXAMPLE_ITEMS = ENTRY_PROFILE.only(("<li>",), ("pre", "parent", "tag", "parent_classes", "pruned"), ("panel", "collection", "box"))
EXAMPLES = ENTRY_PROFILE.only(("<li>", "o-example-eng", "o-example-simp"), ("pre", "parent", "tag", "classes", "pruned", "text_joined"), ("sense", "example_list", "sense_list", "item"))
READ_EXAMPLES = ENTRY_PROFILE.only(
    (*EXAMPLES.rows, "o-pos-panel", "o-pos-tag", "o-pos-detail", "o-sense", *EMBEDDED),
    (*EXAMPLES.fields, "parent_classes", "text_spaced"), ("sense", "example_list", "sense_list", "item", "panel", "child", "relations"),
)
LINKS = ENTRY_PROFILE.only(
    ("<a>", "o-ref-label", "o-ref-text"), ("pre", "tag", "classes", "href", "pruned", "text_spaced"),
    ("panel", "sense", "child", "ref", "li_sense", "relation_head", "reference"),
)
#: All that the operators of entries look at.
_TEXTS = (
    "<a>", "<chn>", "o-head-main", "o-h", "o-headword", "o-pos-tag", "o-pron-geo", "o-pron-phon", "o-tag", *[c for c, _ in LABEL_CLASSES], "o-ref-label", "o-ref-text",
    "o-sn-g", "o-def-eng", "o-def-simp", "o-eng", "o-simp", "o-idm", "o-pv", "o-dr", "o-relation-head-link", "o-shortcut-title", "phon", "def",
)
ENTRY_NODES = replace(
    ENTRY_PROFILE,
    rows=(*_TEXTS, "<main>", "<li>", "o-example-eng", "o-example-simp", "o-pos-panel", "o-pos-detail", "o-sense", "o-sense-define", "o-multiple-sense", "o-shortcut", "o-pronunciation-set", *EMBEDDED),
    fields=("pre", "last", "parent", "tag", "classes", "parent_classes", "href", "sounds_for", "pruned", "text_spaced", "text_joined"),
    spaced=_TEXTS, joined=("o-example-eng", "o-example-simp"),
)
#: Marks of nodes above that are asked for by their own names; others are columns of placed nodes.
KEPT_MARKS = ("sense", "sense_head", "relations", "relation_head", "relation_pos", "reference", "example_list", "shortcut", "head_main", "phons_br", "phons_n_am", "sensetop", "li_sense", "sense_list", "item")
PANELS = ENTRY_PROFILE.only(("o-pos-panel", "o-pos-tag", "o-pos-detail", "o-sense", "o-phrasal", "o-idiom"), ("pre", "classes", "parent_classes", "pruned", "text_spaced"), ("panel",))
PANELS = replace(PANELS, spaced=("o-pos-tag",))


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes with where they stand, as numbers, as far as they have the columns and marks for it."""
    marks = set(nodes.schema["up"].dataType.names)
    own = lambda mark, *classes: (mark, lambda: own_or_nearest(mark, *classes), ("classes",))
    above = lambda mark: (mark, lambda: nearest(mark), ())
    places = {
        "panel": own("panel", "o-pos-panel"), "sense": own("sense", "o-sense"), "child": own("child", *EMBEDDED), "child_above": above("child"),
        "chunk": own("chunk", "o-pron-chunk"), "pron_set": above("pron_set"), "ref": above("ref"),
    }
    known = [make().alias(name) for name, (mark, make, needs) in places.items() if mark in marks and set(needs) <= set(nodes.columns)]
    if {"box", "collection", "panel"} <= marks:
        known.append((below("box") | F.coalesce(nearest("collection") == nearest("panel"), F.lit(False))).alias("excluded"))
    kept = [nearest(mark).alias(mark) for mark in nodes.schema["up"].dataType.names if mark in KEPT_MARKS]
    up = F.struct(*kept).alias("up") if kept else F.col("up")
    return nodes.where("error is null").select(*[c for c in _PLACES if c in nodes.columns and c != "up"], up, *known)


def first_text(when: Column, value: Column | None = None) -> Column:
    """Cleaned text of the first row, in document order, for which ``when`` holds."""
    return text.clean_text(F.min_by(F.when(when, F.col("text_spaced") if value is None else value), F.when(when, F.col("pre"))))


def headwords(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``rec, headword``: first of ``.o-head-main .o-h`` and ``.o-head-main``, else the record's key."""
    fits = has("o-head-main") | (has("o-h") & below("head_main"))
    found = nodes.where(~F.col("pruned") & fits).groupBy("rec").agg(text.clean_headword(F.min_by("text_spaced", "pre")).alias("found"))
    keys = records.select(F.col("record_number").alias("rec"), text.clean_headword(F.col("key")).alias("key"))
    return found.join(keys, "rec").select("rec", F.coalesce(F.when(F.col("found") != "", F.col("found")), "key").alias("headword"))


def panels(nodes: DataFrame) -> DataFrame:
    """``rec, panel, pos, is_phrase, number, detail_pre`` of the panels that become entries.

    A panel with a part of speech has that; else a phrase panel has its phrase's kind, a
    panel with a direct sense is an ``entry``, and others but collections are phrases,
    if they have one. ``number`` is the N of ``o-for-pos-N``, the smallest of several.
    """
    own = F.col("pre") == F.col("panel")
    tag = has("o-pos-tag") & parent_has("o-pos-detail")
    tells = own | has("o-pos-tag", "o-pos-detail", "o-sense", "o-phrasal", "o-idiom")
    live = nodes.where(~F.col("pruned") & F.col("panel").isNotNull() & tells)
    number = F.array_min(F.transform(F.filter("classes", lambda c: c.startswith("o-for-pos-")), lambda c: F.substr(c, F.lit(11))))
    facts = live.groupBy("rec", "panel").agg(
        first_text(tag).alias("tag"),
        F.max(F.when(own, has("o-phrase-panel"))).alias("phrase_panel"),
        F.max(F.when(own, has(*COLLECTIONS))).alias("collection"),
        F.max(has("o-sense") & parent_has("o-pos-detail")).alias("direct_sense"),
        F.max(has("o-phrasal")).alias("phrasal"),
        F.max(has("o-idiom")).alias("idiom"),
        F.min(F.when(has("o-pos-detail"), F.col("pre"))).alias("detail_pre"),
        F.min(F.when(own, number)).alias("number"),
    )
    kind = F.when(F.col("phrasal"), "phrasal verb").when(F.col("idiom"), "idiom")
    pos = (
        F.when(F.col("tag").isNotNull(), F.col("tag"))
        .when(F.col("phrase_panel"), kind)
        .when(F.col("direct_sense"), "entry")
        .when(~F.col("collection"), kind)
    )
    phrase = F.col("tag").isNull() & (F.col("phrase_panel") | ~F.col("direct_sense"))
    return facts.select("rec", "panel", pos.alias("pos"), phrase.alias("is_phrase"), "number", "detail_pre").where("pos is not null")


def number_entries(accepted: DataFrame) -> DataFrame:
    """Local numbers 1..n of a record's panels in document order, and the packed ids."""
    w = Window.partitionBy("rec").orderBy("panel")
    numbered = accepted.withColumn("local", F.row_number().over(w))
    return numbered.withColumn("entry_id", text.pack_entry_id(F.col("rec"), F.col("local")))


def record_kinds(nodes: DataFrame, dict_id: str) -> DataFrame:
    """``rec, has_main, is_phrase_record, supplemental`` from the main element's classes."""
    main = F.col("tag") == "main"
    return nodes.groupBy("rec").agg(
        F.max(main & has(f"{dict_id}-entry")).alias("has_main"),
        F.max(main & has(f"{dict_id}-phrase-entry")).alias("is_phrase_record"),
        F.max(main & has(f"{dict_id}-supplemental-entry")).alias("supplemental"),
    )


def audio_links(nodes: DataFrame) -> DataFrame:
    """``rec, pre, name`` of all word-audio links, those in pruned boxes included."""
    name = text.media_name(href())
    return nodes.select("rec", "pre", name.alias("name")).where("name is not null")


def audio_references(nodes: DataFrame) -> DataFrame:
    return audio_links(nodes).select("rec", "name").distinct()


def chunks(nodes: DataFrame) -> DataFrame:
    """``rec, chunk, pron_set, panel, child_above, region, notation, file``; none without notation."""
    live = nodes.where(~F.col("pruned") & F.col("chunk").isNotNull())
    audio = F.when(href(text.WORD_AUDIO).isNotNull(), text.media_name(href()))
    link = audio.isNotNull()
    found = live.groupBy("rec", "chunk", "pron_set", "panel", "child_above").agg(
        first_text(has("o-pron-geo")).alias("geo"),
        first_text(has("o-pron-phon")).alias("notation"),
        F.min_by(F.when(link, audio), F.when(link, F.col("pre"))).alias("file"),
    )
    region = text.region_code(F.coalesce("geo", F.lit("")))
    return found.where("notation <> ''").select("rec", "chunk", "pron_set", "panel", "child_above", region.alias("region"), "notation", "file")


def pronunciations(found: DataFrame, owner: list[str], dict_id: str) -> DataFrame:
    """``owner, pronunciation``: each owner's distinct sounds in order; needs ``ord``."""
    kept = dedupe_first(found, [*owner, "region", "notation", "file"], ["ord"])
    url = text.media_url(dict_id, F.col("file"))
    item = F.struct("ord", F.struct("region", "notation", url.alias("audio_url")).alias("p"))
    return kept.groupBy(*owner).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("pronunciation"))


def set_sounds(nodes: DataFrame) -> DataFrame:
    """``rec, number, region, notation, file, ord`` of the pronunciation sets; of a number the last set wins."""
    sets = nodes.where(has("o-pronunciation-set") & F.col("sounds_for").isNotNull() & ~F.col("pruned"))
    last = sets.groupBy("rec", F.col("sounds_for").alias("number")).agg(F.max("pre").alias("pron_set"))
    found = chunks(nodes).where("pron_set is not null").join(last, ["rec", "pron_set"])
    return found.select("rec", "number", "region", "notation", "file", F.struct(F.lit(0).alias("src"), F.col("chunk").alias("at")).alias("ord"))


def root_sounds(nodes: DataFrame) -> DataFrame:
    """``rec, panel, ...`` of sounds in a panel's detail that no embedded entry has."""
    inside = chunks(nodes).where("panel is not null and child_above is null and pron_set is null")
    return inside.select("rec", "panel", "region", "notation", "file", F.struct(F.lit(1).alias("src"), F.col("chunk").alias("at")).alias("ord"))


def panel_pronunciations(nodes: DataFrame, accepted: DataFrame, dict_id: str) -> DataFrame:
    """``rec, panel, pronunciation``: the set of the panel's number, then its own sounds."""
    sets = accepted.select("rec", "panel", "number").join(set_sounds(nodes), ["rec", "number"]).drop("number")
    both = sets.unionByName(accepted.select("rec", "panel").join(root_sounds(nodes), ["rec", "panel"]))
    return pronunciations(both, ["rec", "panel"], dict_id)


def example_items(nodes: DataFrame) -> DataFrame:
    """``rec, pre, list_pre, excluded, pruned`` of every item of an example list, pruned ones included."""
    items = nodes.where((F.col("tag") == "li") & parent_has("o-example-list"))
    return items.select("rec", "pre", F.col("parent").alias("list_pre"), "excluded", "pruned")


def examples(nodes: DataFrame) -> DataFrame:
    """``rec, sense, list_pre, item, en, zh`` of items of lists directly below a sense; sides may be empty.

    An item and the texts in it know the item's number, so it is one aggregate.
    """
    item = (F.col("tag") == "li") & F.coalesce(nearest("sense_list") == F.col("parent"), F.lit(False))
    side = has("o-example-eng", "o-example-simp") & (nearest("item") > nearest("example_list"))
    english = F.when(~item, has("o-example-eng"))
    rows = nodes.where(~F.col("pruned") & (item | side)).select(
        "rec", F.when(item, F.col("pre")).otherwise(nearest("item")).alias("item"), F.when(item, nearest("sense")).alias("sense"), F.when(item, F.col("parent")).alias("list_pre"),
        F.col("pre").alias("at"), english.alias("english"), F.when(~item, text.clean_text(F.col("text_joined"))).alias("t"),
    )
    first = lambda want: F.coalesce(F.min_by(F.when(want, F.col("t")), F.when(want, F.col("at"))), F.lit(""))
    found = rows.groupBy("rec", "item").agg(F.max("sense").alias("sense"), F.max("list_pre").alias("list_pre"), first(F.col("english")).alias("en"), first(~F.col("english")).alias("zh"))
    return found.where("sense is not null").select("rec", "sense", "list_pre", "item", "en", "zh")


def labels(nodes: DataFrame) -> DataFrame:
    """``rec, sense, labels``: the sense head's labels by bucket.

    Inside a bucket the order is that of the classes, then of the document.
    """
    live = nodes.where(~F.col("pruned") & below("sense_head") & F.col("sense").isNotNull())
    ranked = [F.when(has(c), F.struct(F.lit(i).alias("rank"), F.lit(b).alias("bucket"))) for i, (c, b) in enumerate(LABEL_CLASSES)]
    rest = F.when(has("o-tag") & ~has(*IGNORED_TAGS) & ~has(*[c for c, _ in LABEL_CLASSES]), F.struct(F.lit(len(ranked)).alias("rank"), F.lit("note").alias("bucket")))
    marks = live.select("rec", "sense", "pre", "text_spaced", F.explode(F.array_compact(F.array(*ranked, rest))).alias("m"))
    item = F.struct(F.col("m.rank").alias("rank"), "pre", F.col("m.bucket").alias("bucket"), F.col("text_spaced").alias("t"))
    got = marks.groupBy("rec", "sense").agg(F.array_sort(F.collect_list(item)).alias("all"))
    bucket = lambda b: text.clean_label_list(F.transform(F.filter("all", lambda x: x["bucket"] == b), lambda x: x["t"]))
    return got.select("rec", "sense", F.struct(*[bucket(b).alias(b) for b in BUCKETS]).alias("labels"))


def no_labels() -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(*[empty.alias(b) for b in BUCKETS])


def references(nodes: DataFrame) -> DataFrame:
    """``rec, pre, sense, panel, child, relation_head, in_reference, target, display, relation`` of entry links."""
    label, link = has("o-ref-label", "o-ref-text") & F.col("ref").isNotNull(), href(text.ENTRY_LINK).isNotNull()
    rows = nodes.where(~F.col("pruned") & (label | link)).select(
        "rec", "pre", "sense", "panel", "child", "ref", nearest("li_sense").alias("li_sense"), below("relation_head").alias("relation_head"), below("reference").alias("in_reference"),
        F.when(link, text.link_target(href())).alias("target"), text.clean_headword(F.col("text_spaced")).alias("shown"), F.when(label, F.col("text_spaced")).alias("label"),
    )
    over = Window.partitionBy("rec", "ref").orderBy(F.col("label").isNull(), "pre")  # a reference's labels come first
    relation = F.when(F.col("ref").isNotNull(), text.clean_text(F.first("label").over(over)))
    links = rows.withColumn("relation", relation).where("target <> ''")
    relation = F.when(~F.col("relation").isin("=", "→", ""), F.col("relation"))
    display = F.when(F.col("shown") != "", F.col("shown")).otherwise(F.col("target"))
    return links.select("rec", "pre", "sense", "panel", "child", "li_sense", "relation_head", "in_reference", "target", display.alias("display"), relation.alias("relation"))


def distinct_references(links: DataFrame, owner: list[str]) -> DataFrame:
    """First of each (target, display, relation) of an owner; the first two caseless."""
    keyed = links.withColumn("_t", text.casefold(F.col("target"))).withColumn("_d", text.casefold(F.col("display")))
    return dedupe_first(keyed, [*owner, "_t", "_d", "relation"], ["pre"]).drop("_t", "_d")


def listed_references(links: DataFrame, owner: list[str]) -> DataFrame:
    item = F.struct("pre", F.struct("target", "display", "relation").alias("r"))
    return distinct_references(links, owner).groupBy(*owner).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("links"))


def _xref(x: Column, own: Column) -> Column:
    return F.struct(F.lit(REFERENCE_KIND).alias("kind"), x["target"].alias("target"), x["display"].alias("display"), x["relation"].alias("relation"), own.alias("labels"))


def panel_references(nodes: DataFrame) -> DataFrame:
    """``rec, panel, target, display, relation, pre``: links of a panel outside all senses and embedded entries."""
    free = references(nodes).where("in_reference and sense is null and child is null and panel is not null")
    return distinct_references(free, ["rec", "panel"])


def senses(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per sense: where it stands, ``index, labels, definition, examples, cross_references``.

    In a root sense of a headword with an apostrophe an English-only definition becomes
    the first reference. ``empty`` senses carry nothing and are kept for counting.
    """
    in_define = parent_has("o-sense-define")
    said = nodes.where(~F.col("pruned") & F.col("sense").isNotNull() & has("o-sn-g", "o-def-eng", "o-def-simp")).groupBy("rec", "sense").agg(
        first_text(has("o-sn-g") & below("sense_head")).alias("number"), first_text(has("o-def-eng") & in_define).alias("en"), first_text(has("o-def-simp") & in_define).alias("zh"),
    )
    base = sense_places(nodes).join(said, ["rec", "sense"], "left").withColumn("en", F.coalesce("en", F.lit(""))).withColumn("zh", F.coalesce("zh", F.lit("")))
    pairs = examples(nodes).where("en <> '' and zh <> ''").groupBy("rec", "sense").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", F.struct("en", "zh").alias("e")))), lambda x: x["e"]).alias("examples"))
    links = listed_references(references(nodes).where("sense is not null"), ["rec", "sense"])
    full = base.join(labels(nodes), ["rec", "sense"], "left").join(pairs, ["rec", "sense"], "left").join(links, ["rec", "sense"], "left").join(heads, "rec", "left")
    own_labels = F.coalesce("labels", no_labels())
    apostrophe = F.coalesce(F.col("headword").contains(_APOSTROPHES[0]) | F.col("headword").contains(_APOSTROPHES[1]), F.lit(False))
    short = (F.col("en") != "") & (F.col("zh") == "") & apostrophe & F.col("root")
    given = F.coalesce(F.transform("links", lambda x: _xref(x, own_labels)), F.array().cast(f"array<{XREF}>"))
    added = F.array(F.struct(F.lit(REFERENCE_KIND).alias("kind"), text.clean_headword(F.col("en")).alias("target"), F.col("en").alias("display"), F.lit("short form of").alias("relation"), own_labels.alias("labels")))
    out = full.select(
        "rec", "sense", "panel", "child", "group", "direct", "parent", "en", "zh", "root", short.alias("short_form"),
        text.sense_index(F.col("number")).alias("index"),
        own_labels.alias("labels"),
        F.when((F.col("en") != "") & (F.col("zh") != ""), F.struct("en", "zh")).alias("definition"),
        F.coalesce("examples", F.array().cast(f"array<{EN_ZH}>")).alias("examples"),
        F.when(short, F.concat(added, given)).otherwise(given).alias("cross_references"),
    )
    return out.withColumn("empty", F.col("definition").isNull() & (F.size("examples") == 0) & (F.size("cross_references") == 0))


def drop_empty_senses(found: DataFrame) -> DataFrame:
    return found.where(~F.col("empty"))


def _sense() -> Column:
    return F.struct(F.lit("sense").alias("kind"), "index", "labels", "definition", "examples", "cross_references").cast(SENSE)


def _node(x: Column) -> Column:
    names = ("kind", "index", "labels", "definition", "examples", "cross_references")
    return F.struct(*[x[n].alias(n) for n in names], F.lit(None).cast(EN_ZH).alias("title"), F.lit(None).cast(f"array<{SENSE}>").alias("senses")).cast(NODE)


def groups(nodes: DataFrame) -> DataFrame:
    """``rec, panel, group, title`` of titled groups directly below a detail; titles may be blank."""
    own = has("o-multiple-sense") & has("o-shortcut") & parent_has("o-pos-detail") & ~F.col("pruned")
    found = nodes.where(own).select("rec", "panel", F.col("pre").alias("group"))
    sides = nodes.where(~F.col("pruned") & has("o-eng", "o-simp") & parent_has("o-shortcut-title")).select("rec", nearest("shortcut").alias("group"), "pre", has("o-eng").alias("english"), "text_spaced")
    texts = sides.groupBy("rec", "group").agg(first_text(F.col("english")).alias("en"), first_text(~F.col("english")).alias("zh"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return found.join(texts, ["rec", "group"], "left").select("rec", "panel", "group", F.struct(blank("en").alias("en"), blank("zh").alias("zh")).alias("title"))


def root_senses(found: DataFrame, titled: DataFrame) -> DataFrame:
    """``rec, panel, sense``: a panel's direct senses and groups, in document order.

    A direct sense stands for itself, a group's senses stand where the group does; groups
    that aren't ``titled`` are left out, titled ones without senses stay.
    """
    kept = drop_empty_senses(found).where("child is null and (direct or group is not null)")
    units = kept.groupBy("rec", F.coalesce(F.when(~F.col("direct"), F.col("group")), F.col("sense")).alias("at")).agg(
        F.max("panel").alias("own_panel"), F.max("direct").alias("direct"),
        F.transform(F.array_sort(F.collect_list(F.struct("sense", _sense().alias("s"))), _by("sense")), lambda x: x["s"]).alias("senses"),
    )
    null = lambda t: F.lit(None).cast(t)
    group = F.struct(
        F.lit("group").alias("kind"), null("string").alias("index"), null(LABELS).alias("labels"), null(EN_ZH).alias("definition"),
        null(f"array<{EN_ZH}>").alias("examples"), null(f"array<{XREF}>").alias("cross_references"), F.col("title"),
        F.coalesce("senses", F.array().cast(f"array<{SENSE}>")).alias("senses"),
    ).cast(NODE)
    full = units.join(titled.select("rec", "panel", F.col("group").alias("at"), "title"), ["rec", "at"], "full")
    node = F.when(F.col("title").isNotNull(), group).when(F.col("direct"), _node(F.col("senses")[0]))
    placed_ = full.select("rec", F.coalesce("panel", "own_panel").alias("panel"), "at", node.alias("node")).where("node is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "node")), _by("at")), lambda x: x["node"])
    return placed_.groupBy("rec", "panel").agg(ordered.alias("sense"))


def _by(field: str):
    """Order of structs by one field; the others may be of kinds that don't compare."""
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def boxes(nodes: DataFrame) -> DataFrame:
    """``rec, panel, child, role`` of the embedded entries of panels, one row for each role that one has."""
    roles = F.array_compact(F.array(
        F.when(has("o-idiom"), F.lit("o-idiom")), F.when(has("o-phrasal"), F.lit("o-phrasal")),
        F.when(has("o-relation-item") & below("relations"), F.lit("o-relation-item")),
    ))
    live = nodes.where(~F.col("pruned") & has(*EMBEDDED) & F.col("panel").isNotNull())
    return live.select("rec", "panel", F.col("pre").alias("child"), F.explode(roles).alias("role"))


def parsed_boxes(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """``boxes`` that are read: all of ordinary panels, of a phrase panel the first of its kind, which is ``promoted``."""
    each = boxes(nodes).join(accepted.select("rec", "panel", "pos", "is_phrase"), ["rec", "panel"])
    kind = F.when(F.col("role") == "o-idiom", "idiom").when(F.col("role") == "o-phrasal", "phrasal verb")
    first = each.where(F.col("is_phrase") & (kind == F.col("pos"))).groupBy("rec", "panel").agg(F.min_by("role", "child").alias("role"), F.min("child").alias("child"))
    rest = each.where("not is_phrase").select("rec", "panel", "child", "role", F.lit(False).alias("promoted"))
    return rest.unionByName(first.select("rec", "panel", "child", "role", F.lit(True).alias("promoted")))


def sense_places(nodes: DataFrame) -> DataFrame:
    """``rec, sense, panel, child, parent, group, direct, root``: where senses stand, and nothing of what they say.

    ``root`` senses are direct children of a panel's detail, or of a group, outside embedded entries.
    """
    own = nodes.where(~F.col("pruned") & has("o-sense"))
    group = F.when(parent_has("o-multiple-sense", "o-shortcut"), F.col("parent"))
    direct = parent_has("o-pos-detail")
    root = F.col("child_above").isNull() & (direct | group.isNotNull())
    return own.select("rec", F.col("pre").alias("sense"), "panel", F.col("child_above").alias("child"), "parent", group.alias("group"), direct.alias("direct"), root.alias("root"))


def parsed_senses(found: DataFrame, accepted: DataFrame, read: DataFrame) -> DataFrame:
    """``rec, sense, times``: how often each sense of ``sense_places`` is read, those never read left out.

    Root senses of ordinary panels are read once, an embedded entry's direct senses once
    for each role it is read in.
    """
    ordinary = accepted.where("not is_phrase").select("rec", "panel", F.lit(1).cast("long").alias("_root"))
    roles = read.groupBy("rec", "child").agg(F.count("*").alias("_roles"))
    placed_ = found.join(ordinary, ["rec", "panel"], "left").join(roles, ["rec", "child"], "left")
    times = F.when(F.col("root"), F.col("_root")).when(F.col("parent") == F.col("child"), F.col("_roles"))
    return placed_.select("rec", "sense", times.alias("times")).where("times is not null")


def child_rows(nodes: DataFrame, found: DataFrame, read: DataFrame, dict_id: str) -> DataFrame:
    """A row for each embedded entry that is read, and role, before any is dropped as a repeat.

    ``headword`` is null where there is neither a head nor, but for derivatives, a title.
    """
    live = nodes.where(~F.col("pruned"))
    inner = live.where(F.col("child_above").isNotNull()).withColumn("child", F.col("child_above")).groupBy("rec", "child").agg(
        first_text(has("o-idm")).alias("o-idiom"),
        first_text(has("o-pv")).alias("o-phrasal"),
        first_text((has("o-dr") & below("relation_head")) | has("o-relation-head-link")).alias("o-relation-item"),
        first_text(has("o-shortcut-title") & (F.col("parent") == F.col("child_above"))).alias("title"),
        first_text(has("o-pos-tag") & below("relation_pos")).alias("tag"),
    )
    named = F.when(F.col("role") == "o-idiom", F.col("o-idiom")).when(F.col("role") == "o-phrasal", F.col("o-phrasal")).otherwise(F.col("o-relation-item"))
    derived = F.col("role") == "o-relation-item"
    own = drop_empty_senses(found).where("child is not null and parent = child")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sense", _sense().alias("s"))), _by("sense")), lambda x: _node(x["s"]))
    inside = own.groupBy("rec", "child").agg(listed.alias("sense"))
    said = chunks(nodes).where("child_above is not null").select("rec", F.col("child_above").alias("child"), "region", "notation", "file", F.struct(F.lit(0).alias("src"), F.col("chunk").alias("at")).alias("ord"))
    said = pronunciations(said, ["rec", "child"], dict_id)
    links = references(nodes).where("child is not null and sense is null and (relation_head or in_reference)")
    links = listed_references(links, ["rec", "child"])
    full = read.join(inner, ["rec", "child"], "left").join(inside, ["rec", "child"], "left").join(said, ["rec", "child"], "left").join(links, ["rec", "child"], "left")
    return full.select(
        "rec", "panel", "child", "role", "promoted", text.clean_headword(F.coalesce(named, F.when(~derived, F.col("title")))).alias("headword"),
        F.when(derived, F.col("tag")).alias("pos"),
        F.coalesce("pronunciation", F.array().cast(f"array<{PRON}>")).alias("pronunciation"),
        F.coalesce("sense", F.array().cast(f"array<{NODE}>")).alias("sense"),
        F.coalesce(F.transform("links", lambda x: _xref(x, no_labels())), F.array().cast(f"array<{XREF}>")).alias("cross_references"),
    )


def children(rows: DataFrame) -> DataFrame:
    """``rec, panel, at, role, promoted, entry``: idioms, phrasal verbs and derivatives, in document order.

    Idioms and phrasal verbs are kept once by (caseless headword, first sense);
    derivatives all. A child's own senses are its direct children.
    """
    first = F.coalesce(F.to_json(F.try_element_at("sense", F.lit(1))), F.lit(""))
    alone = F.when(F.col("role") == "o-relation-item", F.col("child"))
    keyed = rows.withColumn("_k", text.casefold(F.coalesce("headword", F.lit("")))).withColumn("_s", first).withColumn("_a", alone)
    kept = dedupe_first(keyed, ["rec", "panel", "role", "_k", "_s", "_a"], ["child"])
    entry = F.struct("headword", "pos", "pronunciation", "sense", "cross_references").cast(CHILD)
    return kept.select("rec", "panel", F.col("child").alias("at"), "role", "promoted", entry.alias("entry"))


class Layout:
    """What several operators take from the nodes of records, each worked out when it is first asked for.

    Where ``nodes`` lie in ``buckets`` by record, so does what is written here.
    """

    def __init__(self, nodes: DataFrame, records: DataFrame, dict_id: str, buckets: int | None = None):
        self.nodes, self.records, self.dict_id, self.buckets = nodes, records, dict_id, buckets

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return bucketed(df, name, "rec", self.buckets) if self.buckets else saved(df, name)

    @cached_property
    def heads(self) -> DataFrame:
        return self._kept(headwords(self.nodes, self.records), "headwords")

    @cached_property
    def panels(self) -> DataFrame:
        return self._kept(panels(self.nodes), "panels")

    @cached_property
    def local(self) -> DataFrame:
        return number_entries(self.panels).select("rec", "panel", F.col("local").cast("long").alias("local"))

    @cached_property
    def senses(self) -> DataFrame:
        return self._kept(senses(self.nodes, self.heads), "senses")

    @cached_property
    def read(self) -> DataFrame:
        return self._kept(parsed_boxes(self.nodes, self.panels), "read")

    @cached_property
    def times(self) -> DataFrame:
        return self._kept(parsed_senses(sense_places(self.nodes), self.panels, self.read), "times")

    @cached_property
    def rows(self) -> DataFrame:
        return self._kept(child_rows(self.nodes, self.senses, self.read, self.dict_id), "children")

    @cached_property
    def supplements(self) -> DataFrame:
        return self._kept(supplemental(self.nodes, self.records, self.dict_id), "supplements")

    @cached_property
    def failed(self) -> DataFrame:
        return self._kept(failures(self), "failed")

    @cached_property
    def metrics(self) -> DataFrame:
        return self._kept(record_metrics(self), "metrics")

    def part(self, kept: DataFrame, records: DataFrame) -> Layout:
        """The layout of some of the records. All that was worked out is by record: it is filtered, not worked out again."""
        kept = self._kept(kept, "kept")
        of = lambda df: df.join(kept, "rec", "left_semi")
        x = Layout(of(self.nodes), records, self.dict_id, self.buckets)
        x.__dict__ |= {name: of(getattr(self, name)) for name in ("heads", "panels", "senses", "read", "times", "rows", "supplements", "failed", "metrics")}
        return x


def failures(x: Layout) -> DataFrame:
    """``rec, reason`` of records that give nothing: the first rule of these that they break.

    Each fact about a record is a row with its name, and one aggregate by record has them all.
    """
    nodes = x.nodes
    kinds = record_kinds(nodes, x.dict_id)
    some = x.panels.groupBy("rec").agg(F.count("*").alias("n"), F.max(F.col("detail_pre").isNull()).alias("no_detail"))
    define = nodes.where(has("o-sense-define") & parent_has("o-sense")).select("rec", F.col("parent").alias("sense"))
    nameless = x.rows.where("headword is null")
    facts = {
        "record": x.records.select(F.col("record_number").alias("rec")), "main": kinds.where("has_main"), "second": kinds.where("supplemental"),
        "panels": some, "too many": some.where(F.col("n") > text.MAX_LOCAL), "no detail": some.where("no_detail"),
        "head": nodes.where(has("o-head-main") & ~F.col("pruned")), "unsafe": audio_links(nodes).where(~text.is_safe_reference(F.col("name"))),
        "bare": x.times.join(define, ["rec", "sense"], "left_anti"), "no child head": nameless.where("role <> 'o-relation-item'"), "no derived head": nameless.where("role = 'o-relation-item'"),
        "second head": supplemental_heads(nodes, x.dict_id), "bilingual": x.supplements.where("definition is not null"),
    }
    rows = reduce(DataFrame.unionByName, [df.select("rec", F.lit(name).alias("fact")) for name, df in facts.items()])
    got = rows.groupBy("rec").agg(F.collect_set("fact").alias("facts")).where(F.array_contains("facts", "record"))
    is_ = lambda name: F.array_contains("facts", name)
    plain = ~is_("second")
    reason = (
        F.when(is_("unsafe"), "unsafe media name")
        .when(~is_("main") | (plain & ~is_("head")), "not an entry")
        .when(~plain & ~is_("second head"), "supplemental record without headword")
        .when(~plain & ~is_("bilingual"), "supplemental record without bilingual sense")
        .when(plain & ~is_("panels"), "no panel")
        .when(plain & is_("too many"), "too many panels")
        .when(plain & is_("no detail"), "no detail")
        .when(plain & is_("bare"), "sense without definition block")
        .when(plain & is_("no child head"), "embedded entry without headword")
        .when(plain & is_("no derived head"), "derivative without headword")
    )
    return got.select("rec", reason.alias("reason")).where("reason is not null")


def assemble(x: Layout) -> DataFrame:
    """The nested entries of all sound records, of both layouts, with ``rec, local``.

    What belongs to a panel, and what to its record (panel -1), are rows of one table,
    dealt by record; one aggregate by (record, panel) puts entries together, and windows
    over the record add its own facts and number its entries.
    """
    small = children(x.rows)
    item = F.struct("pre", F.struct("target", "display", "relation").alias("r"))
    links = panel_references(x.nodes).groupBy("rec", "panel").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("links"))
    of_record = lambda df, *columns: df.select("rec", F.lit(-1).alias("panel"), *columns)
    parts = (
        x.panels.select("rec", "panel", "pos", "is_phrase"), root_senses(x.senses, groups(x.nodes)), small.select("rec", "panel", F.struct("at", "role", "promoted", "entry").alias("child")),
        links, panel_pronunciations(x.nodes, x.panels, x.dict_id),
        of_record(x.heads, "headword"), of_record(record_kinds(x.nodes, x.dict_id), "is_phrase_record", "supplemental"), of_record(x.failed, F.lit(True).alias("failed")),
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.repartition(x.buckets, "rec") if x.buckets else rows.repartition("rec")
    single = ("pos", "is_phrase", "sense", "links", "pronunciation", "headword", "is_phrase_record", "supplemental", "failed")
    whole = rows.groupBy("rec", "panel").agg(*[F.first(c, ignorenulls=True).alias(c) for c in single], F.collect_list("child").alias("children"))
    over = Window.partitionBy("rec")
    whole = whole.select("*", *[F.max(c).over(over).alias(f"rec_{c}") for c in ("headword", "is_phrase_record", "supplemental", "failed")])
    sound = whole.where("pos is not null and rec_supplemental = false and rec_failed is null")
    numbered = number_entries(sound)
    kids = lambda test: F.transform(F.array_sort(F.filter("children", test), _by("at")), lambda c: c["entry"])
    of = lambda role: kids(lambda c: (c["role"] == role) & ~c["promoted"])
    numbered = numbered.withColumn("phrase", F.try_element_at(kids(lambda c: c["promoted"]), F.lit(1)))
    phrase = F.col("is_phrase")
    or_empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    unless = lambda c: or_empty(F.when(~phrase, c), CHILD)
    given = F.transform("links", lambda x: _xref(x, no_labels()))
    plain = numbered.select(
        "rec", F.col("local").cast("long").alias("local"), F.lit(x.dict_id).alias("dict_id"), "entry_id",
        F.when(phrase, F.coalesce(F.when(F.col("phrase.headword") != "", F.col("phrase.headword")), "rec_headword")).otherwise(F.col("rec_headword")).alias("headword"),
        F.lit(x.dict_id).alias("page"), F.col("pos").alias("section"),
        F.when(phrase | F.col("rec_is_phrase_record"), "phrase").otherwise("word").alias("entry_type"), "pos",
        or_empty("pronunciation", PRON).alias("pronunciation"),
        or_empty(F.when(phrase, F.col("phrase.sense")).otherwise(F.col("sense")), NODE).alias("sense"),
        unless(of("o-idiom")).alias("child_idioms"),
        unless(of("o-phrasal")).alias("child_phrasal_verbs"),
        unless(of("o-relation-item")).alias("child_derivatives"),
        or_empty(F.when(phrase, F.col("phrase.cross_references")).otherwise(given), XREF).alias("cross_references"),
    )
    return plain.unionByName(supplemental_entries(x.supplements.join(x.failed, "rec", "left_anti"), x.dict_id))


def supplemental_heads(nodes: DataFrame, dict_id: str) -> DataFrame:
    """``rec, h`` of records of the second layout that have a head; h may be blank."""
    main = nodes.where((F.col("tag") == "main") & has(f"{dict_id}-supplemental-entry")).select("rec", F.col("pre").alias("main"), F.col("last").alias("main_last"))
    heads = nodes.where(~F.col("pruned") & has("o-headword")).join(main, "rec").where("pre between main + 1 and main_last")
    return heads.groupBy("rec").agg(text.clean_headword(F.min_by("text_spaced", "pre")).alias("h"))


def supplemental(nodes: DataFrame, records: DataFrame, dict_id: str) -> DataFrame:
    """Senses of the second layout: ``rec, sense, headword, pronunciation, en, zh, definition, cross_references``.

    A sense with one side only has no definition and gives no sense to the entry; its
    links are counted all the same.
    """
    kinds = record_kinds(nodes, dict_id).where("supplemental").select("rec")
    live = nodes.where(~F.col("pruned")).join(kinds, "rec", "left_semi")
    keys = records.select(F.col("record_number").alias("rec"), "key")
    region = F.when(below("phons_br"), "UK").when(below("phons_n_am"), "US")
    said = live.where(has("phon")).select("rec", "pre", region.alias("region"), text.clean_text(F.col("text_spaced")).alias("notation")).where("region is not null and notation <> ''")
    rank = F.when(F.col("region") == "UK", 0).otherwise(1)
    said = said.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "pre", "region", "notation"))), lambda x: F.struct(x["region"].alias("region"), x["notation"].alias("notation"), F.lit(None).cast("string").alias("audio_url"))).alias("pronunciation"))
    own = live.where((F.col("tag") == "li") & has("sense") & parent_has("sense_single")).select("rec", F.col("pre").alias("li"))
    texts = live.where(below("sensetop") & ((has("def") & parent_has("sensetop")) | (F.col("tag") == "chn")))
    texts = texts.select("rec", nearest("li_sense").alias("li"), "pre", has("def").alias("english"), "text_spaced")
    sides = own.join(texts, ["rec", "li"], "left").groupBy("rec", "li").agg(F.coalesce(first_text(F.col("english")), F.lit("")).alias("en"), F.coalesce(first_text(~F.col("english")), F.lit("")).alias("zh"))
    links = references(live).withColumn("li", F.col("li_sense")).where("li is not null")
    links = listed_references(links, ["rec", "li"])
    headword = F.coalesce(F.when(F.col("h") != "", F.col("h")), "key")
    full = sides.join(links, ["rec", "li"], "left").join(supplemental_heads(nodes, dict_id), "rec", "left").join(keys, "rec").join(said, "rec", "left")
    return full.select(
        "rec", F.col("li").alias("sense"), headword.alias("headword"), F.coalesce("pronunciation", F.array().cast(f"array<{PRON}>")).alias("pronunciation"), "en", "zh",
        F.when((F.col("en") != "") & (F.col("zh") != ""), F.struct("en", "zh")).alias("definition"),
        F.coalesce(F.transform("links", lambda x: _xref(x, no_labels())), F.array().cast(f"array<{XREF}>")).alias("cross_references"),
    )


def supplemental_entries(found: DataFrame, dict_id: str) -> DataFrame:
    """Entries of the second layout, one a record, in the shape of ``assemble``."""
    null = lambda t: F.lit(None).cast(t)
    node = F.struct(
        F.lit("sense").alias("kind"), null("string").alias("index"), no_labels().alias("labels"), F.col("definition"),
        F.array().cast(f"array<{EN_ZH}>").alias("examples"), F.col("cross_references"), null(EN_ZH).alias("title"), null(f"array<{SENSE}>").alias("senses"),
    ).cast(NODE)
    pairs = F.array_sort(F.collect_list(F.struct("sense", node.alias("node"))), _by("sense"))
    each = found.where("definition is not null").groupBy("rec").agg(F.first("headword").alias("headword"), F.first("pronunciation").alias("pronunciation"), F.transform(pairs, lambda x: x["node"]).alias("sense"))
    none = lambda t: F.array().cast(f"array<{t}>")
    return each.select(
        "rec", F.lit(1).cast("long").alias("local"), F.lit(dict_id).alias("dict_id"), text.pack_entry_id(F.col("rec"), F.lit(1)).alias("entry_id"), "headword",
        F.lit(dict_id).alias("page"), F.lit("proper noun").alias("section"), F.lit("word").alias("entry_type"), F.lit("proper noun").alias("pos"),
        "pronunciation", "sense", none(CHILD).alias("child_idioms"), none(CHILD).alias("child_phrasal_verbs"), none(CHILD).alias("child_derivatives"),
        none(XREF).alias("cross_references"),
    )


#: The counters of a record.
METRICS = (
    "definition_pairs", "english_only_definitions", "chinese_only_definitions", "cross_references", "raw_examples", "retained_examples",
    "retained_example_lists", "excluded_examples", "missing_english_examples", "missing_chinese_examples", "orphan_examples", "duplicate_example_imports",
)


def record_metrics(x: Layout) -> DataFrame:
    """``rec`` and its twelve counters, for every sound record.

    Only what is read counts: not senses of panels that become no entry. What is read
    in two roles counts twice, but its examples count once and as repeated imports.
    Records of the second layout have no example counters but the raw one.
    """
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    times = x.senses.join(x.times, ["rec", "sense"])
    summed = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    words = times.groupBy("rec").agg(
        summed(F.col("definition").isNotNull()).alias("definition_pairs"),
        summed((F.col("en") != "") & (F.col("zh") == "") & ~F.col("short_form")).alias("english_only_definitions"),
        summed((F.col("en") == "") & (F.col("zh") != "")).alias("chinese_only_definitions"),
        F.sum(F.size("cross_references") * F.col("times")).alias("in_senses"),
    )
    in_children = x.rows.groupBy("rec").agg(F.sum(F.size("cross_references")).alias("in_children"))
    in_panels = panel_references(x.nodes).join(x.panels.where("not is_phrase").select("rec", "panel"), ["rec", "panel"], "left_semi").groupBy("rec").agg(F.count("*").alias("in_panels"))
    imported = examples(x.nodes).join(x.times, ["rec", "sense"])
    items = example_items(x.nodes).join(imported.select("rec", F.col("item").alias("pre"), F.lit(True).alias("got")), ["rec", "pre"], "left")
    raw = items.groupBy("rec").agg(F.count("*").alias("raw_examples"), count(F.col("excluded")).alias("excluded_examples"), count(~F.col("excluded") & F.col("got").isNull()).alias("orphan_examples"))
    kept = imported.groupBy("rec").agg(
        F.count("*").alias("retained_examples"), F.count_distinct("list_pre").alias("retained_example_lists"), count(F.col("en") == "").alias("missing_english_examples"),
        count(F.col("zh") == "").alias("missing_chinese_examples"), F.sum(F.col("times") - 1).alias("duplicate_example_imports"),
    )
    kinds = record_kinds(x.nodes, x.dict_id).select("rec", F.coalesce("supplemental", F.lit(False)).alias("second"))
    both = kinds.join(x.failed, "rec", "left_anti")
    first = both.where("not second")
    for part in (words, in_children, in_panels, raw, kept):
        first = first.join(part, "rec", "left")
    links = sum((F.coalesce(c, F.lit(0)) for c in ("in_children", "in_panels")), F.coalesce("in_senses", F.lit(0)))
    first = first.withColumn("cross_references", links)
    second = x.supplements.groupBy("rec").agg(
        count(F.col("definition").isNotNull()).alias("definition_pairs"), count((F.col("en") != "") & (F.col("zh") == "")).alias("english_only_definitions"),
        count((F.col("en") == "") & (F.col("zh") != "")).alias("chinese_only_definitions"), F.sum(F.size("cross_references")).alias("cross_references"),
    )
    second = both.where("second").join(second, "rec", "left").join(raw.select("rec", "raw_examples"), "rec", "left")
    out = first.unionByName(second, allowMissingColumns=True)
    return out.select("rec", *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(m) for m in METRICS])


def orphan_examples(x: Layout) -> DataFrame:
    """``rec, pre`` of example items of sound records of the first layout that are neither excluded nor read."""
    kinds = record_kinds(x.nodes, x.dict_id).where("coalesce(not supplemental, true)").select("rec").join(x.failed, "rec", "left_anti")
    raw = example_items(x.nodes).where(~F.col("excluded")).select("rec", "pre").join(kinds, "rec", "left_semi")
    read = examples(x.nodes).join(x.times, ["rec", "sense"]).select("rec", F.col("item").alias("pre"))
    return raw.join(read, ["rec", "pre"], "left_anti")
