"""Job inputs that Spark derives from the given tables.

Records are rendered from ``part``: stock cards, one record a part, with 1 to 3 panels
that vary with the part's key, so that every rule of the extraction is met and the
columns say what must come back. ``v`` below is ``3 * p_partkey + panel``. Of each fifty
records forty are sound cards, one is of the second layout, and the others break one
rule of the extraction each (``FAULTS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossia.operators import extract, markup
from glossia.schemas import ENTRY, NODE
from glossia.sources.shared import bucketed

DICT = "dict"
#: p_partkey % 50 -> the rule that the record breaks.
FAULTS = {
    40: "no panel", 41: "unsafe media name", 42: "no detail", 43: "sense without definition block",
    44: "supplemental record without bilingual sense", 45: "supplemental record without headword",
    46: "derivative without headword", 47: "embedded entry without headword", 49: "not an entry",
}


def _tag(name: str, classes: str, *inside: str) -> str:
    """SQL for an element: its name, its classes, SQL for what stands in it."""
    return "concat(" + ", ".join([f"""'<{name} class="{classes}">'""", *inside, f"'</{name}>'"]) + ")"


def _if(test: str, then: str) -> str:
    return f"if({test}, {then}, '')"


def _sense(en: str, zh: str, *rest: str, head: str = "''") -> str:
    block = _tag("div", "o-sense-define", _tag("b", "o-sense-head", head), _tag("p", "o-def-simp", zh), _tag("p", "o-def-eng", en))
    return _tag("article", "o-sense", *rest, block)


def _item(en: str, zh: str) -> str:
    return "concat('<li>', " + _tag("q", "o-example-simp", zh) + ", " + en + ", '</li>')"


def _chunk(geo: str, phon: str, audio: str = "''") -> str:
    return _tag("span", "o-pron-chunk", audio, _tag("i", "o-pron-phon", phon), _tag("sub", "o-pron-geo", geo))


_ENGLISH = lambda *x: _tag("q", "o-example-eng", *x)
_LABELS = "concat(" + ", ".join([
    _tag("i", "o-tag", "'rack '", "v % 3", "' ;'"), _tag("i", "o-geo", "'BrE'"), _tag("i", "o-reg", "'shelf'", "v % 5"),
    _tag("i", "o-gram", "'['", "p_brand", "']'"), _tag("i", "o-sn-g", "'1..'"),
]) + ")"
_LOT = _item(_ENGLISH("'Lot '", "v", """'<a href="sound://audio/example/'""", "v", """'.mp3">HEAR</a> is <u>here</u>.'"""), "concat('批', v)")
_LEFT = _item(_ENGLISH("'It left as '", "v", "'.'"), _if("v % 7 <> 0", "concat('走', v)"))
_LISTS = _tag("ul", "o-example-list", _LOT, _LEFT, _if("v % 9 = 0", _item("''", "concat('单', v)")))
_LINKED = _tag("div", "o-ref", """concat('<a href="entry://ware%20', p_partkey + 1, '#top">Ware ', p_partkey + 1, '</a>')""", _tag("em", "o-ref-label", "if(v % 2 = 0, '→', 'cf.')"), """concat('<a href="entry://WARE%20', p_partkey + 1, '">WARE ', p_partkey + 1, '</a>')""")
_MAIN_SENSE = _sense("concat(p_name, ' in <i>lot</i>')", _if("v % 5 <> 0", "concat('货', v)"), _LISTS, _LINKED, head=_LABELS)
_AUDIO = """concat('<a href="sound://audio/word/w', v, '__gb%201.mp3">play</a>')"""
_IDIOM = _tag("div", "o-idiom", _tag("strong", "o-idm", "concat('as ˈone ', v)"), _sense("concat('all of ', v)", "concat('全', v)"))
_BOTH = _tag(
    "div", "o-phrasal o-idiom", _tag("strong", "o-pv", "concat('send ', v)"), _tag("strong", "o-idm", "concat('send ', v)"),
    _sense("concat('mail ', v)", "concat('寄', v)", _tag("ul", "o-example-list", _item(_ENGLISH("'Sent '", "v", "'.'"), "concat('发', v)"))),
)
_PHRASAL = _tag("div", "o-phrasal", _tag("div", "o-shortcut-title", "concat('send ', v)"), _sense("concat('mail ', v)", "concat('寄', v)"))
_DERIVED = _tag("div", "o-relations", _tag(
    "div", "o-relation-item", _chunk("'elsewhere'", "concat('/d', v, '/')"), _tag("div", "o-relation-pos", _tag("i", "o-pos-tag", "'adverb'")),
    _tag("div", "o-relation-head", """concat('<a href="entry://whole', v, '">')""", _tag("b", "o-dr", "concat('whole·', v)"), "'</a>'"),
))
_BOXED = _tag("div", "o-unbox-panel", _tag("ul", "o-example-list", _item(_ENGLISH("'Aside '", "v"), "'旁'")), """concat('<a href="sound://audio/word/aside', v, '.mp3">play</a>')""")
_PANEL = "concat('<section class=\"o-for-pos-', j, ' o-pos-panel\">', " + _tag(
    "div", "o-pos-detail",
    _MAIN_SENSE, _tag("b", "o-pos-tag", "p_type"),
    _if("v % 17 = 0", _sense("''", "concat('空', v)")),
    _if("v % 4 = 1", _IDIOM), _if("v % 8 = 1", _IDIOM), _if("v % 4 = 2", f"if(v % 12 = 10, {_BOTH}, {_PHRASAL})"), _if("v % 4 = 3", _DERIVED),
    _if("v % 3 = 0", _tag("div", "o-shortcut o-multiple-sense", _tag("div", "o-shortcut-title", _tag("b", "o-simp", "concat('类', v)"), _tag("b", "o-eng", "concat('kind of ', v)")), _sense("concat('sort ', v)", "concat('分', v)", head=_tag("i", "o-sn-g", "'2'")))),
    _if("v % 13 = 0", _tag("ul", "o-example-list", _item(_ENGLISH("'Stray '", "v"), "'孤'"))),
    _if("v % 6 = 5", _tag("p", "o-reference", _tag("i", "o-ref", """concat('<a href="entry://shelf%20', v, '">shelf</a>')"""))),
    _if("v % 5 = 1", _chunk("'BrE'", "concat('/r', v, '/')")),
) + ", " + _if("v % 2 = 0", _BOXED) + ", '</section>')"
_SET = """concat('<div data-pronunciation-for="', j, '" class="o-pronunciation-set">', """ + ", ".join([_chunk("'BrE'", "concat('/w', v, '/')", _AUDIO), _chunk("'NAmE'", "concat('/w', v, '-us/')"), _if("v % 4 = 0", _chunk("'BrE'", "concat('/w', v, '/')", _AUDIO))]) + ", '</div>')"
_COLLECTION = _tag("section", "o-pos-panel o-idiom-collection", _tag("div", "o-pos-detail", _tag("div", "o-idiom", _tag("b", "o-idm", "'kept apart'"), _sense("'on its own'", "'独'", _tag("ul", "o-example-list", _item(_ENGLISH("'Gathered.'"), "'集'"))))))
_SAYING = _tag("section", "o-phrase-panel o-pos-panel", _tag("div", "o-pos-detail", *[_tag("div", "o-idiom", _tag("b", "o-idm", f"concat('{word} ', p_partkey)"), _sense(f"'{en}'", f"'{zh}'")) for word, en, zh in (("saying", "what is said", "俗"), ("second", "never read", "次"))]))
_EACH = lambda x: f"array_join(transform(sequence(0, p_size % 3), j -> {x.replace(' v', ' (3 * p_partkey + j)').replace('(v', '((3 * p_partkey + j)')}), '')"


def _card(*inside: str, more: str = "''", head: str = "concat('Wa·re', if(p_partkey % 11 = 0, \"'s\", ''), ' ', p_partkey)") -> str:
    title = _tag("header", "o-head-main", _tag("em", "o-h", head))
    return f"concat('<main class=\"{DICT}-entry', {more}, '\">', " + ", ".join([*inside, title]) + ", '</main>')"


_RECORD = _card(
    _EACH(_PANEL), _if("p_partkey % 3 = 0", _COLLECTION), _if("p_partkey % 10 = 9", _SAYING), _EACH(_SET),
    more=f"if(p_partkey % 10 = 9, ' {DICT}-phrase-entry', '')",
)


def _second(head: str, *senses: str) -> str:
    """A record of the second layout."""
    said = [_tag("div", c, _tag("i", "phon", p)) for c, p in (("phons_n_am", "'/us/'"), ("phons_br", "concat('/s', p_partkey, '/')"))]
    return f"concat('<main class=\"{DICT}-supplemental-entry {DICT}-entry\">', " + ", ".join([*said, head, _tag("ol", "sense_single", *senses)]) + ", '</main>')"


def _second_sense(en: str, zh: str, link: str) -> str:
    return _tag("li", "sense", _tag("div", "sensetop", f"concat('<deft><chn>', {zh}, '</chn></deft>')", _tag("p", "def", en)), f"""concat('<a href="entry://{link}%20', p_partkey, '">{link}</a>')""")


_NAMED = _tag("h1", "o-headword", "concat('Place ', p_partkey)")
_SUPPLEMENT = _second(_NAMED, _second_sense("p_name", "concat('名', p_partkey)", "near"), _second_sense("'only one side'", "''", "far"), _tag("ul", "o-example-list", _item(_ENGLISH("'Unread.'"), "'未'")))
_OF = lambda *inside: _tag("section", "o-pos-panel", _tag("div", "o-pos-detail", _tag("b", "o-pos-tag", "p_type"), *inside))
_BROKEN = {
    40: _card(_COLLECTION),
    41: _card(_OF(_sense("'x'", "'y'")), """'<a href="sound://audio/word/..%2Fup.mp3">play</a>'"""),
    42: _card(_tag("section", "o-pos-panel o-phrase-panel", _tag("div", "o-idiom", _tag("b", "o-idm", "'loose'")))),
    43: _card(_OF(_tag("article", "o-sense", "'no block'"))),
    44: _second(_NAMED, _second_sense("p_name", "''", "near")),
    45: _second("''", _second_sense("p_name", "'名'", "near")),
    46: _card(_OF(_tag("div", "o-relations", _tag("div", "o-relation-item", _tag("div", "o-relation-head", "'bare'"))))),
    47: _card(_OF(_tag("div", "o-idiom", _sense("'x'", "'y'")))),
    48: _SUPPLEMENT,
    49: "concat('<p>stray leaf ', p_partkey, '</p>')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, n: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Markup records of the parts (or those with a ``rec`` of ``only``): ordinary ones, some of the second layout, some broken. They are dealt by their number."""
    content = "case p_partkey % 50 " + " ".join(f"when {k} then {x}" for k, x in _BROKEN.items()) + f" else {_RECORD} end"
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", (F.col("p_partkey") + 1).cast("long").alias("record_number"))
    if only is not None:
        parts = parts.join(only.select(F.col("rec").alias("record_number")), "record_number", "left_semi")
    parts = parts.repartition(n or spark.sparkContext.defaultParallelism, "record_number")  # a small table has one split; parsing is the work
    return parts.select(
        "record_number", F.concat(F.lit("Ware "), F.col("p_partkey")).alias("key"), F.expr(content).alias("content")
    )


def redirect_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_number, key, content``: chains of redirects with entries, cycles and dead ends among them."""
    k = F.col("p_partkey")
    target = F.expr(
        "case when p_partkey % 97 = 1 then p_partkey + 1 when p_partkey % 97 = 2 then p_partkey - 1"
        " when p_partkey % 89 = 3 then -1 when p_partkey % 5 <> 0 then p_partkey - 1 end"
    )
    content = F.when(target.isNotNull(), F.concat(F.lit("\x00 @@@LINK=KEY "), target, F.lit(" \n\x00"))).otherwise(F.lit("<p>entry</p>"))
    return table(spark, sf_dir, "part").select((k + 1).alias("record_number"), F.concat(F.lit("Key  "), k).alias("key"), content.alias("content"))


def build_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects to the markup records: straight, over another one, to themselves, and to nothing."""
    k = F.col("p_partkey")
    target = F.expr(
        "case when p_partkey % 97 = 1 then concat('ALSO ', p_partkey) when p_partkey % 89 = 3 then 'nowhere'"
        " when p_partkey % 4 = 0 then concat('WARE  ', p_partkey) when p_partkey % 4 = 3 then concat('also ', p_partkey + 1) end"
    )
    rows = table(spark, sf_dir, "part").where(target.isNotNull())
    return rows.select((k + 10_000_000).alias("record_number"), F.concat(F.lit("Also "), k).alias("key"), F.concat(F.lit("@@@LINK="), target, F.lit("\n\x00")).alias("content"))


#: Records of a bucket of the node table.
BUCKET_RECORDS = 10_000


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the tables by record: as many as cores, more for many records."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "part").count() // BUCKET_RECORDS))


def parsed(spark: SparkSession, sf_dir: str, n: int, profile: markup.Selectors = extract.ENTRY_NODES, only: DataFrame | None = None) -> DataFrame:
    """Placed nodes of the records (or those with a ``rec`` of ``only``), not stored; those of a record are in one of n partitions."""
    return extract.placed(markup.markup_nodes(records(spark, sf_dir, n, only), profile))


def nodes(spark: SparkSession, sf_dir: str, n: int | None = None, profile: markup.Selectors = extract.ENTRY_NODES, only: DataFrame | None = None) -> DataFrame:
    """The node table, parsed once and written in buckets by record: no reader moves its rows."""
    n = n or buckets(spark, sf_dir)
    return bucketed(parsed(spark, sf_dir, n, profile, only), "nodes", "rec", n, dealt=True)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``archive, position, block_no, key, name, offset, content``; a third start with ID3."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".mp3"))
    head = F.when(F.col("doc_id") % 3 == 0, "ID3").otherwise("")
    return d.select(
        F.col("source").alias("archive"), F.col("doc_id").alias("position"), (F.col("doc_id") / 64).cast("int").alias("block_no"),
        F.concat(F.lit("\\Audio\\Word\\"), name).alias("key"), name.alias("name"),
        F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"),
    )


def word_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the rendered records refer to, but for one part in fifty-three: ``key, name, content``."""
    panels = table(spark, sf_dir, "part").where("p_partkey % 53 <> 52").select("p_name", F.explode(F.expr("transform(sequence(0, p_size % 3), j -> 3 * p_partkey + j)")).alias("v"))
    names = F.array(F.concat(F.lit("w"), "v", F.lit("__gb 1.mp3")), F.concat(F.lit("aside"), "v", F.lit(".mp3")))
    each = panels.select(F.explode(names).alias("name"), F.concat(F.lit("ID3"), "p_name").cast("binary").alias("content"))
    return each.select(F.concat(F.lit("\\AUDIO\\word\\"), "name").alias("key"), "name", "content")


def media_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the labels refer to, and for poor ones a name that no archive has."""
    labels = table(spark, sf_dir, "labels")
    there = labels.select(F.concat(F.lit("DOC_"), F.col("doc_id"), F.lit(".mp3")).alias("name"))
    absent = labels.where("quality = 0").select(F.concat(F.lit("gone_"), F.col("doc_id"), F.lit(".mp3")).alias("name"))
    return there.unionByName(absent)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat entries with the columns that index and look-ups need, from ``part``."""
    child = lambda word: f"named_struct('headword', {word})"
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("entry_id"), F.col("p_name").alias("headword"), F.lit("word").alias("entry_type"),
        F.expr("array(named_struct('region', if(p_size % 7 = 0, 'other', 'UK'), 'notation', p_brand, 'audio_url', cast(null as string)), named_struct('region', if(p_size % 2 = 0, 'US', 'other'), 'notation', p_type, 'audio_url', cast(null as string)))").alias("pronunciation"),
        F.expr(f"array({child('p_type')}, {child('p_brand')})").alias("child_idioms"),
        F.expr(f"if(p_size % 4 = 0, array({child('p_name')}), array())").alias("child_phrasal_verbs"),
        F.expr(f"array({child(chr(39) * 2)}, {child('p_type')})").alias("child_derivatives"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("entry_id"), F.col("p_brand").alias("alias"))


#: p_partkey % 40, and the path and rule that such an entry breaks.
CONTRACT_FAULTS = (
    (1, "entry_id", "entry_id"), (2, "headword", "blank"), (3, "pos", "blank"), (4, "entry_type", "entry_type"), (5, "page", "blank"),
    (6, "pronunciation[].region", "region"), (7, "pronunciation[].notation", "blank"), (8, "sense[].kind", "kind"), (9, "sense[].definition", "one_sided"),
    (10, "sense[].examples[]", "one_sided"), (11, "sense[].labels.grammar[]", "blank"), (12, "sense[].cross_references[].kind", "kind"),
    (13, "sense[].cross_references[].target", "blank"), (14, "sense[].cross_references[].labels.note[]", "blank"), (15, "sense[]", "group_title"),
    (16, "sense[].title", "one_sided"), (17, "sense[].senses[].kind", "kind"), (18, "sense[].senses[].definition", "one_sided"),
    (19, "sense[].senses[].examples[]", "one_sided"), (20, "sense[].senses[].cross_references[].display", "blank"), (21, "child_idioms[].headword", "blank"),
    (22, "child_idioms[].pronunciation[].region", "region"), (23, "child_phrasal_verbs[].sense[].definition", "one_sided"),
    (24, "child_phrasal_verbs[].cross_references[].kind", "kind"), (25, "child_derivatives[].headword", "blank"), (26, "cross_references[].display", "blank"),
    (27, "sense[]", "extra"), (28, "child_idioms", "absent"), (29, "sense[].examples[]", "absent"), (30, "child_idioms[].sense[].senses[].labels.region[]", "blank"),
)


def contract_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries of the parts, with the faults of ``CONTRACT_FAULTS``."""
    bad = lambda k, fault, sound: f"if(p_partkey % 40 = {k}, {fault}, {sound})"
    struct = lambda **fields: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    none = "cast(null as string)"
    words = lambda k=-1, last="'n'": f"array('l', {bad(k, chr(39) + ' ' + chr(39), last)})"
    labels = lambda grammar=-1, region=-1, note=-1: struct(grammar=words(grammar), register=words(), region=words(region), usage=words(), construction=words(), note=words(note))  # noqa: E731, E501
    pair = lambda k=-1: struct(en="p_name", zh=bad(k, "''", "'货'"))
    sound = lambda region=-1, notation=-1: f"array({struct(region=bad(region, none, chr(39) + 'UK' + chr(39)), notation=bad(notation, none, 'p_brand'), audio_url=none)})"  # noqa: E731, E501
    link = lambda kind=-1, target=-1, display=-1, note=-1: f"array({struct(kind=bad(kind, chr(39) + 'reference' + chr(39), chr(39) + extract.REFERENCE_KIND + chr(39)), target=bad(target, none, 'p_type'), display=bad(display, none, 'p_type'), relation=none, labels=labels(note=note))})"  # noqa: E731, E501

    def sense(kind: int = -1, definition: int = -1, example: int = -1, lacks: int = -1, region: int = -1, grammar: int = -1, kind_of_link: int = -1, **links: int) -> dict[str, str]:
        examples = f"array({pair()}, {bad(lacks, 'null', pair(example))})"
        return {"kind": bad(kind, none, "'sense'"), "index": none, "labels": labels(grammar=grammar, region=region), "definition": pair(definition), "examples": examples, "cross_references": link(kind_of_link, **links)}

    def leaf(extra: int = -1, **faults: int) -> str:
        return struct(**sense(**faults), title=bad(extra, pair(), "null"), senses="null")

    def group(title: int = -1, half: int = -1, **faults: int) -> str:
        null = dict.fromkeys(("index", "labels", "definition", "examples", "cross_references"), "null")
        return struct(kind="'group'", **null, title=bad(title, "null", pair(half)), senses=f"array({struct(**sense(**faults))})")

    def child(headword: int = -1, region: int = -1, kind: int = -1, inner: int = -1, definition: int = -1) -> str:
        nodes = f"array(cast({leaf(definition=definition)} as {NODE}), cast({group(region=inner)} as {NODE}))"
        return f"array({struct(headword=bad(headword, none, 'p_brand'), pos=none, pronunciation=sound(region), sense=nodes, cross_references=link(kind))})"

    nodes = f"array(cast({leaf(27, kind=8, definition=9, example=10, lacks=29, grammar=11)} as {NODE}), cast({leaf(target=13, note=14, kind_of_link=12)} as {NODE}), cast({group(15, 16)} as {NODE}), cast({group(kind=17, definition=18, example=19, display=20)} as {NODE}))"
    columns = {
        "dict_id": f"'{DICT}'", "entry_id": bad(1, "-1 - p_partkey", "1 + p_partkey"), "headword": bad(2, "' '", "p_name"), "page": bad(5, "''", f"'{DICT}'"), "section": "'s'",
        "entry_type": bad(4, none, "'word'"), "pos": bad(3, none, "p_type"), "pronunciation": sound(6, 7), "sense": nodes,
        "child_idioms": bad(28, "null", child(21, 22, inner=30)), "child_phrasal_verbs": child(kind=24, definition=23), "child_derivatives": child(25), "cross_references": link(display=26),
    }
    return table(spark, sf_dir, "part").select(*[F.expr(f"cast({x} as {StructType.fromDDL(ENTRY)[c].dataType.simpleString()})").alias(c) for c, x in columns.items()])
