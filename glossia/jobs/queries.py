"""One registered query per operator, each with DuckDB SQL where SQL can say it.

Records, redirects, entries and media are derived from the given tables by
``derived``; the SQL reads the same columns and does no parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossia.functions import text, windows
from glossia.jobs import derived, publish
from glossia.jobs.derived import DICT, table
from glossia.operators import audit, contract, extract, index, markup, media, records, redirects
from glossia.sources import files
from glossia.sources.shared import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put


# Scalars ---------------------------------------------------------------------------


def _scalar(name: str, source: str, key: str, make: Callable[[], F.Column], sql: str, out: str = "value") -> None:
    """A scalar function over every row of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, make().alias(out))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, {sql} AS {out} FROM {source}"


_col = F.col
_scalar("clean_text", "documents", "doc_id", lambda: F.md5(text.clean_text(_col("text"))), f"md5(trim(regexp_replace(text, '{_WS}', ' ', 'g')))")
_scalar("casefold", "documents", "doc_id", lambda: F.md5(text.casefold(_col("text"))), "md5(replace(lower(text), 'ß', 'ss'))")
_scalar("normalize_headword", "documents", "doc_id", lambda: F.md5(text.normalize_headword(_col("text"))), f"md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{_WS}', ' ', 'g')))")
_scalar("clean_headword", "part", "p_partkey", lambda: text.clean_headword(F.concat(F.lit(" Par·t\t ˈ "), "p_name", F.lit("　x "))), "'Part ' || p_name || ' x'")
_scalar("extract_media_name", "part", "p_partkey", lambda: text.media_name(F.when(_col("p_size") % 2 == 0, F.concat(F.lit("SOUND://audio/word/p%20"), "p_partkey", F.lit("+"), "p_size", F.lit(".mp3"))).otherwise("entry://x")), "CASE WHEN p_size % 2 = 0 THEN 'p ' || p_partkey || '+' || p_size || '.mp3' END")
_scalar("media_url", "part", "p_partkey", lambda: text.media_url(DICT, F.concat("p_name", F.lit(" é~*/"), "p_partkey", F.lit(".mp3"))), "'/audio/dict/' || replace(p_name, ' ', '%20') || '%20%C3%A9~%2A%2F' || p_partkey || '.mp3'")
_scalar("link_target", "part", "p_partkey", lambda: text.link_target(F.concat(F.lit("entry://"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("/a+"), "p_partkey", F.lit("?x=1#f"))), "p_name || '/a+' || p_partkey")
_scalar("region_code", "part", "p_partkey", lambda: text.region_code(F.when(_col("p_size") % 3 == 0, "BrE").when(_col("p_size") % 3 == 1, "NAmE").otherwise(_col("p_type"))), "CASE p_size % 3 WHEN 0 THEN 'UK' WHEN 1 THEN 'US' ELSE 'other' END")
_scalar("sense_index", "part", "p_partkey", lambda: text.sense_index(F.concat(F.lit(" "), "p_size", F.lit("... "))), "CAST(p_size AS VARCHAR)")
_scalar("is_safe_media_name", "part", "p_partkey", lambda: text.is_safe_media_name(F.concat(F.when(_col("p_size") % 4 == 0, "..\\").when(_col("p_size") % 4 == 1, "a/").otherwise(""), "p_name", F.when(_col("p_size") % 3 == 0, ".ogg").otherwise(".MP3"))), "p_size % 4 > 1 AND p_size % 3 <> 0")
_scalar("parse_entry_id", "part", "p_partkey", lambda: text.parse_entry_id(F.concat(F.when(_col("p_size") % 5 == 0, "x").when(_col("p_size") % 5 == 1, "99999999999").otherwise(""), "p_partkey", F.when(_col("p_size") % 5 == 2, "\n").otherwise(""))), "CASE WHEN p_size % 5 IN (3, 4) AND p_partkey > 0 THEN p_partkey END")
_scalar("anchor", "part", "p_partkey", lambda: text.anchor("child_idioms", _col("p_size")), "'child_idioms.' || p_size")


@query("SELECT p_partkey, p_brand || ' ' || p_type AS phonetic FROM part")
def phonetic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.entries(spark, sf_dir)
    return e.select((F.col("entry_id") - 1).alias("p_partkey"), text.phonetic_key(F.col("pronunciation")).alias("phonetic"))


@query("SELECT p_partkey, unnest([0, 1, 2]) AS at, unnest([p_name, p_type, p_brand]) AS label FROM part")
def clean_label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array("p_name", F.concat(F.lit(" ,"), F.upper("p_name"), F.lit("; ")), F.concat(F.lit("("), "p_type", F.lit(")")), F.lit(" ()"), F.concat(F.lit("["), "p_brand", F.lit("]")))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.clean_label_list(raw)).alias("at", "label"))


@query("""SELECT p_partkey, '{"entry_id":' || p_partkey || ',"headword":"' || p_name || ' é","labels":["' || p_brand || '"]}' AS json FROM part""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("p_partkey").alias("entry_id"), F.concat("p_name", F.lit(" é")).alias("headword"), F.lit(None).cast("string").alias("page"), F.array("p_brand").alias("labels"))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(row).alias("json"))


@query("SELECT p_partkey AS entry_id, p_name AS headword, p_brand AS label FROM part")
def decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = canonical_json(spark, sf_dir).select(F.from_json("json", "entry_id long, headword string, labels array<string>").alias("e"))
    return back.select("e.entry_id", F.regexp_replace("e.headword", " é$", "").alias("headword"), F.col("e.labels")[0].alias("label"))


#: SQL for the CRC-32 of a list of bytes; ``k`` is a one-row table ``t`` with the 256 remainders.
_CRC_TABLE = "t AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, k[xor(c, x) % 256 + 1])))"
_FILES = "d AS (SELECT 'doc_' || doc_id || '.mp3' AS name, hex(encode(CASE WHEN doc_id % 3 = 0 THEN 'ID3' ELSE '' END || coalesce(text, ''))) AS h FROM documents)"
_BYTES = "list_transform(regexp_extract_all({h}, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes"


@query(f"WITH {_CRC_TABLE}, {_FILES}, b AS (SELECT name, {_BYTES.format(h='h')} FROM d) SELECT name, lower(printf('%08x', {_CRC})) AS crc FROM b, t")
def crc32_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.media(spark, sf_dir).select("name", text.crc32_hex(F.col("content")).alias("crc"))


@query("SELECT 'doc_' || doc_id || '.mp3' AS name, doc_id % 3 = 0 OR starts_with(coalesce(text, ''), 'ID3') AS valid FROM documents")
def is_valid_mp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.media(spark, sf_dir).select("name", text.is_valid_mp3(F.col("content")).alias("valid"))


# Records ---------------------------------------------------------------------------


@query("SELECT page_id + 1 AS record_number, url AS key, md5(html) AS content FROM pages")
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_records(spark, sf_dir).withColumn("content", F.md5("content"))


@query("SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS record_number FROM pages")
def number_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], "record_number").select("page_id", "record_number")


@query("SELECT count(*) AS records FROM pages")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_records(spark, sf_dir).agg(F.count("*").alias("records"))


_REDIRECTS = """
    r AS (
        SELECT p_partkey + 1 AS record_number, 'key ' || p_partkey AS k, CASE WHEN p_partkey % 97 = 1 THEN p_partkey + 1
            WHEN p_partkey % 97 = 2 THEN p_partkey - 1 WHEN p_partkey % 89 = 3 THEN -1 WHEN p_partkey % 5 <> 0 THEN p_partkey - 1 END AS t
        FROM part
    ), e AS (SELECT k AS src, 'key ' || t AS dst FROM r WHERE t IS NOT NULL), d AS (SELECT k AS key, (record_number << 10) | 1 AS entry_id FROM r WHERE t IS NULL)
"""
_CLOSURE = f"WITH RECURSIVE {_REDIRECTS}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"


@query(f"WITH {_REDIRECTS} SELECT record_number, 'Key  ' || (record_number - 1) AS source, 'KEY ' || t AS target, t IS NOT NULL AS redirect FROM r")
def split_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, rest = records.split_redirects(derived.redirect_records(spark, sf_dir))
    plain = rest.select("record_number", F.col("key").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("redirect"))
    return led.withColumn("redirect", F.lit(True)).unionByName(plain)


@query("SELECT l_orderkey, l_linenumber, ((l_orderkey + 1) << 10) | l_linenumber AS entry_id FROM lineitem")
def pack_entry_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.pack_entry_id(F.col("l_orderkey") + 1, F.col("l_linenumber")).alias("entry_id"))


@query("SELECT l_orderkey + 1 AS rec, CAST(l_linenumber AS BIGINT) AS local FROM lineitem")
def unpack_entry_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, local = text.unpack_entry_id(F.col("entry_id"))
    return pack_entry_id(spark, sf_dir).select(rec.alias("rec"), local.alias("local"))


@query("SELECT p_partkey + 1 AS rec, CASE p_partkey % 50 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in derived.FAULTS.items()) + " END AS reason FROM part WHERE p_partkey % 50 >= 40 AND p_partkey % 50 <> 48")
def quarantine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir).failed


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT * FROM (SELECT ((l_orderkey + 1) << 10) | l_linenumber AS entry_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) > 1 AS collides FROM lineitem) WHERE collides")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("entry_id", text.pack_entry_id(F.col("l_orderkey") + 1, F.col("l_linenumber")))
    return records.id_collisions(lines, "entry_id", _LINE.split(", "))[1].select("entry_id", "l_partkey", F.lit(True).alias("collides"))


@query("SELECT p_partkey + 1 AS record_number, 'Key  ' || p_partkey AS key FROM part WHERE p_partkey IN (SELECT doc_id FROM labels)")
def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "labels").select(F.concat(F.lit(" KEY  "), "doc_id").alias("key"))
    return records.sample_records(derived.redirect_records(spark, sf_dir), keys).select("record_number", "key")


# Markup ----------------------------------------------------------------------------

_PANELS = """
    o AS (SELECT p.*, p_partkey + 1 AS rec, 'Ware' || CASE WHEN p_partkey % 11 = 0 THEN chr(39) || 's' ELSE '' END || ' ' || p_partkey AS h FROM part p WHERE p_partkey % 50 < 40),
    w AS (SELECT *, unnest(range(0, 1 + p_size % 3)) AS j FROM o), v AS (SELECT *, 3 * p_partkey + j AS v, j + 1 AS local FROM w),
    ph AS (SELECT *, 2 + p_size % 3 AS local FROM o WHERE p_partkey % 10 = 9)
"""
_WITH = f"WITH {_PANELS} "


def layout(spark: SparkSession, sf_dir: str) -> extract.Layout:
    """The rendered records; what several operators need of them is worked out when it is asked for."""
    n = derived.buckets(spark, sf_dir)
    return extract.Layout(derived.nodes(spark, sf_dir, n), derived.records(spark, sf_dir), DICT, n)


def narrow(spark: SparkSession, sf_dir: str, profile: markup.Selectors, kept: bool) -> extract.Layout:
    """A layout over those elements alone that a profile names; unless they are ``kept``, they are for a single pass."""
    n = derived.buckets(spark, sf_dir)
    nodes = derived.nodes(spark, sf_dir, n, profile) if kept else derived.parsed(spark, sf_dir, n, profile)
    return extract.Layout(nodes, derived.records(spark, sf_dir), DICT, n)


def parsed(sql: str | None, profile: markup.Selectors | None = None, kept: bool = False) -> Callable:
    """Register a query over the parsed records; with a profile it gets what that names, in a table if ``kept``."""

    def put(f: Callable[[extract.Layout], DataFrame]) -> Callable:
        query(sql, f.__name__)(lambda spark, sf_dir: f(narrow(spark, sf_dir, profile, kept) if profile else layout(spark, sf_dir)))
        return f

    return put


def _dealt(p: extract.Layout) -> DataFrame:
    """Nodes that weren't kept, moved once for all that follows."""
    return p.nodes.repartition(p.buckets, "rec")


def _local(p: extract.Layout) -> DataFrame:
    """Panels of sound records with their local numbers."""
    return p.local.join(p.failed, "rec", "left_anti")


@query("SELECT rec, tag, count(*) AS n FROM (SELECT page_id + 1 AS rec, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script>.*?</script>', '', 'gs'), '<(a|h1|p)[ >]', 1)) AS tag FROM pages) GROUP BY ALL")
def markup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = markup.markup_nodes(files.page_records(spark, sf_dir), markup.PAGE_PROFILE)
    return n.where(F.col("tag").isin("a", "h1", "p")).groupBy("rec", "tag").agg(F.count("*").alias("n"))


@query(_WITH + "SELECT rec, CAST(sum(1 + CAST(v % 4 = 0 AS INT) + CAST(v % 2 = 0 AS INT)) AS BIGINT) AS raw, CAST(sum(1 + CAST(v % 4 = 0 AS INT)) AS BIGINT) AS kept FROM v GROUP BY rec UNION ALL SELECT p_partkey + 1, 1, 1 FROM part WHERE p_partkey % 50 = 41")
def prune_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = markup.markup_nodes(derived.records(spark, sf_dir))
    links = lambda d, name: d.where(markup.href(text.WORD_AUDIO).isNotNull()).groupBy("rec").agg(F.count("*").alias(name))
    return links(n, "raw").join(links(markup.prune_sections(n), "kept"), "rec")


@parsed(_WITH + "SELECT rec, local, p_type AS pos, FALSE AS is_phrase FROM v UNION ALL SELECT rec, local, 'idiom', TRUE FROM ph")
def classify_panels(p: extract.Layout) -> DataFrame:
    return p.panels.join(_local(p), ["rec", "panel"]).select("rec", "local", "pos", "is_phrase")


@parsed(_WITH + "SELECT rec, local, (rec << 10) | local AS entry_id FROM v UNION ALL SELECT rec, local, (rec << 10) | local FROM ph")
def number_entries(p: extract.Layout) -> DataFrame:
    return _local(p).select("rec", "local", text.pack_entry_id(F.col("rec"), F.col("local")).alias("entry_id"))


@parsed(_WITH + "SELECT rec, h AS headword FROM o")
def extract_headword(p: extract.Layout) -> DataFrame:
    return p.heads.join(_local(p).select("rec").distinct(), "rec", "left_semi")


@parsed(_WITH + "SELECT rec, local, CASE WHEN p_partkey % 10 = 9 THEN 'phrase' ELSE 'word' END AS entry_type FROM v UNION ALL SELECT rec, local, 'phrase' FROM ph")
def extract_entry_type(p: extract.Layout) -> DataFrame:
    kinds = extract.record_kinds(p.nodes, DICT)
    kind = F.when(F.col("is_phrase") | F.col("is_phrase_record"), "phrase").otherwise("word")
    return p.panels.join(_local(p), ["rec", "panel"]).join(kinds, "rec").select("rec", "local", kind.alias("entry_type"))


_SETS = """
    s AS (
        SELECT rec, local, v, 0 AS src, 'UK' AS region, '/w' || v || '/' AS notation, '/audio/dict/w' || v || '__gb%201.mp3' AS audio_url FROM v
        UNION ALL SELECT rec, local, v, 1, 'US', '/w' || v || '-us/', NULL FROM v
    ), rt AS (SELECT rec, local, v, 2 AS src, 'UK' AS region, '/r' || v || '/' AS notation, CAST(NULL AS VARCHAR) AS audio_url FROM v WHERE v % 5 = 1)
"""


@parsed(f"WITH {_PANELS}, {_SETS} SELECT rec, region, notation, audio_url FROM s UNION ALL SELECT rec, region, notation, audio_url FROM rt UNION ALL SELECT rec, 'other', '/d' || v || '/', NULL FROM v WHERE v % 4 = 3", extract.CHUNKS)
def extract_pronunciations(p: extract.Layout) -> DataFrame:
    c = extract.chunks(_dealt(p)).withColumn("owner", F.coalesce("pron_set", "child_above", "panel"))
    c = windows.dedupe_first(c, ["rec", "owner", "region", "notation", "file"], ["chunk"])
    return c.select("rec", "region", "notation", text.media_url(DICT, F.col("file")).alias("audio_url"))


@parsed(f"WITH {_PANELS}, {_SETS} SELECT rec, CAST(local - 1 AS VARCHAR) AS number, region, notation FROM s", extract.SOUND_SETS, kept=True)
def panel_pronunciation_sets(p: extract.Layout) -> DataFrame:
    s = extract.set_sounds(p.nodes)
    return windows.dedupe_first(s, ["rec", "number", "region", "notation", "file"], ["ord"]).select("rec", "number", "region", "notation")


@parsed(f"WITH {_PANELS}, {_SETS} SELECT rec, local, region, notation FROM rt")
def root_panel_pronunciations(p: extract.Layout) -> DataFrame:
    return extract.root_sounds(p.nodes).join(_local(p), ["rec", "panel"]).select("rec", "local", "region", "notation")


@parsed(f"WITH {_PANELS}, {_SETS}, b AS (SELECT * FROM s UNION ALL SELECT * FROM rt) SELECT rec, local, CAST(row_number() OVER (PARTITION BY rec, local ORDER BY src) - 1 AS INT) AS at, region, notation, audio_url FROM b")
def merge_pronunciations(p: extract.Layout) -> DataFrame:
    m = extract.panel_pronunciations(p.nodes, p.panels, DICT).join(_local(p), ["rec", "panel"])
    return m.select("rec", "local", F.posexplode("pronunciation").alias("at", "x")).select("rec", "local", "at", "x.*")


_AUDIO = "a AS (SELECT rec, 'w' || v || '__gb 1.mp3' AS name FROM v UNION ALL SELECT rec, 'aside' || v || '.mp3' FROM v WHERE v % 2 = 0)"


@parsed(f"WITH {_PANELS}, {_AUDIO} SELECT rec, name FROM a UNION ALL SELECT p_partkey + 1, '../up.mp3' FROM part WHERE p_partkey % 50 = 41", extract.AUDIO_LINKS)
def extract_audio_refs(p: extract.Layout) -> DataFrame:
    return extract.audio_references(p.nodes)


#: Items of lists that senses have: of the main sense, and of the one that is read as a phrasal verb and as an idiom.
_EXAMPLES = """
    x AS (
        SELECT rec, v, 0 AS nth, 'Lot ' || v || ' is here.' AS en, '批' || v AS zh FROM v
        UNION ALL SELECT rec, v, 1, 'It left as ' || v || '.', CASE WHEN v % 7 = 0 THEN '' ELSE '走' || v END FROM v
        UNION ALL SELECT rec, v, 2, '', '单' || v FROM v WHERE v % 9 = 0
        UNION ALL SELECT rec, v, 3, 'Sent ' || v || '.', '发' || v FROM v WHERE v % 12 = 10
    )
"""


@parsed(f"WITH {_PANELS}, {_EXAMPLES} SELECT rec, en, zh FROM x WHERE zh <> '' AND en <> ''", extract.READ_EXAMPLES, kept=True)
def extract_examples(p: extract.Layout) -> DataFrame:
    read = extract.examples(p.nodes).join(p.times, ["rec", "sense"], "left_semi")
    return read.where("en <> '' and zh <> ''").select("rec", "en", "zh")


@parsed(f"WITH {_PANELS}, {_EXAMPLES} SELECT rec, en FROM x UNION ALL SELECT rec, 'Gathered.' FROM o WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 1, 'Gathered.' FROM part WHERE p_partkey % 50 = 40", extract.EXAMPLES)
def example_text(p: extract.Layout) -> DataFrame:
    return extract.examples(_dealt(p)).select("rec", "en")


@parsed(f"""WITH {_PANELS}, {_EXAMPLES}, e AS (SELECT rec, count(*) AS n FROM x GROUP BY rec)
    SELECT rec, CAST(sum(CAST(v % 2 = 0 AS INT)) AS BIGINT) + CAST(any_value(p_partkey) % 3 = 0 AS INT) AS excluded, any_value(e.n) + CAST(sum(CAST(v % 13 = 0 AS INT)) AS BIGINT) AS included FROM v JOIN e USING (rec) GROUP BY rec
    UNION ALL SELECT p_partkey + 1, CAST(p_partkey % 50 = 40 AS BIGINT), CAST(p_partkey % 50 = 48 AS BIGINT) FROM part WHERE p_partkey % 50 IN (40, 48)""", extract.EXAMPLE_ITEMS)
def classify_excluded_examples(p: extract.Layout) -> DataFrame:
    n = F.sum(F.when(F.col("excluded"), 1).otherwise(0))
    return extract.example_items(p.nodes).groupBy("rec").agg(n.alias("excluded"), (F.count("*") - n).alias("included"))


@parsed(_WITH + "SELECT rec, local, unnest(['grammar', 'register', 'region', 'note']) AS bucket, unnest([p_brand, 'shelf' || (v % 5), 'BrE', 'rack ' || (v % 3)]) AS label FROM v")
def extract_labels(p: extract.Layout) -> DataFrame:
    found = extract.labels(p.nodes).join(p.senses.select("rec", "sense", "panel", "direct"), ["rec", "sense"]).where("direct").join(_local(p), ["rec", "panel"])
    each = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"labels.{b}").alias("all")) for b in extract.BUCKETS])
    return found.select("rec", "local", F.explode(each).alias("b")).select("rec", "local", "b.bucket", F.explode("b.all").alias("label"))


@query("SELECT href AS target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href")
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = markup.page_links(table(spark, sf_dir, "pages"))
    return links.groupBy(F.col("href").alias("target")).agg(F.count("*").alias("links"), F.count_distinct("rec").alias("pages"))


_LINKS = """
    l AS (
        SELECT rec, 'ware ' || (p_partkey + 1) AS target, 'Ware ' || (p_partkey + 1) AS display, CASE WHEN v % 2 = 1 THEN 'cf.' END AS relation FROM v
        UNION ALL SELECT rec, 'whole' || v, 'whole' || v, NULL FROM v WHERE v % 4 = 3
        UNION ALL SELECT rec, 'shelf ' || v, 'shelf', NULL FROM v WHERE v % 6 = 5
    )
"""


@parsed(f"WITH {_PANELS}, {_LINKS} SELECT rec, target, display, relation FROM l", extract.LINKS)
def entry_references(p: extract.Layout) -> DataFrame:
    links = extract.references(_dealt(p)).where("panel is not null").withColumn("owner", F.coalesce("sense", "child", "panel"))
    return extract.distinct_references(links, ["rec", "owner"]).select("rec", "target", "display", "relation")


@parsed(_WITH + "SELECT rec, local, 'shelf ' || v AS target, 'shelf' AS display FROM v WHERE v % 6 = 5")
def panel_references(p: extract.Layout) -> DataFrame:
    return extract.panel_references(p.nodes).join(_local(p), ["rec", "panel"]).select("rec", "local", "target", "display")


#: Senses that are read; ``n`` is how often.
_SENSES = """
    t AS (
        SELECT rec, '1' AS index, p_name || ' in lot' AS en, CASE WHEN v % 5 = 0 THEN '' ELSE '货' || v END AS zh, 2 - CAST(v % 7 = 0 AS INT) AS examples,
            1 + CAST(v % 5 = 0 AND p_partkey % 11 = 0 AS INT) AS links, 1 AS n FROM v
        UNION ALL SELECT rec, NULL, '', '空' || v, 0, 0, 1 FROM v WHERE v % 17 = 0
        UNION ALL SELECT rec, '2', 'sort ' || v, '分' || v, 0, 0, 1 FROM v WHERE v % 3 = 0
        UNION ALL SELECT rec, NULL, 'all of ' || v, '全' || v, 0, 0, 1 FROM v WHERE v % 4 = 1
        UNION ALL SELECT rec, NULL, 'all of ' || v, '全' || v, 0, 0, 1 FROM v WHERE v % 8 = 1
        UNION ALL SELECT rec, NULL, 'mail ' || v, '寄' || v, CAST(v % 12 = 10 AS INT), 0, 1 + CAST(v % 12 = 10 AS INT) FROM v WHERE v % 4 = 2
        UNION ALL SELECT rec, NULL, 'what is said', '俗', 0, 0, 1 FROM ph
    )
"""


@parsed(f"WITH {_PANELS}, {_SENSES} SELECT rec, index, en, zh, examples, links, CAST(n AS BIGINT) AS times FROM t")
def extract_senses(p: extract.Layout) -> DataFrame:
    read = p.senses.join(p.times, ["rec", "sense"]).join(p.failed, "rec", "left_anti")
    return read.select("rec", "index", "en", "zh", F.size("examples").alias("examples"), F.size("cross_references").alias("links"), "times")


@parsed(f"WITH {_PANELS}, {_SENSES} SELECT rec, count(*) AS kept FROM t WHERE index IS NOT NULL OR en <> '' GROUP BY rec")
def drop_empty_senses(p: extract.Layout) -> DataFrame:
    read = p.senses.join(p.times, ["rec", "sense"], "left_semi").join(p.failed, "rec", "left_anti")
    return extract.drop_empty_senses(read).groupBy("rec").agg(F.count("*").alias("kept"))


@parsed(_WITH + "SELECT rec, local, 'cross-reference' AS kind, p_name || ' in lot' AS target, 'short form of' AS relation FROM v WHERE v % 5 = 0 AND p_partkey % 11 = 0")
def contraction_to_reference(p: extract.Layout) -> DataFrame:
    s = p.senses.where("short_form").join(_local(p), ["rec", "panel"])
    return s.select("rec", "local", F.col("cross_references")[0]["kind"].alias("kind"), F.col("cross_references")[0]["target"].alias("target"), F.col("cross_references")[0]["relation"].alias("relation"))


def _roots(p: extract.Layout) -> DataFrame:
    return extract.root_senses(p.senses, extract.groups(p.nodes)).join(_local(p), ["rec", "panel"])


@parsed(_WITH + "SELECT rec, local, 'kind of ' || v AS en, '类' || v AS zh, 1 AS senses FROM v WHERE v % 3 = 0")
def group_senses(p: extract.Layout) -> DataFrame:
    g = _roots(p).select("rec", "local", F.explode("sense").alias("s")).where("s.kind = 'group'")
    return g.select("rec", "local", "s.title.en", "s.title.zh", F.size("s.senses").alias("senses"))


@parsed(_WITH + "SELECT rec, local, unnest(CASE WHEN v % 3 = 0 THEN [0, 1] ELSE [0] END) AS at, unnest(CASE WHEN v % 3 = 0 THEN ['sense', 'group'] ELSE ['sense'] END) AS kind FROM v")
def ordered_children(p: extract.Layout) -> DataFrame:
    return _roots(p).select("rec", "local", F.posexplode("sense").alias("at", "s")).select("rec", "local", "at", "s.kind")


_CHILDREN = """
    k AS (
        SELECT rec, local, 'o-idiom' AS role, 'as one ' || v AS headword, CAST(NULL AS VARCHAR) AS pos, 1 AS senses FROM v WHERE v % 4 = 1
        UNION ALL SELECT rec, local, 'o-phrasal', 'send ' || v, NULL, 1 FROM v WHERE v % 4 = 2
        UNION ALL SELECT rec, local, 'o-idiom', 'send ' || v, NULL, 1 FROM v WHERE v % 12 = 10
        UNION ALL SELECT rec, local, 'o-relation-item', 'whole' || v, 'adverb', 0 FROM v WHERE v % 4 = 3
        UNION ALL SELECT rec, local, 'o-idiom', 'saying ' || p_partkey, NULL, 1 FROM ph
    )
"""


def _children(p: extract.Layout) -> DataFrame:
    c = extract.children(p.rows).join(_local(p), ["rec", "panel"])
    return c.select("rec", "local", "role", "entry.headword", "entry.pos", F.size("entry.sense").alias("senses"))


@parsed(f"WITH {_PANELS}, {_CHILDREN} SELECT * FROM k WHERE role <> 'o-relation-item'")
def extract_children(p: extract.Layout) -> DataFrame:
    return _children(p).where("role <> 'o-relation-item'")


@parsed(f"WITH {_PANELS}, {_CHILDREN} SELECT * FROM k WHERE role = 'o-relation-item'")
def extract_derivatives(p: extract.Layout) -> DataFrame:
    return _children(p).where("role = 'o-relation-item'")


@parsed("SELECT p_partkey + 1 AS rec, 'Place ' || p_partkey AS headword, 2 AS sounds, unnest([p_name, 'only one side']) AS en, unnest(['名' || p_partkey, '']) AS zh, unnest(['near ' || p_partkey, 'far ' || p_partkey]) AS target FROM part WHERE p_partkey % 50 = 48")
def extract_supplemental(p: extract.Layout) -> DataFrame:
    s = p.supplements.join(p.failed, "rec", "left_anti")
    return s.select("rec", "headword", F.size("pronunciation").alias("sounds"), "en", "zh", F.col("cross_references")[0]["target"].alias("target"))


_ENTRIES = """
    n AS (
        SELECT (rec << 10) | local AS entry_id, h AS headword, p_type AS pos, CASE WHEN p_partkey % 10 = 9 THEN 'phrase' ELSE 'word' END AS entry_type,
            2 + CAST(v % 5 = 1 AS INT) AS sounds,
            1 + CAST(v % 3 = 0 AS INT) AS senses, CAST(v % 4 = 1 OR v % 12 = 10 AS INT) AS idioms, CAST(v % 4 = 2 AS INT) AS verbs, CAST(v % 4 = 3 AS INT) AS derivatives,
            CAST(v % 6 = 5 AS INT) AS links, 'dict' AS page FROM v
        UNION ALL SELECT (rec << 10) | local, 'saying ' || p_partkey, 'idiom', 'phrase', 0, 1, 0, 0, 0, 0, 'dict' FROM ph
        UNION ALL SELECT ((p_partkey + 1) << 10) | 1, 'Place ' || p_partkey, 'proper noun', 'word', 2, 1, 0, 0, 0, 0, 'dict' FROM part WHERE p_partkey % 50 = 48
    )
"""


@parsed(f"WITH {_PANELS}, {_ENTRIES} SELECT * FROM n")
def assemble_entries(p: extract.Layout) -> DataFrame:
    sizes = {"sounds": "pronunciation", "senses": "sense", "idioms": "child_idioms", "verbs": "child_phrasal_verbs", "derivatives": "child_derivatives", "links": "cross_references"}
    return extract.assemble(p).select("entry_id", "headword", "pos", "entry_type", *[F.size(c).alias(n) for n, c in sizes.items()], "page")


@query(_WITH + "SELECT (rec << 10) | local AS entry_id, 'saying ' || p_partkey AS headword, 'what is said' AS en FROM ph")
def promote_phrase_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first pass over all records finds those with phrase panels; they alone are assembled."""
    first = narrow(spark, sf_dir, extract.PANELS, kept=False)
    phrases = saved(extract.panels(_dealt(first)).where("is_phrase").select("rec").distinct(), "phrases")
    p = extract.Layout(derived.nodes(spark, sf_dir, first.buckets, only=phrases), derived.records(spark, sf_dir, first.buckets, phrases), DICT, first.buckets)
    return extract.assemble(p).where("pos = 'idiom'").select("entry_id", "headword", F.col("sense")[0]["definition"]["en"].alias("en"))


# Redirects -------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    led, rest = records.split_redirects(derived.redirect_records(spark, sf_dir))
    own = rest.select(text.normalize_headword(F.col("key")).alias("key"), text.pack_entry_id(F.col("record_number"), F.lit(1)).alias("entry_id"), F.col("key").alias("alias"))
    return led, own.select("key", "entry_id"), own.select("entry_id", "alias")


@query(f"{_CLOSURE} SELECT DISTINCT c.src AS key, d.entry_id FROM c JOIN d ON c.dst = d.key UNION SELECT key, entry_id FROM d")
def resolve_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, direct, _ = _graph(spark, sf_dir)
    return redirects.resolve(led, direct)


@query(f"{_CLOSURE}, m AS (SELECT a.src AS key, min(a.dst) AS name FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT string_agg(m.key, '|' ORDER BY m.key) AS members, count(*) AS size, count(d.key) AS n_direct FROM m LEFT JOIN d ON d.key = m.key GROUP BY name")
def redirect_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, direct, _ = _graph(spark, sf_dir)
    return redirects.cycles(led, direct)


@query(f"{_CLOSURE}, k AS (SELECT src FROM c JOIN d ON c.dst = d.key) SELECT record_number, 'Key  ' || (record_number - 1) AS source, 'KEY ' || t AS target FROM r WHERE t IS NOT NULL AND 'key ' || t NOT IN (SELECT src FROM k UNION SELECT key FROM d)")
def unresolved_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, direct, _ = _graph(spark, sf_dir)
    return redirects.unresolved(led, direct)


@query(f"{_CLOSURE} SELECT DISTINCT d.entry_id, 'Key  ' || substr(c.src, 5) AS alias FROM c JOIN d ON c.dst = d.key UNION SELECT entry_id, 'Key  ' || substr(key, 5) FROM d")
def attach_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, direct, own = _graph(spark, sf_dir)
    return redirects.aliases(led, redirects.resolve(led, direct), own)


# Index -----------------------------------------------------------------------------

_CANDIDATES = """
    c AS (
        SELECT p_partkey + 1 AS entry_id, p_name AS headword, '' AS anchor, 0 AS priority, p_brand || ' ' || p_type AS phonetic FROM part
        UNION ALL SELECT p_partkey + 1, p_brand, '', 1, p_brand || ' ' || p_type FROM part
        UNION ALL SELECT p_partkey + 1, unnest([p_type, p_brand]), unnest(['child_idioms.0', 'child_idioms.1']), 2, p_brand || ' ' || p_type FROM part
        UNION ALL SELECT p_partkey + 1, p_name, 'child_phrasal_verbs.0', 3, p_brand || ' ' || p_type FROM part WHERE p_size % 4 = 0
        UNION ALL SELECT p_partkey + 1, unnest(['', p_type]), unnest(['child_derivatives.0', 'child_derivatives.1']), 4, p_brand || ' ' || p_type FROM part
    ), i AS (SELECT headword, lower(headword) AS headword_normalized, phonetic, 'word' AS entry_type, entry_id, anchor FROM c WHERE headword <> ''
        QUALIFY row_number() OVER (PARTITION BY entry_id, lower(headword), anchor ORDER BY priority, headword) = 1)
"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_rows(derived.entries(spark, sf_dir), derived.aliases(spark, sf_dir))


@query(f"WITH {_CANDIDATES} SELECT entry_id, headword, anchor, priority FROM c")
def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.candidates(derived.entries(spark, sf_dir), derived.aliases(spark, sf_dir))


@query(f"WITH {_CANDIDATES} SELECT * FROM i")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedupe_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_WORDS = "q AS (SELECT DISTINCT upper(p_name) AS word FROM part UNION SELECT DISTINCT upper(p_type) FROM part UNION SELECT 'MISS'), hits AS (SELECT DISTINCT word, entry_id FROM q JOIN i ON lower(q.word) = i.headword_normalized), best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY word ORDER BY entry_id) <= 100)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.upper("p_name").alias("word")).union(part.select(F.upper("p_type"))).union(spark.createDataFrame([("MISS",)], "word string"))


@query(f"WITH {_CANDIDATES}, {_WORDS} SELECT q.word, b.entry_id, coalesce(t.total, 0) AS total FROM q LEFT JOIN best b USING (word) LEFT JOIN (SELECT word, count(*) AS total FROM best GROUP BY word) t USING (word)")
def lookup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups in the stored index."""
    e = derived.entries(spark, sf_dir)
    root = files.new_folder(spark, "dictionary")
    files.write_dictionary(e.select("entry_id", F.to_json(F.struct("*")).alias("json")), _index(spark, sf_dir), root)
    return index.lookup_stored(_words(spark, sf_dir), files.read_dictionary(spark, root)[1])


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 100")
def top_n_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return windows.top_n(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 100)


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END || doc_id AS id, CASE WHEN doc_id % 7 = 0 OR doc_id = 0 THEN 'invalid' WHEN p_partkey IS NULL THEN 'missing' ELSE 'ok' END AS status, CASE WHEN doc_id % 7 <> 0 THEN p_name END AS headword FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN part ON p_partkey + 1 = doc_id")
def lookup_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    ids = ids.select(F.concat(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""), "doc_id").alias("id"))
    return index.lookup_entries(ids, derived.entries(spark, sf_dir).select("entry_id", "headword")).select("id", "status", "headword")


@query(f"WITH {_CANDIDATES} SELECT entry_id, headword, anchor FROM i WHERE entry_id - 1 NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 50 <> 7)")
def dangling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of parts that were not sold, one part in fifty among them."""
    sold = table(spark, sf_dir, "lineitem").where("l_partkey % 50 <> 7").select((F.col("l_partkey") + 1).alias("entry_id")).distinct()
    return index.dangling(_index(spark, sf_dir), sold).select("entry_id", "headword", "anchor")


@query("SELECT p_partkey + 1 AS entry_id FROM part WHERE p_partkey % 50 = 11")
def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part in fifty has lost its index rows."""
    e = derived.entries(spark, sf_dir)
    return index.roundtrip_failures(_index(spark, sf_dir).where("entry_id % 50 <> 12"), e.select("entry_id", F.to_json(F.struct("*")).alias("json")))


# Media -----------------------------------------------------------------------------

_REFERENCES = "f AS (SELECT DISTINCT 'DOC_' || doc_id || '.mp3' AS name FROM labels UNION SELECT DISTINCT 'gone_' || doc_id || '.mp3' FROM labels WHERE quality = 0), a AS (SELECT source AS archive, doc_id AS position, doc_id // 64 AS block_no, 'doc_' || doc_id || '.mp3' AS name, octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS n FROM documents)"


@query(f"WITH {_PANELS}, {_AUDIO} SELECT DISTINCT name FROM a UNION SELECT '../up.mp3' FROM part WHERE p_partkey % 50 = 41")
def union_media_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived.nodes(spark, sf_dir)
    said = extract.chunks(n).select(F.col("file").alias("name")).where("name is not null")
    return extract.audio_references(n).select("name").union(said).distinct()


@parsed(f"WITH {_PANELS}, {_AUDIO} SELECT count(DISTINCT name) AS references FROM a")
def unique_media_refs(p: extract.Layout) -> DataFrame:
    return extract.audio_references(p.nodes).join(p.failed, "rec", "left_anti").agg(F.count_distinct("name").alias("references"))


@query(f"WITH {_REFERENCES} SELECT archive, position, name FROM a WHERE name IN (SELECT lower(name) FROM f)")
def select_referenced_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.select_referenced(derived.media(spark, sf_dir), derived.media_references(spark, sf_dir)).select("archive", "position", "name")


@query(f"WITH {_REFERENCES} SELECT name FROM f WHERE lower(name) NOT IN (SELECT name FROM a)")
def missing_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.missing(derived.media(spark, sf_dir), derived.media_references(spark, sf_dir))


@query("SELECT 'src_' || s_nationkey || '.mp3' AS name, count(*) AS copies, count(DISTINCT s_name) AS checksums FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def duplicate_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src_"), "s_nationkey", F.lit(".mp3")).alias("name"), F.col("s_name").cast("binary").alias("content"), "s_suppkey")
    return media.duplicates(s, ["s_suppkey"])[1]


@query("SELECT 'src_' || s_nationkey || '.mp3' AS name, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey")
def keep_first_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src_"), "s_nationkey", F.lit(".mp3")).alias("name"), F.col("s_name").cast("binary").alias("content"), "s_suppkey")
    return media.duplicates(s, ["s_suppkey"])[0].select("name", "s_suppkey")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records with their offsets in an archive's unpacked bytes, and the blocks of 64 ids."""
    m = derived.media(spark, sf_dir).withColumn("n", F.octet_length("content").cast("long"))
    at = windows.sums_before(m.select("archive", "position", "block_no", "n"), "archive", ["position"], {"offset": "n"})
    blocks = m.groupBy("archive", "block_no").agg(F.sum("n").alias("size"), F.count("*").alias("packed_size"))
    return at, blocks


_PACKED = f"{_REFERENCES}, pos_ AS (SELECT archive, position, block_no, n, CAST(coalesce(sum(n) OVER (PARTITION BY archive ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM a), b AS (SELECT archive, block_no, CAST(sum(n) AS BIGINT) AS size, count(*) AS packed_size FROM a GROUP BY ALL), y AS (SELECT *, CAST(coalesce(sum(packed_size) OVER w, 0) AS BIGINT) AS packed_start, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS start FROM b WINDOW w AS (PARTITION BY archive ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {_PACKED} SELECT archive, position, offset_ + n AS \"end\" FROM pos_")
def next_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, _ = _packed(spark, sf_dir)
    total = at.groupBy("archive").agg(F.sum("n").alias("total"))
    total = total.withColumnRenamed("archive", "_a")
    sized = at.join(total, F.col("archive").eqNullSafe(F.col("_a"))).drop("_a")
    return media.next_offset(sized, "total").select("archive", "position", "end")


@query(f"WITH {_PACKED} SELECT archive, CAST(block_no AS INT) AS block_no, packed_start, start FROM y")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.block_layout(_packed(spark, sf_dir)[1]).select("archive", "block_no", "packed_start", "start")


@query(f"WITH {_PACKED} SELECT q.archive, position, CAST(y.block_no AS INT) AS block_no, offset_ - start AS inner_ FROM pos_ q ASOF JOIN y ON q.archive = y.archive AND q.offset_ >= y.start")
def locate_packed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, blocks = _packed(spark, sf_dir)
    found = media.locate(at.select("archive", "position", "offset"), media.block_layout(blocks))
    return found.select("archive", "position", "block_no", F.col("inner").alias("inner_"))


@query(f"WITH {_REFERENCES} SELECT archive, position, md5(CASE WHEN position % 3 = 0 THEN 'ID3' ELSE '' END || coalesce(d.text, '')) AS digest FROM a JOIN documents d ON d.doc_id = a.position")
def slice_packed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents cut out of the blocks that they were packed into."""
    at, blocks = _packed(spark, sf_dir)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("content").cast("string").alias("t")))), lambda x: x["t"]), "")
    packed = derived.media(spark, sf_dir).groupBy("archive", "block_no").agg(whole.cast("binary").alias("content"))
    found = media.locate(at.select("archive", "position", "offset", (F.col("offset") + F.col("n")).alias("end")), media.block_layout(blocks))
    return media.sliced(found, packed).select("archive", "position", F.md5("content").alias("digest"))


@query("SELECT source AS archive, count(*) + 1 AS declared, count(*) AS packed_total FROM documents WHERE source > (SELECT min(source) FROM documents) GROUP BY source")
def layout_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All archives but the first declare one file too many."""
    blocks = _packed(spark, sf_dir)[1]
    sizes = blocks.groupBy("archive").agg(F.sum("packed_size").alias("n"))
    first = sizes.agg(F.min("archive").alias("first"))
    declared = sizes.join(first).select("archive", (F.col("n") + F.when(F.col("archive") > F.col("first"), 1).otherwise(0)).alias("declared"))
    return media.layout_errors(blocks, declared)


@query(f"WITH {_REFERENCES}, n AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN '../' ELSE '' END || 'doc_' || (doc_id * 2) || '.mp3' AS name FROM labels) SELECT n.name, CASE WHEN n.name LIKE '%/%' THEN 'unsafe' WHEN a.n IS NULL THEN 'missing' ELSE 'ok' END AS status, a.n AS length FROM n LEFT JOIN a ON n.name = a.name")
def lookup_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("doc_id")
    names = table(spark, sf_dir, "labels").select(F.concat(F.when(ids % 5 == 0, "../").otherwise(""), F.lit("doc_"), ids * 2, F.lit(".mp3")).alias("name")).distinct()
    return media.lookup(names, derived.media(spark, sf_dir)).select("name", "status", "length")


@query(f"WITH {_REFERENCES}, k AS (SELECT * FROM a WHERE name IN (SELECT lower(name) FROM f)) SELECT (SELECT count(*) FROM f) AS requested, count(DISTINCT name) AS stored, count(DISTINCT (archive, block_no)) AS blocks, (SELECT count(*) FROM f) - count(DISTINCT name) AS missing, count(*) - count(DISTINCT name) AS duplicates FROM k")
def media_import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.import_stats(derived.media_references(spark, sf_dir), derived.media(spark, sf_dir))


@query("SELECT 'doc_' || doc_id || '.mp3' AS name, 'header' AS problem FROM documents WHERE doc_id % 3 <> 0 AND NOT starts_with(coalesce(text, ''), 'ID3')")
def verify_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.verify(derived.media(spark, sf_dir))


@query(f"WITH {_CRC_TABLE}, {_FILES}, j AS (SELECT string_agg(h, '' ORDER BY name) AS h, count(*) AS files FROM d), b AS (SELECT files, {_BYTES.format(h='h')} FROM j) SELECT {_CRC} AS crc, len(bytes) AS bytes, files FROM b, t")
def combined_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.combined_crc32(derived.media(spark, sf_dir))


@query(f"WITH {_REFERENCES} SELECT DISTINCT name FROM f WHERE lower(name) NOT IN (SELECT name FROM a WHERE n > 0)")
def check_media_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = derived.media_references(spark, sf_dir).select(text.media_url(DICT, F.col("name")).alias("url"))
    names = urls.select(text.percent_decoded(F.regexp_extract("url", "[^/]*$", 0)).alias("name")).distinct()
    full = derived.media(spark, sf_dir).where(F.octet_length("content") > 0)
    return media.missing(full, names)


# Audit -----------------------------------------------------------------------------

#: Counters of every sound record; the second layout has few.
_METRICS = f"""
    {_PANELS}, {_EXAMPLES}, {_SENSES}, {_LINKS},
    e AS (SELECT rec, count(*) AS retained_examples, count(DISTINCT (v, nth = 3)) AS retained_example_lists, CAST(sum(CAST(en = '' AS INT)) AS BIGINT) AS missing_english_examples,
        CAST(sum(CAST(zh = '' AS INT)) AS BIGINT) AS missing_chinese_examples, CAST(sum(CAST(nth = 3 AS INT)) AS BIGINT) AS duplicate_example_imports FROM x GROUP BY rec),
    b AS (SELECT rec, CAST(sum(CAST(v % 2 = 0 AS INT)) AS BIGINT) + CAST(any_value(p_partkey) % 3 = 0 AS INT) AS excluded_examples, CAST(sum(CAST(v % 13 = 0 AS INT)) AS BIGINT) AS orphan_examples,
        CAST(sum(CAST(v % 5 = 0 AND p_partkey % 11 = 0 AS INT)) AS BIGINT) AS short_forms FROM v GROUP BY rec),
    s AS (SELECT rec, CAST(sum(CASE WHEN en <> '' AND zh <> '' THEN n ELSE 0 END) AS BIGINT) AS definition_pairs, CAST(sum(CASE WHEN en <> '' AND zh = '' THEN n ELSE 0 END) AS BIGINT) AS english_only,
        CAST(sum(CASE WHEN en = '' THEN n ELSE 0 END) AS BIGINT) AS chinese_only_definitions FROM t GROUP BY rec),
    k AS (SELECT rec, count(*) AS links FROM l GROUP BY rec),
    m AS (
        SELECT rec, definition_pairs, english_only - short_forms AS english_only_definitions, chinese_only_definitions, links + short_forms AS cross_references,
            retained_examples + excluded_examples + orphan_examples AS raw_examples, retained_examples, retained_example_lists, excluded_examples,
            missing_english_examples, missing_chinese_examples, orphan_examples, duplicate_example_imports
        FROM e JOIN b USING (rec) JOIN s USING (rec) JOIN k USING (rec)
        UNION ALL SELECT p_partkey + 1, 1, 1, 0, 2, 1, 0, 0, 0, 0, 0, 0, 0 FROM part WHERE p_partkey % 50 = 48
    )
"""
#: Redirects to the records, and those that lead nowhere: ``t`` is the record that is reached.
_BUILD = """
    q AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 1 THEN 'self' WHEN p_partkey % 89 = 3 THEN 'nowhere' WHEN p_partkey % 4 = 0 THEN 'ware' WHEN p_partkey % 4 = 3 THEN 'also' END AS kind FROM part),
    g AS (SELECT q.k, q.kind, CASE WHEN q.kind = 'ware' THEN q.k WHEN q.kind = 'also' AND u.kind = 'ware' THEN u.k END AS t FROM q LEFT JOIN q u ON u.k = q.k + 1 WHERE q.kind IS NOT NULL),
    ok AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 50 < 40 OR p_partkey % 50 = 48),
    lost AS (SELECT g.* FROM g LEFT JOIN ok ON g.t = ok.k WHERE ok.k IS NULL)
"""


@parsed(f"WITH {_METRICS} SELECT * FROM m")
def record_metrics(p: extract.Layout) -> DataFrame:
    return extract.record_metrics(p)


def _built(spark: SparkSession, sf_dir: str) -> audit.Build:
    """One build over the markup records and the redirects to them."""
    p = layout(spark, sf_dir)
    return audit.Build(p, extract.assemble(p), records.split_redirects(derived.build_redirects(spark, sf_dir))[0])


_TOTALS = f"""
    {_METRICS}, {_ENTRIES}, {_AUDIO}, {_BUILD},
    totals AS (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in extract.METRICS)} FROM m),
    whole AS (
        SELECT greatest((SELECT max(p_partkey) + 1 FROM part), (SELECT max(k) + 10000000 FROM g)) AS mdx_records, (SELECT count(*) FROM g) AS redirects, (SELECT count(*) FROM n) AS entries,
            (SELECT count(*) FROM n WHERE pos = 'idiom') AS missing_uk_pronunciation, (SELECT count(*) FROM n WHERE pos = 'idiom') AS missing_us_pronunciation,
            (SELECT count(DISTINCT name) FROM a) AS unique_audio_references, totals.* FROM totals
    ),
    lists AS (SELECT unnest(['parse_failures', 'id_collisions', 'redirect_cycles', 'unresolved_redirects']) AS name,
        unnest([(SELECT count(*) FROM part WHERE p_partkey % 50 >= 40 AND p_partkey % 50 <> 48), 0, (SELECT count(*) FROM q WHERE kind = 'self'), (SELECT count(*) FROM lost)]) AS value)
"""


@query(f"WITH {_TOTALS} SELECT * FROM whole")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).totals()


@parsed(_WITH + "SELECT rec, count(*) AS orphans FROM v WHERE v % 13 = 0 GROUP BY rec")
def orphan_examples(p: extract.Layout) -> DataFrame:
    return extract.orphan_examples(p).groupBy("rec").agg(F.count("*").alias("orphans"))


@query("SELECT CAST(sum(CAST(p_size % 7 = 0 AS INT)) AS BIGINT) AS missing_uk, CAST(sum(CAST(p_size % 2 <> 0 AS INT)) AS BIGINT) AS missing_us FROM part")
def missing_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_regions(derived.entries(spark, sf_dir))


#: What the build should have by the table: entries as they are, and as many definitions as there are panels.
_EXPECTED = "SELECT 'entries' AS name, (SELECT count(*) FROM n) AS expected UNION ALL SELECT 'redirects', (SELECT count(*) FROM part) UNION ALL SELECT 'stored_audio', (SELECT count(*) FROM documents)"


@query(f"""
    WITH {_TOTALS}, u AS (UNPIVOT whole ON * INTO NAME name VALUE value)
    SELECT w.name, 'expected ' || expected || ', got ' || coalesce(CAST(value AS VARCHAR), 'none') AS message FROM ({_EXPECTED}) w LEFT JOIN u USING (name) WHERE expected IS DISTINCT FROM value
    UNION ALL SELECT name, 'must be 0, got ' || value FROM u WHERE name IN ({', '.join(f"'{c}'" for c in audit.MUST_BE_ZERO)}) AND value <> 0
    UNION ALL SELECT name, 'must be empty, has ' || value FROM lists WHERE value <> 0
""")
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of one build; two expectations fail by design, and so do the faults that the records have."""
    b = _built(spark, sf_dir)
    one = lambda name, df: df.agg(F.count("*").alias("expected")).select(F.lit(name).alias("name"), "expected")
    wanted = one("entries", b.entries).unionByName(one("redirects", table(spark, sf_dir, "part"))).unionByName(one("stored_audio", table(spark, sf_dir, "documents")))
    return audit.gate(audit.unpivot(b.totals()), wanted, list(audit.MUST_BE_ZERO), b.lists())


_GOOD = f"""
    {_METRICS}, {_ENTRIES}, {_AUDIO}, {_BUILD},
    good AS (SELECT rec FROM m WHERE {' AND '.join(f'{c} = 0' for c in audit.MUST_BE_ZERO)}),
    gone AS (SELECT DISTINCT rec FROM a WHERE (rec - 1) % 53 = 52 AND rec IN (SELECT rec FROM good)), whole AS (SELECT rec FROM good WHERE rec NOT IN (SELECT rec FROM gone)),
    faults AS (SELECT 'first' AS build, (SELECT count(*) FROM (
        {' UNION ALL '.join(f"SELECT 1 FROM m HAVING sum({c}) <> 0" for c in audit.MUST_BE_ZERO)}
        UNION ALL SELECT 1 FROM part WHERE p_partkey % 50 >= 40 AND p_partkey % 50 <> 48 HAVING count(*) > 0
        UNION ALL SELECT 1 FROM q WHERE kind = 'self' HAVING count(*) > 0 UNION ALL SELECT 1 FROM lost HAVING count(*) > 0)) AS errors)
"""


@query(f"""
    WITH {_GOOD}
    SELECT 'first' AS build, 'failed' AS status, errors, CAST(NULL AS BIGINT) AS entries, CAST(NULL AS BIGINT) AS media FROM faults
    UNION ALL SELECT 'second', 'passed', 0, (SELECT count(*) FROM n WHERE (entry_id >> 10) IN (SELECT rec FROM whole)), (SELECT count(DISTINCT name) FROM a WHERE rec IN (SELECT rec FROM whole))
""")
def publish_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds: of all records, which is refused, and of those that stand the audit and whose audio is there."""
    root = files.new_folder(spark, "publications")
    archive = derived.word_audio(spark, sf_dir)
    none = spark.createDataFrame([], "name string, expected long")
    first = _built(spark, sf_dir)
    refused = publish.publish(first, archive, root, none, version=1)
    good, led = publish.sound_part(first)
    audio = saved(extract.audio_references(first.layout.nodes), "audio")
    silent = audio.join(media.missing(archive, audio), "name").select("rec").distinct()
    second = publish.publish(_part_of(first, saved(good.join(silent, "rec", "left_anti"), "whole"), led), archive, root, none, version=2)
    done = publish.published(spark, root).select(F.col("build").alias("id"), "entries", "media")
    row = lambda name, s: publish.read_audit(spark, s.path).select(F.lit(name).alias("build"), F.col("build").alias("id"), "status", F.size("errors").cast("long").alias("errors"))
    return row("first", refused).unionByName(row("second", second)).join(done, "id", "left").drop("id")


def _part_of(b: audit.Build, kept: DataFrame, led: DataFrame) -> audit.Build:
    """A build over some of the records of another, with their entries, and the redirects that still lead somewhere."""
    x = b.layout
    own = saved(x.records.join(kept.withColumnRenamed("rec", "record_number"), "record_number", "left_semi").select("record_number", "key"), "records")
    part = x.part(kept, own)
    direct = own.select(text.normalize_headword(F.col("key")).alias("key"), F.col("record_number").alias("entry_id"))
    lost = redirects.unresolved(led, direct).select("record_number")
    return audit.Build(part, b.entries.join(kept, "rec", "left_semi"), saved(led.join(lost, "record_number", "left_anti"), "led"))


@query("""
    WITH t AS (SELECT conv_id * 1000 + turn AS entry_id, role, text AS en, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS zh FROM conversations)
    SELECT entry_id, unnest(list_filter([CASE WHEN entry_id <= 0 THEN 'entry_id' END, CASE WHEN role <> 'user' THEN 'entry_type' END, CASE WHEN coalesce(trim(en), '') = '' OR coalesce(trim(zh), '') = '' THEN 'one_sided' END], lambda x: x IS NOT NULL)) AS rule FROM t
""")
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries: a user's turn and the assistant's next one are the two sides."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("zh", F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(w))
    kind = F.when(F.col("role") == "user", "word").otherwise(F.col("role"))
    sense = f"array(named_struct('kind', 'sense', 'index', null, 'labels', null, 'definition', named_struct('en', text, 'zh', zh), 'examples', array(), 'cross_references', array(), 'title', null, 'senses', null))"  # noqa: F541
    from glossia.schemas import NODE, PRON

    entries = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.lit("turn").alias("headword"), F.lit("turn").alias("pos"), kind.alias("entry_type"), F.array().cast(f"array<{PRON}>").alias("pronunciation"), F.expr(sense).cast(f"array<{NODE}>").alias("sense"))
    return contract.violations(entries).select("entry_id", "rule")


@query(f"SELECT CASE WHEN k = 1 THEN -1 - p_partkey ELSE 1 + p_partkey END AS entry_id, path, rule FROM part JOIN (VALUES {', '.join(map(str, derived.CONTRACT_FAULTS))}) f(k, path, rule) ON p_partkey % 40 = k")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that break one rule each in most of forty, at every level of their schema."""
    return contract.violations(derived.contract_entries(spark, sf_dir))


@query(f"WITH {_CANDIDATES} SELECT (SELECT count(*) FROM part WHERE p_partkey % 50 <> 17) AS entries, (SELECT count(*) FROM i) AS indices, (SELECT count(*) FROM part WHERE p_partkey % 50 = 13) AS id_mismatches, (SELECT count(*) FROM i WHERE (entry_id - 1) % 50 = 17) AS dangling")
def verify_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fifty entries one says another id than its own, and one is gone."""
    e = derived.entries(spark, sf_dir).where("entry_id % 50 <> 18")
    said = F.when(F.col("entry_id") % 50 == 14, F.col("entry_id") + 1).otherwise(F.col("entry_id"))
    return audit.verify_dictionary(e.select("entry_id", F.to_json(F.struct(said.alias("entry_id"), "headword")).alias("json")), _index(spark, sf_dir))


@query(f"WITH {_REFERENCES} SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY name) - 1 AS at, name FROM a WHERE name IN (SELECT lower(name) FROM f)")
def sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.select_referenced(derived.media(spark, sf_dir), derived.media_references(spark, sf_dir))
    return windows.sums_before(kept.select("archive", "name", F.lit(1).cast("long").alias("one")), "archive", ["name"], {"at": "one"}).drop("one")


_LINES = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 7 ORDER BY md5('7:' || {_LINES}), {_LINES} LIMIT 10000")
def fixed_size_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of lines; the seventh of an order is blank."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("key", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    line = F.when(F.col("l_linenumber") == 7, " ").otherwise(F.col("key"))
    return windows.fixed_size_sample(lines.withColumn("line", line), "line", "key", 10_000, 7).drop("line", "key")


# Sinks -----------------------------------------------------------------------------


@query("SELECT p_partkey + 1 AS entry_id, p_name AS headword, 2 AS sounds, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS verbs FROM part")
def write_entries_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.entries(spark, sf_dir)
    back = files.read_entries_jsonl(spark, files.write_entries_jsonl(e, files.new_folder(spark, "entries")))
    return back.select("entry_id", "headword", F.size("pronunciation").alias("sounds"), F.size("child_phrasal_verbs").alias("verbs"))


@query("SELECT entry_id, CAST(NULL AS VARCHAR) AS page, word AS headword FROM (SELECT p_partkey + 1 AS entry_id, p_name AS word FROM part)")
def read_entries_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.entries(spark, sf_dir)
    return files.read_entries_jsonl(spark, files.write_entries_jsonl(e, files.new_folder(spark, "entries"))).select("entry_id", "page", "headword")


@query(f"WITH {_CANDIDATES} SELECT headword_normalized, count(*) AS rows, count(DISTINCT entry_id) AS entries FROM i GROUP BY ALL")
def write_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = files.new_folder(spark, "dictionary")
    e = derived.entries(spark, sf_dir)
    files.write_dictionary(e.select("entry_id", F.to_json(F.struct("*")).alias("json")), _index(spark, sf_dir), root)
    _, rows = files.read_dictionary(spark, root)
    return rows.groupBy("headword_normalized").agg(F.count("*").alias("rows"), F.count_distinct("entry_id").alias("entries"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_media(spark, files.write_media(derived.media(spark, sf_dir), files.new_folder(spark, "media")))


_STORED = "SELECT 'doc_' || doc_id || '.mp3' AS name, md5(CASE WHEN doc_id % 3 = 0 THEN 'ID3' ELSE '' END || coalesce(text, '')) AS digest FROM documents"
query(_STORED, "write_media")(lambda spark, sf_dir: _stored(spark, sf_dir).select("name", F.md5("content").alias("digest")))
query(f"SELECT name, digest FROM ({_STORED}) ORDER BY name", "read_media")(lambda spark, sf_dir: _stored(spark, sf_dir).select("name", F.md5("content").alias("digest")))


@query(f"WITH {_TOTALS} SELECT definition_pairs, entries, mdx_records, redirects FROM whole")
def write_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.write_audit(_built(spark, sf_dir).totals(), files.new_folder(spark, "audit"))
    return spark.read.schema("definition_pairs long, entries long, mdx_records long, redirects long").json(path)


@query("SELECT kind, 1 AS version, rows, sound FROM (SELECT unnest(['entries', 'media', 'late']) AS kind, unnest([(SELECT count(*) FROM part), (SELECT count(*) FROM documents), 2 * (SELECT count(*) FROM part)]) AS rows, unnest([TRUE, TRUE, FALSE]) AS sound)")
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written, and whether it still is what its manifest says; ``late`` was written to afterwards."""
    root = files.new_folder(spark, "build")
    e = files.write_entries_jsonl(derived.entries(spark, sf_dir), f"{root}/entries")
    late = files.write_entries_jsonl(derived.entries(spark, sf_dir), f"{root}/late")
    m = files.write_media(derived.media(spark, sf_dir), f"{root}/media")
    said = saved(files.manifest(spark, [e, late, m], version=1), "manifest")
    derived.entries(spark, sf_dir).write.mode("append").json(late)
    one = lambda kind, df: df.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
    counts = one("entries", files.read_entries_jsonl(spark, e)).unionByName(one("late", files.read_entries_jsonl(spark, late))).unionByName(one("media", files.read_media(spark, m)))
    return counts.join(files.verified(said, files.manifest(spark, [e, late, m], version=1)), "kind").select("kind", "version", "rows", "sound")


@query("SELECT (SELECT count(*) FROM part) AS entries, count(*) AS media, CAST(sum(octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS bytes FROM documents")
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dataset_info(derived.entries(spark, sf_dir), derived.media(spark, sf_dir))
