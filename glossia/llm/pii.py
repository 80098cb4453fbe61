r"""Personal data: base patterns, and terms that give a protected entity away.

Base entities (e-mail and IP addresses, card and phone numbers) are found by regular
expressions over whole texts. Then, information-theoretic sanitisation: a term in a text
with an entity discloses it as far as the corpus says so. With probabilities from counts
over the whole corpus, the information an entity carries is IC(e) = -log p(e) and what a
term tells of it is PMI(t;e) = log p(t,e) / (p(t) p(e)); their ratio is 1 if the term
never occurs without the entity. Terms whose ratio reaches ``GENERALISE`` are replaced
by a class, those that reach ``REMOVE`` are removed.

How likely the entity comes with the term is taken at its lower 95 % bound. Evidence are
the contexts of the entity, each different one once in the corpus, as far as the term
occurs as often in its text; copies of a text or of a passage are no evidence. A bound below
``CERTAIN`` marks nothing, whatever the size of the corpus: so a name that stands once
beside an address is left. Entities that occur in exactly the same texts are one, as
nothing in the corpus tells them apart. For e-mail addresses of fewer than ``SUPPORT``
contexts what a term tells of their domain counts too.
Terms of the whole text are counted, and marked wherever they stand in it.

Everything is DataFrame and SQL functions. ``split`` and ``regexp_extract_all`` walk the
same matches, so running sums of the parts' lengths give the spans, in code points. They
are window sums over one row a match of a distinct text, and no list is compared with
another one, so time is in proportion to a text's matches and terms. The Java patterns
match what the plain ones do, but never try a run of characters again from its middle
(where the first try failed, the others would) and never recurse, so their time is
linear and long runs don't overflow the stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossia.llm.durable import saved, unused

KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind -> (a cheap test that a text may have one, the pattern, the test of a match ``v``)
PATTERNS = {
    "email": (
        "contains(text, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
    ),
    "ip": (
        r"text rlike '[0-9][.][0-9]'",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"v rlike '\\A{_BYTE}(?:[.]{_BYTE}){{3}}\\z'",
    ),
    # the whole run of digits and single separators, if it has 16 to 19 digits
    "card": (
        r"text rlike '[0-9](?:[ -]?[0-9]){15}'",
        r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9]))[0-9]++(?:[ -][0-9]++)*+",
        "luhn_check(regexp_replace(v, '[ -]', ''))",
    ),
    "phone": (
        "contains(text, '+')",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "char_length(regexp_replace(v, '[^0-9]', '')) between 8 and 15",
    ),
}
#: Characters on either side of an entity by which its contexts are told apart.
CONTEXT = 160
SUPPORT = 3
CERTAIN = 0.25
#: Buckets of the terms with evidence; they are broadcast, so that few other terms are counted.
TERM_BUCKETS = 1 << 20
GENERALISE = 0.8
REMOVE = 0.95
#: Code points in a chunk of a text, see ``_pieced``.
_CHUNK = 4096
_TERM = r"[\p{L}\p{N}]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, around: int = 0) -> str:
    """SQL for the matches in ``text`` in order: ``m``, its length ``n``, and ``step``, n plus the gap before it.

    With ``around`` also ``near``, a hash of at most as many characters on either side,
    up to the next match.
    """
    p = _quoted(pattern)
    near = f", 'near', xxhash64(right(gaps[i], {around}), left(gaps[i + 1], {around}))" if around else ""
    return f"""transform(array(named_struct('all', regexp_extract_all(text, {p}, 0), 'gaps', split(text, {p}, -1))), a ->
        transform(a.all, (m, i) -> named_struct('m', m, 'n', char_length(m), 'step', char_length(a.gaps[i]) + char_length(m){near.replace('gaps', 'a.gaps')})))[0]"""


def _placed(parts: DataFrame, by: list[str]) -> DataFrame:
    """``s, e`` of matches ``(n, step)`` that are in order of ``at`` in each ``by``; code points, e exclusive."""
    upto = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = parts.withColumn("e", F.sum("step").over(upto).cast("int"))
    return ended.withColumn("s", F.col("e") - F.col("n"))


def _may() -> Column:
    """A cheap test that is true of every text with base entities."""
    return F.expr(" or ".join(f"({test})" for test, _, _ in PATTERNS.values()))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tkey``: null texts are empty, tkey is the text's MD5."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("tkey", F.md5("text"))


def _kinds() -> str:
    return "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"


def base_spans(rows: DataFrame) -> DataFrame:
    """``tkey, kind, s, e, v, near``: the base entities of each distinct text of ``keyed`` rows, saved."""
    none = "cast(array() as array<struct<m: string, n: int, step: int, near: bigint>>)"
    each = ", ".join(f"named_struct('kind', '{kind}', 'found', if({may}, {_matches(pattern, CONTEXT)}, {none}))" for kind, (may, pattern, _) in PATTERNS.items())
    found = rows.where(_may()).select("tkey", F.expr(f"inline(filter(array({each}), x -> size(x.found) > 0))"))
    parts = found.select("tkey", "kind", F.posexplode("found").alias("at", "x")).select("tkey", "kind", "at", "x.*")
    once = parts.groupBy("tkey", "kind", "at").agg(*[F.first(c).alias(c) for c in ("m", "n", "step", "near")])  # copies of a text
    valid = F.expr("case kind " + " ".join(f"when '{kind}' then {test.replace('v ', 'm ').replace('(v,', '(m,')}" for kind, (_, _, test) in PATTERNS.items()) + " end")
    placed = _placed(once, ["tkey", "kind"]).where(valid)
    return saved(placed.select("tkey", "kind", "s", "e", F.col("m").alias("v"), "near"), "base_spans")


def _texts(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``tkey, copies, text, found`` of each distinct text with entities; found is in order of start.

    ``w`` of a span is from where its text is not covered by spans before it.
    """
    before = Window.partitionBy("tkey").orderBy("s", "e", "kind").rowsBetween(Window.unboundedPreceding, -1)
    outside = spans.withColumn("w", F.coalesce(F.max("e").over(before), F.lit(0)))
    found = outside.groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("s", "e", "w"))).alias("found"))
    some = rows.where(_may()).join(found.select("tkey"), "tkey", "left_semi")
    some = some.groupBy("tkey").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    return saved(some.join(found, "tkey"), "entity_texts")


def _pieced(spans: str, label: str) -> Column:
    """``text`` with each span put as ``label``; spans ``(s, e, w)`` in order, overlaps belong to the first.

    What stands between spans is cut from chunks of the text, as a cut is found by
    walking from the start.
    """
    chunks = f"transform(sequence(0, char_length(text) div {_CHUNK}), i -> substring(text, cast(i as int) * {_CHUNK} + 1, {_CHUNK}))"
    cut = "substring({of}, {at} + 1, x.s - x.w)"
    near = cut.format(of=f"c[cast(x.w div {_CHUNK} as int)]", at=f"x.w % {_CHUNK}")
    gap = f"if(x.s <= x.w, '', if((x.s - 1) div {_CHUNK} = x.w div {_CHUNK}, {near}, {cut.format(of='text', at='x.w')}))"
    rest = f"if(size({spans}) = 0, text, substring(text, array_max(transform({spans}, x -> x.e)) + 1))"
    return F.expr(f"transform(array({chunks}), c -> concat(array_join(transform({spans}, x -> concat({gap}, {label})), ''), {rest}))[0]")


def terms_of(texts: DataFrame) -> DataFrame:
    """``tkey, term, s, e`` of all terms of the texts, saved; entities belong to no term and end them."""
    blank = _pieced("found", "if(x.e > greatest(x.s, x.w), repeat(' ', x.e - greatest(x.s, x.w)), '')")
    walked = texts.select("tkey", blank.alias("text")).select("tkey", F.posexplode(F.expr(_matches(_TERM))).alias("at", "x"))
    placed = _placed(walked.select("tkey", "at", "x.*"), ["tkey"])
    return saved(placed.select("tkey", F.lower("m").alias("term"), "s", "e"), "entity_terms")


def entities(spans: DataFrame) -> DataFrame:
    """``tkey, name, class, near`` of base spans.

    What counts as the same entity: letter case and separators don't matter. The class
    of an e-mail address is its domain. Others have none: that a text has some number
    gives no number away.
    """
    name = "if(kind = 'email', lower(v), concat(kind, ':', regexp_replace(v, '[^0-9.]', '')))"
    group = "if(kind = 'email', lower(substring_index(v, '@', -1)), null)"
    return spans.select("tkey", F.expr(name).alias("name"), F.expr(group).alias("class"), "near")


def held_by(texts: DataFrame, each: DataFrame, level: str) -> DataFrame:
    """``tkey, copies, name, k``, saved: what of the level (``name`` or ``class``) each text holds.

    k counts contexts that no text of a smaller key has, so a passage that many texts
    share is evidence once.
    """
    each = each.where(F.col(level).isNotNull())
    first = each.groupBy(level, "near").agg(F.min("tkey").alias("tkey")).groupBy("tkey", level).agg(F.count("*").alias("k"))
    held = each.select("tkey", level).distinct().join(texts.select("tkey", "copies"), "tkey").join(first, ["tkey", level], "left")
    return saved(held.select("tkey", "copies", F.col(level).alias("name"), F.coalesce("k", F.lit(0)).alias("k")), "held")


def bounded(seen: Column, outside: Column) -> Column:
    """A lower 95 % bound of how likely a term comes with what it stood beside.

    The lesser of Wilson's bound and ``p 0.05^(1/seen)``, exact if it never stood elsewhere.
    """
    k, n, z2 = seen.cast("double"), (seen + outside).cast("double"), F.lit(1.645**2)
    p = k / n
    wilson = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    return F.least(wilson, p * F.pow(F.lit(0.05), 1 / k))


def _grouped(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tkey, team, copies, k`` and ``tkey, name, team``: names of exactly the same texts are one team."""
    sign = [F.bit_xor(F.xxhash64("tkey")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "tkey"), F.lit(1 << 31))).alias("y"), F.count("*").alias("n")]
    teams = held.groupBy("name").agg(*sign).select("name", F.xxhash64("x", "y", "n").alias("team"))
    named = held.join(teams, "name")
    return named.groupBy("tkey", "team").agg(F.first("copies").alias("copies"), F.max("k").alias("k")), named.select("tkey", "name", "team")


def evidence(teams: DataFrame, words: DataFrame) -> DataFrame:
    """``team, term, n_held, seen, inside`` of all pairs whose bound can reach ``CERTAIN``.

    seen: contexts that hold the term, inside: documents that hold both.
    """
    whole = teams.groupBy("team").agg(F.sum("copies").alias("n_held"), F.sum("k").alias("contexts"))
    least = math.log(0.05) / math.log(CERTAIN)
    some = teams.join(whole.where(F.col("contexts") >= least).select("team", "n_held"), "team")
    pairs = some.join(words, "tkey").groupBy("team", "term", "n_held").agg(F.sum(F.least("k", "c")).alias("seen"), F.sum("copies").alias("inside"))
    return pairs.where(F.col("seen") >= least)


def disclosing(rows: DataFrame, texts: DataFrame, spans: DataFrame, terms: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """``tkey, term, ratio`` of the terms that reveal an entity of their text, from counts over all documents."""
    each = entities(spans)
    words = saved(terms.groupBy("tkey", "term").agg(F.count("*").alias("c")), "words")
    held = held_by(texts, each, "name")
    own, _ = _grouped(held)
    classes, class_names = _grouped(held_by(texts, each, "class"))
    pairs = saved(evidence(own, words).withColumn("own", F.lit(True)).unionByName(evidence(classes, words).withColumn("own", F.lit(False))), "evidence")
    listed = F.expr(f"array_distinct(transform(regexp_extract_all(text, {_quoted(_TERM)}, 0), x -> lower(x)))")
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).alias("bucket")
    asked = saved(pairs.select(bucket).distinct(), "asked")
    counts = rows.select(F.explode(listed).alias("term")).select("term", bucket).join(F.broadcast(asked), "bucket", "left_semi")
    counts = counts.groupBy("term").agg(F.count("*").alias("n_term"))  # summed before it is moved
    total = rows.count()
    told = pairs.join(counts, "term").where(F.col("n_held") < total)
    bound = bounded(F.col("seen"), F.greatest(F.col("n_term") - F.col("inside"), F.lit(0)))
    told = told.withColumn("bound", bound).where(F.col("bound") >= CERTAIN)
    ratio = 1 + F.log("bound") / F.log(F.lit(float(total)) / F.col("n_held"))
    told = saved(told.select("team", "term", "own", ratio.alias("ratio")).where(F.col("ratio") >= threshold), "disclosing")
    hits = own.select("tkey", "team").join(told.where("own"), "team")
    rare = held.groupBy("name").agg(F.sum("k").alias("contexts")).where(F.col("contexts") < support)
    rare = each.join(rare.select("name"), "name", "left_semi").select("tkey", F.col("class").alias("name")).distinct()
    rare = class_names.join(rare, ["tkey", "name"], "left_semi").select("tkey", "team").distinct()
    hits = hits.unionByName(rare.join(told.where("not own"), "team"))
    return hits.groupBy("tkey", "term").agg(F.max("ratio").alias("ratio"))


def term_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``tkey, kind, s, e, v``: every place of the disclosing terms; v is what a term becomes.

    A generalised term becomes ``[NUMBER]`` if it has digits, else ``[WORD]``.
    """
    texts = _texts(rows, spans)
    terms = terms_of(texts)
    marked = terms.join(disclosing(rows, texts, spans, terms), ["tkey", "term"])
    general = F.when(F.col("term").rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]")
    return marked.select("tkey", F.lit("term").alias("kind"), "s", "e", F.when(F.col("ratio") >= REMOVE, "").otherwise(general).alias("v"))


def all_spans(rows: DataFrame) -> DataFrame:
    """``tkey, spans``: all spans ``(kind, s, e, v)`` of each text that has some; kinds as listed, terms last."""
    base = base_spans(rows)
    both = base.drop("near").unionByName(term_spans(rows, base))
    rank = F.expr(_kinds().replace(" end", " else 9 end"))
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "s", "e", "kind", "v")))
    return both.groupBy("tkey").agg(listed.alias("spans"))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    Null and empty texts have none: counts 0, the digest of the empty string, no spans.
    Repeated rows have a row each; columns other than doc_id and text are ignored.
    """
    rows = keyed(docs)
    spans = all_spans(rows)
    some = rows.where(_may()).select("doc_id", "tkey").join(spans, "tkey", "left").select("doc_id", F.coalesce("spans", F.expr("array()")).alias("spans"))
    none = F.expr("cast(array() as array<struct<rank: int, s: int, e: int, kind: string, v: string>>)")
    every = some.unionByName(rows.where(~_may()).select("doc_id", none.alias("spans")))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    text = lambda x: f"array_join(transform({x}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    base = F.sha2(F.expr(text("filter(spans, x -> x.kind <> 'term')")), 256)
    return every.select("doc_id", *counts, base.alias("base_sha256"), F.expr(text("spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` of the new text.

    Texts without entities pass as they are, null texts too, and no row is dropped; only
    texts that a cheap test doesn't clear are shuffled. Overlapping spans are replaced by
    the first one's label. All columns keep their order.
    """
    key, marks = unused(docs, "_key"), unused(docs, "_marks")
    spans = all_spans(keyed(docs))
    label = "case x.kind when 'term' then x.v else concat('[', upper(x.kind), ']') end"
    each = spans.select("tkey", F.explode("spans").alias("x")).select("tkey", "x.s", "x.e", "x.kind", F.expr(label).alias("label"))
    before = Window.partitionBy("tkey").orderBy("s", "e", "kind").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("w", F.coalesce(F.max("e").over(before), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("s", "e", "w", "label"))).alias(marks)
    each = each.groupBy(F.col("tkey").alias(key)).agg(listed)
    some = docs.where(_may()).withColumn(key, F.md5("text")).join(each, key, "left")
    made = _pieced(f"`{marks}`", "if(x.s >= x.w, x.label, '')")
    some = some.withColumn("text", F.when(F.col(marks).isNull(), F.col("text")).otherwise(made))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        some = some.withColumn("n_chars", F.when(F.col(marks).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    quiet = docs.where(~F.coalesce(_may(), F.lit(False)))
    return quiet.select(*columns).unionByName(some.select(*columns))
