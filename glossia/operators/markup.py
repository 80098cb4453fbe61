"""Markup to a node table: the one parsing helper, and what selects among its rows.

A row has its element's pre-order number, the last number of its subtree, its parent's
number and classes, and for each class that a profile marks the number of the nearest
element above that carries it. So "below", "direct child" and "nearest ancestor with a
class" are comparisons of numbers on one row, and no selector needs a self-join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossia.functions import text

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = ("script", "style")
#: A start tag -> open elements that it ends.
_ENDS = {
    "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
} | dict.fromkeys("address article aside blockquote details div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",))
#: Elements that keep the ones above them open.
_WALLS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}
_COMMON_WALLS = ("body", "button", "table", "td")


@dataclass(frozen=True)
class Selectors:
    """Which elements are pruned, are rows even without a class or a link, and are known to those below them.

    ``marks``: column of ``up`` -> the classes it stands for. ``inner``: column of ``up``, an
    element's tag (as ``<tag>``) or class, and a class of its parent. ``mute``: elements with
    one of these classes frame others, and their own text is not kept. ``rows``: if given, only
    elements with one of these tags (as ``<tag>``) or classes are rows. ``fields``: if given,
    columns that rows have besides ``rec``, ``up`` and ``error``. ``spaced``, ``joined``: if given,
    tags or classes of the elements that have ``text_spaced``, ``text_joined``; others have an empty one.
    """

    prune: tuple[str, ...] = ("o-unbox-panel", "o-symbol-wrap")
    prune_tags: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("li", "a", "chn")
    marks: tuple[tuple[str, tuple[str, ...]], ...] = ()
    inner: tuple[tuple[str, str, str], ...] = ()
    mute: tuple[str, ...] = ()
    rows: tuple[str, ...] | None = None
    fields: tuple[str, ...] | None = None
    spaced: tuple[str, ...] | None = None
    joined: tuple[str, ...] | None = None

    def only(self, rows: tuple[str, ...], fields: tuple[str, ...], marks: tuple[str, ...] = ()) -> Selectors:
        """The same elements, but only some of them as rows, with some columns."""
        named = lambda all_: tuple(x for x in all_ if x[0] in marks)
        return replace(self, rows=rows, fields=fields, marks=named(self.marks), inner=named(self.inner))


#: Class names of entry records. Pages use their own profile.
COLLECTIONS = ("o-phrase-collection", "o-idiom-collection", "o-phrasal-collection")
ENTRY_MARKS = (
    ("panel", ("o-pos-panel",)), ("collection", COLLECTIONS), ("box", ("o-unbox-panel",)), ("detail", ("o-pos-detail",)),
    ("sense", ("o-sense",)), ("sense_head", ("o-sense-head",)), ("child", ("o-idiom", "o-phrasal", "o-relation-item")),
    ("relations", ("o-relations",)), ("relation_head", ("o-relation-head",)), ("relation_pos", ("o-relation-pos",)),
    ("reference", ("o-reference",)), ("ref", ("o-ref",)), ("chunk", ("o-pron-chunk",)), ("pron_set", ("o-pronunciation-set",)),
    ("example_list", ("o-example-list",)), ("shortcut", ("o-shortcut",)), ("title", ("o-shortcut-title",)), ("head_main", ("o-head-main",)),
    ("phons_br", ("phons_br",)), ("phons_n_am", ("phons_n_am",)), ("sensetop", ("sensetop",)), ("li_sense", ("sense",)),
)
ENTRY_PROFILE = Selectors(
    marks=ENTRY_MARKS,
    inner=(("sense_list", "o-example-list", "o-sense"), ("item", "<li>", "o-example-list")),
    mute=("o-pos-panel", "o-pos-detail", "o-sense", "o-sense-define", "o-example-list", "o-multiple-sense", "o-relations", "o-relation-item"),
)
PAGE_PROFILE = Selectors(prune=("ad",), prune_tags=("nav", "footer", "script", "style"), tags=("a", "h1", "p"))


#: Tags in the form that nearly all have. A record with any other goes to the tolerant parser.
_TAG = re.compile(r"<([^<>]*)>")
_PLAIN = re.compile(r'([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*="[^"]*")*)[ \t\n\r\f]*/?|/([a-z][a-z0-9]*)')
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
#: So many different tags are remembered by a task.
_KNOWN = 4096


class _Events(HTMLParser):
    """What the tolerant parser finds: pairs of a text (or nothing) and the tag after it (or nothing)."""

    def __init__(self, builder: _Builder):
        super().__init__(convert_charrefs=True)
        self.builder, self.found = builder, []

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines and columns

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append(("", self.builder.kind(tag, {k: v or "" for k, v in reversed(attrs)})))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.found.append(("", tag))

    def handle_data(self, data: str) -> None:
        self.found.append((data, None))


class _Builder:
    """Rows of one record after the other. An end tag is its name, a start tag a tuple (``kind``)."""

    def __init__(self, spec: Selectors):
        self.spec = spec
        self.up_names = [name for name, *_ in (*spec.marks, *spec.inner)]
        self.marked: dict[str, list[int]] = {}
        for i, (_, classes) in enumerate(spec.marks):
            for c in classes:
                self.marked.setdefault(c, []).append(i)
        self.inner: dict[str, list[tuple[int, str]]] = {}
        for i, (_, own, parent) in enumerate(spec.inner, len(spec.marks)):
            self.inner.setdefault(own, []).append((i, parent))
        self.mute, self.prune, self.tags = frozenset(spec.mute), frozenset(spec.prune), frozenset(spec.tags)
        self.wanted = None if spec.rows is None else frozenset(spec.rows)
        every = spec.fields is None
        self.spaced = None if spec.spaced is None else frozenset(spec.spaced), every or "text_spaced" in spec.fields
        self.joined = None if spec.joined is None else frozenset(spec.joined), every or "text_joined" in spec.fields
        self.known: dict[str, tuple | str] = {}

    def kind(self, tag: str, attrs: dict) -> tuple:
        """What a start tag says, apart from where it stands."""
        classes = tuple(attrs.get("class", "").split())
        href = attrs.get("href")
        pruned = tag in self.spec.prune_tags or not self.prune.isdisjoint(classes)
        silent, example = tag in _SILENT, tag == "a" and (href or "").lower().startswith(text.EXAMPLE_AUDIO)
        named = (f"<{tag}>", *classes)
        row = bool(classes) or tag in self.tags or href is not None if self.wanted is None else not self.wanted.isdisjoint(named)
        says = lambda names, asked: asked and (names is None or not names.isdisjoint(named))
        speaks = (says(*self.spaced), says(*self.joined)) if self.mute.isdisjoint(classes) else (False, False)
        return (
            _ENDS.get(tag), tag, classes, tuple(i for c in classes for i in self.marked.get(c, ())), tuple(x for n in named for x in self.inner.get(n, ())),
            (pruned, silent, example) if pruned or silent or example else None, row, tag in _VOID, speaks if True in speaks else None, href, attrs.get("data-pronunciation-for"),
        )

    def _learn(self, raw: str) -> tuple | str:
        """The tag between two brackets; an error if it isn't plain."""
        plain = _PLAIN.fullmatch(raw)
        if not plain or plain[1] in _SILENT:
            raise LookupError
        if plain[3]:
            found = plain[3]
        else:
            found = self.kind(plain[1], {k: unescape(v) for k, v in reversed(_ATTRIBUTE.findall(plain[2]))})
        if len(self.known) < _KNOWN and "href=" not in raw:
            self.known[raw] = found
        return found

    def _events(self, content: str) -> Iterable[tuple]:
        parts = _TAG.split(content)
        if content.count("<") == len(parts) // 2:
            known, learn = self.known.get, self._learn
            try:
                tags = [known(raw) or learn(raw) for raw in parts[1::2]]
                texts = [unescape(t) for t in parts[::2]] if "&" in content else parts[::2]
                return zip(texts, [*tags, None], strict=True)
            except LookupError:
                pass
        odd = _Events(self)
        odd.feed(content)
        odd.close()
        return odd.found

    def rows(self, content: str) -> list[tuple]:
        """Fields in the order of ``_FIELDS``, then those of ``up``."""
        found: list[list] = []
        texts: list[str] = []
        hidden: list[int] = []  # numbers of texts that belong to example audio
        names: list[str] = []  # tags of the open elements
        open_: list[tuple] = [(-1, (), [None] * len(self.up_names), None, None)]  # number, classes, what those below know, effect, row; at first what is above all
        count = pruned = silent = example = 0
        for data, tag in (*self._events(content), ("", "")):
            if data and not pruned and not silent:
                if example:
                    hidden.append(len(texts))
                texts.append(data)
            if tag is None:
                continue
            ends_at = len(names)  # from here on open elements end
            if tag.__class__ is str:
                if names and names[-1] == tag:
                    ends_at -= 1
                elif tag in names:
                    while names[ends_at := ends_at - 1] != tag:
                        pass
                elif not tag:
                    ends_at = 0
            elif tag[0]:
                ends = tag[0]
                if ends[0] in names or len(ends) > 1:
                    walls = _WALLS.get(tag[1], _COMMON_WALLS)
                    for at in range(len(names) - 1, -1, -1):
                        if names[at] in ends:
                            ends_at = at
                            break
                        if names[at] in walls:
                            break
            while len(names) > ends_at:
                names.pop()
                _, _, _, effect, row = open_.pop()
                if row is not None:
                    row[1], row[-1] = count - 1, len(texts)
                if effect:
                    pruned, silent, example = pruned - effect[0], silent - effect[1], example - effect[2]
            if tag.__class__ is str:
                continue
            _, name, classes, own, inner, effect, wanted, void, speaks, href, sounds = tag
            above, above_classes, below, _, _ = open_[-1]
            row = None
            if effect:
                pruned, silent, example = pruned + effect[0], silent + effect[1], example + effect[2]
            if wanted:
                at = len(texts)
                row = [count, count, above, len(names), name, classes, above_classes, href, sounds, pruned > 0, below, speaks, at, at]
                found.append(row)
            if own or inner:
                below = below.copy()
                for i in own:
                    below[i] = count
                for i, parent in inner:
                    if parent in above_classes:
                        below[i] = count
            if not void:
                names.append(name)
                open_.append((count, classes, below, effect, row))
            elif effect:
                pruned, silent, example = pruned - effect[0], silent - effect[1], example - effect[2]
            count += 1
        return [self._said(row, texts, hidden) for row in found]

    def _said(self, row: list, texts: list[str], hidden: list[int]) -> tuple:
        *fields, up, speaks, start, end = row
        if speaks is None or start == end:
            return (*fields, "", "", *up)
        own, spaced, joined = texts[start:end], "", ""
        if speaks[0]:
            spaced = own[0].strip() if end - start == 1 else " ".join([s for t in own if (s := t.strip())])
        if speaks[1]:
            if hidden and any(start <= i < end for i in hidden):
                own = [t for i, t in enumerate(own, start) if i not in hidden]
            joined = "".join(own)
        return (*fields, spaced, joined, *up)


_FIELDS = (
    ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("classes", pa.list_(pa.string())), ("parent_classes", pa.list_(pa.string())), ("href", pa.string()), ("sounds_for", pa.string()),
    ("pruned", pa.bool_()), ("text_spaced", pa.string()), ("text_joined", pa.string()),
)
_TYPES = {
    "pre": "int", "last": "int", "parent": "int", "depth": "int", "tag": "string", "classes": "array<string>", "parent_classes": "array<string>",
    "href": "string", "sounds_for": "string", "pruned": "boolean", "text_spaced": "string", "text_joined": "string",
}


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """An Arrow array; of tags and classes, which repeat, each different value is converted once."""
    if kind != pa.list_(pa.string()):
        return pa.array(values, kind)
    numbers: dict = {}
    at = [numbers.setdefault(v, len(numbers)) for v in values]
    return pa.array(list(numbers), kind).take(pa.array(at, pa.int32()))


def markup_nodes(records: DataFrame, spec: Selectors = ENTRY_PROFILE, rec: str = "record_number", content: str = "content") -> DataFrame:
    """One row per element that carries a class or link or has a listed tag.

    Comments and pruned subtrees give no text; pruned elements are still rows, as some
    counts and links are taken before pruning. A record whose parse fails has one row
    with ``error``. Null content has no rows.
    """
    marks = [name for name, *_ in (*spec.marks, *spec.inner)] or ["none"]
    fields = [(i, name, kind) for i, (name, kind) in enumerate(_FIELDS) if spec.fields is None or name in spec.fields]
    names = ["rec", *[name for _, name, _ in fields], "up", "error"]

    def table(recs: list, rows: list, bad: list) -> pa.RecordBatch:
        blank = (None,) * (len(_FIELDS) + len(spec.marks) + len(spec.inner))
        columns = list(zip(*rows, *[blank] * len(bad), strict=True))
        up = [pa.array(c, pa.int32()) for c in columns[len(_FIELDS) :]] or [pa.nulls(len(rows) + len(bad), pa.int32())]
        arrays = [pa.array(recs + [r for r, _ in bad], pa.int64()), *[_column(columns[i], kind) for i, _, kind in fields]]
        error = pa.array([None] * len(rows) + [e for _, e in bad], pa.string())
        return pa.RecordBatch.from_arrays([*arrays, pa.StructArray.from_arrays(up, marks), error], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs: list = []
        rows: list = []
        bad: list = []
        builder = _Builder(spec)
        for batch in batches:
            for number, html in zip(batch["rec"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if html is None:
                    continue
                try:
                    own = builder.rows(html)
                except (ValueError, AssertionError) as e:
                    bad.append((number, f"not parsed: {e}"))
                    own = []
                rows += own
                recs += [number] * len(own)
                if len(rows) > 20_000:
                    yield table(recs, rows, bad)
                    recs, rows, bad = [], [], []
        if rows or bad:
            yield table(recs, rows, bad)

    up = ", ".join(f"{m}: int" for m in marks)
    schema = ", ".join(["rec long", *[f"{name} {_TYPES[name]}" for _, name, _ in fields], f"up struct<{up}>", "error string"])
    return records.select(F.col(rec).cast("long").alias("rec"), F.col(content).alias("content")).mapInArrow(parse, schema)


def has(*names: str) -> Column:
    """The element carries one of the classes."""
    return reduce(Column.__or__, [F.array_contains("classes", n) for n in names])


def nearest(*marks: str) -> Column:
    """Number of the nearest element above that one of the marks stands for."""
    above = [F.col(f"up.{m}") for m in marks]
    return above[0] if len(above) == 1 else F.greatest(*above)


def own_or_nearest(mark: str, *classes: str) -> Column:
    """The element's own number if it carries one of the classes, else the nearest above."""
    return F.when(has(*classes), F.col("pre")).otherwise(nearest(mark))


def below(*marks: str) -> Column:
    return reduce(Column.__or__, [F.col(f"up.{m}").isNotNull() for m in marks])


def parent_has(*names: str) -> Column:
    """The parent element carries all of the classes."""
    return reduce(Column.__and__, [F.array_contains("parent_classes", n) for n in names])


def prune_sections(nodes: DataFrame) -> DataFrame:
    """Nodes outside the subtrees that the profile prunes."""
    return nodes.where(~F.col("pruned"))


def href(prefix: str | None = None) -> Column:
    """The link of an ``a`` element, if it starts with the prefix."""
    value = F.when(F.col("tag") == "a", F.col("href"))
    return value if prefix is None else F.when(value.startswith(prefix), value)


def page_links(pages: DataFrame) -> DataFrame:
    """``rec, ord, href, display`` of the links of pages; nothing is pruned."""
    nodes = markup_nodes(pages.select(F.col("page_id").alias("record_number"), F.col("html").alias("content")), Selectors(tags=("a",), marks=()))
    return nodes.where(href().isNotNull()).select("rec", F.col("pre").alias("ord"), href().alias("href"), text.clean_text(F.col("text_spaced")).alias("display"))
