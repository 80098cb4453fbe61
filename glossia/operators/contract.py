"""The contract of entries: rules by kind of record, compiled for every level of a schema.

A rule names a kind (an entry, a sense, a link ...), a field and what must hold of it.
``violations`` walks the schema, says for each struct which kind it is, and turns the rules
into predicates over columns; below an array a predicate holds for an element, and
``exists`` says whether one breaks it. So a rule is checked wherever its kind stands, and a
level that the schema gets later is checked too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from glossia.schemas import ENTRY

Test = Callable[[Column], Column]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _one_of(*values: str) -> Test:
    return lambda c: ~F.coalesce(c.isin(*values), F.lit(False))


def _absent(c: Column) -> Column:
    return c.isNull()


@dataclass(frozen=True)
class Rule:
    """``broken`` holds of a field's value, or, without a field, of the whole struct."""

    name: str
    field: str | None
    broken: Test


#: What the contract allows.
REGIONS = ("UK", "US", "other")
ENTRY_TYPES = ("word", "phrase")
LINK_KIND = "cross-reference"

_is = lambda s, kind: F.coalesce(s["kind"] == kind, F.lit(False))
RULES: dict[str, tuple[Rule, ...]] = {
    "entry": (
        Rule("entry_id", "entry_id", lambda c: ~F.coalesce(c > 0, F.lit(False))), Rule("blank", "headword", _blank), Rule("blank", "pos", _blank), Rule("blank", "section", _blank),
        Rule("entry_type", "entry_type", _one_of(*ENTRY_TYPES)), Rule("blank", "page", _blank), Rule("blank", "dict_id", _blank),
    ),
    "pronunciation": (Rule("region", "region", _one_of(*REGIONS)), Rule("blank", "notation", _blank)),
    "pair": (Rule("one_sided", None, lambda p: _blank(p["en"]) | _blank(p["zh"])),),
    "labels": (),
    "label": (Rule("blank", None, _blank),),
    "link": (Rule("kind", "kind", _one_of(LINK_KIND)), Rule("blank", "target", _blank), Rule("blank", "display", _blank)),
    "sense": (Rule("kind", "kind", _one_of("sense")),),
    "node": (
        Rule("kind", "kind", _one_of("sense", "group")), Rule("group_title", None, lambda s: _is(s, "group") & s["title"].isNull()),
        Rule("extra", None, lambda s: (_is(s, "sense") & (s["title"].isNotNull() | s["senses"].isNotNull())) | (_is(s, "group") & s["definition"].isNotNull())),
    ),
    "child": (Rule("blank", "headword", _blank),),
}
#: Fields whose value may be null; every other struct or list must be there.
OPTIONAL = {"definition", "title", "senses", "labels", "examples", "cross_references"}
_LABELS = ("grammar", "register", "region", "usage", "construction", "note")


def _kind(above: str, field: str) -> str:
    """What the elements of a field of a kind are."""
    if field in ("title", "definition", "examples"):
        return "pair"
    if field.startswith("child_"):
        return "child"
    if above == "labels":
        return "label"
    return {"pronunciation": "pronunciation", "labels": "labels", "cross_references": "link", "senses": "sense", "sense": "node"}[field]


def _compiled(kind: str, shape: DataType, path: str) -> Iterator[tuple[str, str, Test]]:
    """``path, rule, broken`` for a value of the kind and for all below it."""
    names = set(shape.fieldNames()) if isinstance(shape, StructType) else set()
    for rule in RULES[kind]:
        if rule.field is None:
            yield path, rule.name, rule.broken
        elif rule.field in names:
            yield f"{path}.{rule.field}".lstrip("."), rule.name, lambda s, r=rule: r.broken(s[r.field])
    if not isinstance(shape, StructType):
        return
    for f in shape.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        if not isinstance(inner, StructType) and not (isinstance(f.dataType, ArrayType) and kind == "labels"):
            continue
        at = f"{path}.{f.name}".lstrip(".")
        if f.name not in OPTIONAL:
            yield at, "absent", lambda s, n=f.name: _absent(s[n])
        if isinstance(f.dataType, ArrayType):
            yield f"{at}[]", "absent", lambda s, n=f.name: F.exists(s[n], _absent)
            for where, name, broken in _compiled(_kind(kind, f.name), inner, f"{at}[]"):
                yield where, name, lambda s, n=f.name, b=broken: F.exists(s[n], lambda x: x.isNotNull() & b(x))
        else:
            for where, name, broken in _compiled(_kind(kind, f.name), inner, at):
                yield where, name, lambda s, n=f.name, b=broken: s[n].isNotNull() & b(s[n])


def rules(schema: StructType) -> list[tuple[str, str]]:
    """``path, rule`` of all that is checked of entries with this schema."""
    return [(path, name) for path, name, _ in _compiled("entry", schema, "")]


def violations(entries: DataFrame) -> DataFrame:
    """``entry_id, path, rule``: every rule that an entry breaks, and where; once however often it does.

    ``path``: fields by dots, ``[]`` for an element of a list. Columns that the contract
    doesn't name are reported once for each row as ``extra``.
    """
    known = StructType.fromDDL(ENTRY)
    shape = StructType([f for f in entries.schema.fields if f.name in known.fieldNames()])
    row = F.struct(*shape.fieldNames())
    checks = [(path, name, broken(F.col("_e"))) for path, name, broken in _compiled("entry", shape, "")]
    checks += [(c, "extra", F.lit(True)) for c in entries.columns if c not in known.fieldNames()]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(name).alias("rule"))) for path, name, test in checks]))
    return entries.select(row.alias("_e")).select("_e.entry_id", F.explode(found).alias("f")).select("entry_id", "f.path", "f.rule")
