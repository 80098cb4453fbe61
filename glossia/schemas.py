"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

RECORD = "record_number BIGINT, key STRING, content STRING"
LABELS = (
    "STRUCT<grammar: ARRAY<STRING>, register: ARRAY<STRING>, region: ARRAY<STRING>, "
    "usage: ARRAY<STRING>, construction: ARRAY<STRING>, note: ARRAY<STRING>>"
)
BUCKETS = ("grammar", "register", "region", "usage", "construction", "note")
EN_ZH = "STRUCT<en: STRING, zh: STRING>"
PRON = "STRUCT<region: STRING, notation: STRING, audio_url: STRING>"
XREF = f"STRUCT<kind: STRING, target: STRING, display: STRING, relation: STRING, labels: {LABELS}>"
_SENSE = (
    f"kind: STRING, index: STRING, labels: {LABELS}, definition: {EN_ZH}, "
    f"examples: ARRAY<{EN_ZH}>, cross_references: ARRAY<{XREF}>"
)
SENSE = f"STRUCT<{_SENSE}>"
NODE = f"STRUCT<{_SENSE}, title: {EN_ZH}, senses: ARRAY<{SENSE}>>"
CHILD = f"STRUCT<headword: STRING, pos: STRING, pronunciation: ARRAY<{PRON}>, sense: ARRAY<{NODE}>, cross_references: ARRAY<{XREF}>>"
ENTRY = (
    "dict_id STRING, entry_id BIGINT, headword STRING, page STRING, section STRING, entry_type STRING, pos STRING, "
    f"pronunciation ARRAY<{PRON}>, sense ARRAY<{NODE}>, child_idioms ARRAY<{CHILD}>, "
    f"child_phrasal_verbs ARRAY<{CHILD}>, child_derivatives ARRAY<{CHILD}>, cross_references ARRAY<{XREF}>"
)
INDEX = "headword STRING, headword_normalized STRING, phonetic STRING, entry_type STRING, entry_id BIGINT, anchor STRING"
MEDIA = "name STRING, content BINARY"
