"""Scalar text functions as columns; Python only where Unicode folding needs it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the characters that count as white space in the records.
WHITE_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed value: syllable and stress marks of displayed headwords.
MARKS = "·ˈˌ"
#: Link prefixes, the redirect mark, the largest local number and look-up id.
WORD_AUDIO = "sound://audio/word/"
EXAMPLE_AUDIO = "sound://audio/example/"
ENTRY_LINK = "entry://"
REDIRECT = "@@@LINK="
LOCAL_BITS = 10
MAX_LOCAL = 1023
MAX_ID = 2_147_483_647


def clean_text(s: Column) -> Column:
    """Runs of (Unicode) white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, WHITE_SPACE + "+", " "))


def clean_headword(s: Column) -> Column:
    """A headword without syllable and stress marks."""
    return clean_text(F.translate(s, MARKS, ""))


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.str.casefold()


@F.pandas_udf(StringType())
def _normal(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), na_action="ignore")


def _only_wide(s: Column, helper, plain: Column) -> Column:
    """ASCII values stay in the JVM: the helper gets nulls for them."""
    wide = s.rlike(r"[^\x00-\x7F]")
    return F.coalesce(helper(F.when(wide, s)), plain)


def casefold(s: Column) -> Column:
    """Full Unicode case folding."""
    return _only_wide(s, _folded, F.lower(s))


def normalize_headword(s: Column) -> Column:
    """The key of the headword index: NFKC, case folding, single spaces."""
    return _only_wide(s, _normal, clean_text(F.lower(s)))


def clean_label_list(labels: Column) -> Column:
    """Labels without outer punctuation or blanks, the first of each (caseless) kept."""
    strip = lambda x: clean_text(F.regexp_replace(x, r"^[ ,;()\[\]]+|[ ,;()\[\]]+$", ""))
    cleaned = F.filter(F.transform(labels, strip), lambda x: x != "")
    keys = F.transform(cleaned, F.lower)
    return F.filter(cleaned, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def percent_decoded(s: Column) -> Column:
    """Percent-decoding in which ``+`` stays; a value with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def is_safe_media_name(name: Column) -> Column:
    """A plain file name that ends in .mp3, whatever its case."""
    bad = name.contains("/") | name.contains("\\") | name.contains("\x00") | name.isin(".", "..")
    return F.coalesce((name != "") & ~bad & F.lower(name).endswith(".mp3"), F.lit(False))


def media_name(href: Column) -> Column:
    """File name of a word-audio link, decoded; null for other links."""
    return F.when(F.lower(href).startswith(WORD_AUDIO), percent_decoded(F.substr(href, F.lit(len(WORD_AUDIO) + 1))))


def is_safe_reference(name: Column) -> Column:
    """The rule inside records: nothing before the last slash, and .mp3 at the end."""
    return F.coalesce((name != "") & ~name.contains("/") & ~name.isin(".", "..") & F.lower(name).endswith(".mp3"), F.lit(False))


def media_url(dict_id: str, name: Column) -> Column:
    """Path of an audio file, percent-encoded with no safe characters but the unreserved ones."""
    coded = F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"/audio/{dict_id}/"), coded)


def link_target(href: Column) -> Column:
    """Host and path of an entry link, decoded and cleaned; null for other links."""
    found = F.regexp_extract(href, "^" + ENTRY_LINK + "([^?#]*)", 1)
    return F.when(href.startswith(ENTRY_LINK), clean_headword(percent_decoded(found)))


def region_code(geo: Column) -> Column:
    return F.when(geo == "BrE", "UK").when(geo == "NAmE", "US").otherwise("other")


def sense_index(s: Column) -> Column:
    """A sense number without its trailing dots."""
    return F.regexp_replace(clean_text(s), r"\.+$", "")


def phonetic_key(pronunciation: Column) -> Column:
    return F.trim(F.array_join(F.transform(pronunciation, lambda p: p["notation"]), " "))


def anchor(field: str, position: Column) -> Column:
    """Place of a child in its entry: the field's name and a zero-based position."""
    return F.concat_ws(".", F.lit(field), position.cast("string"))


def crc32_hex(content: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def pack_entry_id(rec: Column, local: Column) -> Column:
    """Record number and local number in one id; null where either is out of range."""
    whole = F.shiftleft(rec.cast("long"), LOCAL_BITS).bitwiseOR(local.cast("long"))
    return F.when((rec > 0) & local.between(0, MAX_LOCAL), whole)


def unpack_entry_id(entry_id: Column) -> tuple[Column, Column]:
    return F.shiftright(entry_id, LOCAL_BITS), entry_id.bitwiseAND(MAX_LOCAL)


def parse_entry_id(s: Column) -> Column:
    """ASCII digits in 1..2^31-1 as a long, else null."""
    value = s.try_cast("bigint")
    return F.when(s.rlike(r"\A[0-9]+\z") & value.between(1, MAX_ID), value)


def redirect_target(content: Column) -> Column:
    """Target of a redirect record; null for markup."""
    padding = r"^[\x00\r\n ]+|[\x00\r\n ]+$"
    trimmed = F.regexp_replace(content, padding, "")
    rest = F.regexp_replace(F.substr(trimmed, F.lit(len(REDIRECT) + 1)), padding, "")
    return F.when(trimmed.startswith(REDIRECT), rest)


def is_valid_mp3(content: Column) -> Column:
    """An ID3 tag, or the sync bits of an MPEG audio frame."""
    byte = lambda i: F.conv(F.hex(F.substr(content, F.lit(i), F.lit(1))), 16, 10).cast("int")
    sync = (F.octet_length(content) >= 2) & (byte(1) == 255) & (byte(2).bitwiseAND(224) == 224)
    return F.coalesce(F.hex(F.substr(content, F.lit(1), F.lit(3))) == "494433", F.lit(False)) | F.coalesce(sync, F.lit(False))
