"""Cleaning and measuring chat text, as column expressions.

Classes of white space are written out, for engines differ in what they count as such: URLs, handles and account
numbers end at one class, collapsing uses another that also holds the separators U+001C to U+001F.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of what is removed, in the order in which it is.
SPACE, NO_SPACE = r"[\s\x0B\x85\p{Z}]", r"[^\s\x0B\x85\p{Z}]"
ANY_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
HANDLE = f"@{NO_SPACE}+"
IBAN = f"[A-Z]{{2}}[0-9]{{2}}(?:{SPACE}?[0-9]{{4}}){{4}}(?:{SPACE}?[0-9]{{1,2}})?"
URL = rf"(?iu)(?:https?://|ftp://|www\.|t\.me/|bit\.ly/|tinyurl\.com/|goo\.gl/|t\.co/){NO_SPACE}+"
#: Ideographs that are letters and numbers at once, as a class of signs: by the rule of the Unicode database.
_IDEOGRAPHS = (*range(0x3400, 0xA000), *range(0xF900, 0xFB00), *range(0x20000, 0x30000))
NUMERAL_LETTERS = "[" + "".join(chr(c) for c in _IDEOGRAPHS if chr(c).isnumeric() and unicodedata.category(chr(c)) == "Lo") + "]"
TOO_SHORT, EMPTY = "Text too short", "Text empty after preprocessing"


def remove_handles(c: Column) -> Column:
    return F.regexp_replace(c, HANDLE, "")


def remove_ibans(c: Column) -> Column:
    return F.regexp_replace(c, IBAN, "")


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def remove_noise(c: Column) -> Column:
    """Handles, then account numbers, then links: the order shows in texts that hold one within another."""
    return remove_urls(remove_ibans(remove_handles(c)))


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one space; ends are not trimmed."""
    return F.regexp_replace(c, ANY_SPACE, " ")


def clean(c: Column) -> Column:
    return collapse_space(remove_noise(c))


def alnum_length(c: Column) -> Column:
    """Letters plus numerals, by code point; what is both counts twice. Whole runs are cut out at once."""
    kept = [F.length(F.regexp_replace(c, k, "")) for k in (r"[^\p{L}]+", r"[^\p{N}]+")]
    both = F.length(F.regexp_replace(c, NUMERAL_LETTERS.replace("[", "[^", 1) + "+", ""))
    # The long class of signs is looked for only where ideographs occur.
    return reduce(Column.__add__, kept) + F.when(c.rlike("[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0002ffff]"), both).otherwise(F.lit(0))


def length_error(length: Column, minimum: int) -> Column:
    """Too short wins over empty wherever both hold; null where neither does."""
    return F.when(length < minimum, TOO_SHORT).when(length == 0, EMPTY)


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, rf"^{ANY_SPACE}|{ANY_SPACE}$", "")


def first_filled(*fields: Column) -> Column:
    """The first of the fields that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in fields])


def transcription_text(segments: Column) -> Column:
    """Segments joined; null for none or only empty ones, else stripped (so speech of white space gives an empty text)."""
    joined = F.array_join(segments, "")
    return F.when(joined != "", strip(joined))
