"""Character and string functions as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.options import SUBSTITUTES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf8_length(text: Column | str) -> Column:
    return F.char_length(_c(text))


def code_point(ch: Column | str) -> Column:
    """Code point of the first character, 0 of an empty text."""
    return F.ascii(_c(ch))


def from_code_point(code: Column | str) -> Column:
    """The character; empty for 0, surrogates and what is no code point."""
    c = _c(code)
    high = (F.floor((c - 0x10000) / 0x400) + 0xD800).cast("long")
    low = (F.pmod(c - 0x10000, F.lit(0x400)) + 0xDC00).cast("long")
    hexed = F.when(c < 0x10000, F.lpad(F.hex(c.cast("long")), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    bad = (c <= 0) | ((c >= 0xD800) & (c < 0xE000)) | (c > 0x10FFFF)
    return F.when(bad, "").otherwise(F.decode(F.unhex(hexed), "UTF-16BE"))


def characters(text: Column | str) -> Column:
    """array<string>: the characters before the first NUL."""
    return F.regexp_extract_all(F.split(_c(text), "\\x00", 2)[0], F.lit("(?s)."), F.lit(0))


def characters_with_marks(text: Column | str) -> Column:
    return F.regexp_extract_all(F.split(_c(text), "\\x00", 2)[0], F.lit("(?s).\\p{M}*"), F.lit(0))


def code_points(text: Column | str) -> Column:
    return F.transform(characters(text), F.ascii)


def split_text(text: Column | str, separator: str) -> Column:
    """Non-empty pieces between literal separators."""
    return F.filter(F.split(_c(text), "\\Q" + separator + "\\E"), lambda x: x != "")


def char_type(ch: Column | str) -> Column:
    c = _c(ch)
    return F.when(c.rlike("^\\p{L}"), "letter").when(c.rlike("^\\p{M}"), "mark").when(c.rlike("^\\p{N}"), "number").when(c.rlike("^\\p{Z}"), "separator").otherwise("other")


def char_case(ch: Column | str) -> Column:
    c = _c(ch)
    return F.when(c.rlike("^\\p{Lu}"), "upper").when(c.rlike("^\\p{Ll}"), "lower").otherwise("none")


def is_placeholder(token: Column | str) -> Column:
    return _c(token).rlike("(?s)｟.+?｠")


def substituted(text: Column | str) -> Column:
    return F.translate(_c(text), "".join(SUBSTITUTES), "".join(SUBSTITUTES.values()))


def to_hex(value: Column | str, width: int = 4) -> Column:
    digits = F.lower(F.hex(_c(value)))
    return F.when(F.char_length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def from_hex(text: Column | str) -> Column:
    return F.coalesce(F.conv(_c(text), 16, 10).cast("long"), F.lit(0).cast("long"))


def script_by_icu(code: Column | str) -> Column:
    """Script name of a code point, by the ICU library that Spark carries."""
    return F.reflect(F.lit("com.ibm.icu.lang.UScript"), F.lit("getName"), F.reflect(F.lit("com.ibm.icu.lang.UScript"), F.lit("getScript"), _c(code).cast("int")).cast("int"))
