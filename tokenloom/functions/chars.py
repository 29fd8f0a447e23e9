"""Character facts for the Python tier: category, case, simple case mapping, script. Answers are remembered per character, of which a text has few different ones."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Unicode script names in the order of their standard codes, for ties between script extensions
SCRIPTS = """Arabic Armenian Bengali Bopomofo Cherokee Coptic Cyrillic Deseret Devanagari Ethiopic Georgian Gothic Greek Gujarati Gurmukhi Han Hangul Hebrew Hiragana Kannada Katakana Khmer
Lao Latin Malayalam Mongolian Myanmar Ogham Old_Italic Oriya Runic Sinhala Syriac Tamil Telugu Thaana Thai Tibetan Canadian_Aboriginal Yi Tagalog Hanunoo Buhid Tagbanwa Braille Cypriot
Limbu Linear_B Osmanya Shavian Tai_Le Ugaritic Buginese Glagolitic Kharoshthi Syloti_Nagri New_Tai_Lue Tifinagh Old_Persian Balinese Batak Brahmi Cham Egyptian_Hieroglyphs Pahawh_Hmong
Old_Hungarian Javanese Kayah_Li Lepcha Linear_A Mandaic Meroitic_Hieroglyphs Nko Old_Turkic Old_Permic Phags_Pa Phoenician Miao Vai Cuneiform Carian Tai_Tham Lycian Lydian Ol_Chiki Rejang
Saurashtra SignWriting Sundanese Meetei_Mayek Imperial_Aramaic Avestan Chakma Kaithi Manichaean Inscriptional_Pahlavi Psalter_Pahlavi Inscriptional_Parthian Samaritan Tai_Viet Bamum Lisu
Old_South_Arabian Bassa_Vah Duployan Elbasan Grantha Mende_Kikakui Meroitic_Cursive Old_North_Arabian Nabataean Palmyrene Khudawadi Warang_Citi Mro Nushu Sharada Sora_Sompeng Takri Tangut
Anatolian_Hieroglyphs Khojki Tirhuta Caucasian_Albanian Mahajani Ahom Hatran Modi Multani Pau_Cin_Hau Siddham Adlam Bhaiksuki Marchen Newa Osage Masaram_Gondi Soyombo Zanabazar_Square Dogra
Gunjala_Gondi Makasar Medefaidrin Hanifi_Rohingya Sogdian Old_Sogdian Elymaic Nyiakeng_Puachue_Hmong Nandinagari Wancho Chorasmian Dives_Akuru Khitan_Small_Script Yezidi Cypro_Minoan
Old_Uyghur Tangsa Toto Vithkuqi Kawi Nag_Mundari""".split()
#: names of character blocks that also count as scripts: first and last code point
BLOCK_SCRIPTS = {"Kangxi": (0x2F00, 0x2FD5), "Kanbun": (0x3190, 0x319F)}
_COMMON_FIRST = ["Latin", "Cyrillic", "Han", "Arabic", "Greek", "Hiragana", "Katakana", "Hangul", "Devanagari", "Hebrew", "Thai"]
_PLACEHOLDER = re.compile("｟.+?｠", re.S)


def known_script(name: str) -> bool:
    if name in BLOCK_SCRIPTS or name in SCRIPTS or name in ("Common", "Inherited"):
        return True
    try:
        return bool(name) and regex.compile(rf"\p{{Script={name}}}") is not None
    except regex.error:
        return False


@lru_cache(maxsize=1 << 16)
def char_type(ch: str) -> str:
    """letter, mark, number, separator or other."""
    return {"L": "letter", "M": "mark", "N": "number", "Z": "separator"}.get(unicodedata.category(ch)[0], "other")


@lru_cache(maxsize=1 << 16)
def char_case(ch: str) -> str:
    """upper, lower or none (title-case letters have none)."""
    return {"Lu": "upper", "Ll": "lower"}.get(unicodedata.category(ch), "none")


@lru_cache(maxsize=1 << 16)
def simple_lower(ch: str) -> str:
    if ch == "İ":
        return "i"
    low = ch.lower()
    return low if len(low) == 1 else ch


@lru_cache(maxsize=1 << 16)
def simple_upper(ch: str) -> str:
    for made in (ch.upper(), ch.title()):
        if len(made) == 1:
            return made
    return ch


def _has(prop: str, name: str, ch: str) -> bool:
    return regex.match(rf"\p{{{prop}={name}}}", ch) is not None


@lru_cache(maxsize=1 << 16)
def own_script(ch: str) -> tuple[str, tuple[str, ...]]:
    """(script, script extensions in code order)."""
    code = ord(ch)
    for name, (first, last) in BLOCK_SCRIPTS.items():
        if first <= code <= last:
            return name, (name,)
    if _has("Script", "Inherited", ch):
        return "Inherited", ()
    if _has("Script", "Common", ch):
        return "Common", tuple(s for s in SCRIPTS if _has("scx", s, ch)) or ("Common",)
    for name in _COMMON_FIRST + SCRIPTS:
        if _has("Script", name, ch):
            return name, (name,)
    return "Unknown", ("Unknown",)


def script(ch: str, before: str | None) -> str | None:
    """The script of ch after text in script `before`: what is shared by scripts takes the one before, if it can."""
    name, extensions = own_script(ch)
    if name == "Inherited":
        return before
    if name == "Common":
        return before if before in extensions else extensions[0]
    return name


def scripts(text: str) -> list[str | None]:
    out, before = [], None
    for ch in text:
        found = script(ch, before)
        out.append(found)
        before = found if found is not None else before
    return out


def characters(text: str) -> str:
    """text up to its first NUL, without surrogates."""
    text = text.split("\0", 1)[0]
    return text if text.isascii() else "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)


def is_placeholder(text: str) -> bool:
    return _PLACEHOLDER.search(text) is not None


def char_to_utf8(code: int) -> str:
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def with_marks(text: str, *, protected: str = "") -> list[str]:
    """Characters, each with the combining marks that follow it; none are attached to protected characters."""
    out: list[str] = []
    for ch in characters(text):
        if out and char_type(ch) == "mark" and out[-1][0] not in protected:
            out[-1] += ch
        else:
            out.append(ch)
    return out


def split_text(text: str, separator: str, *, skip_empty: bool = True) -> list[str]:
    parts = text.split(separator)
    if not skip_empty and parts[-1] == "":
        parts.pop()
    return [p for p in parts if p] if skip_empty else parts


def to_hex(value: int, width: int = 0) -> str:
    return f"{value:0{width}x}"


def from_hex(text: str) -> int:
    try:
        return int(text, 16)
    except ValueError:
        return 0
