"""Case: what a token's casing is, lowering and restoring it, and case markup tokens."""

from __future__ import annotations

import re
import unicodedata

from tokenloom.functions.chars import char_case, char_type, is_placeholder, simple_lower, simple_upper
from tokenloom.operators.token import Casing, Token, TokenType

MARK = re.compile("｟mrk_(case_modifier|begin_case_region|end_case_region)_(.)｠", re.S)
N, L, U, M, C = Casing.NONE, Casing.LOWERCASE, Casing.UPPERCASE, Casing.MIXED, Casing.CAPITALIZED


def grown(casing: Casing, case: str, at: int) -> Casing:
    """The casing of a run of casing `casing` after one more character of this case, its at-th."""
    if casing is M:
        return M
    if casing is N:
        if at:
            return N if case == "none" else M
        return {"lower": L, "upper": C}.get(case, N)
    if casing is C and at == 1:
        return {"lower": C, "upper": U}.get(case, C)
    wanted = "upper" if casing is U else "lower"
    return casing if case == wanted else M


def casing_of(text: str) -> Casing:
    out, at = N, 0
    for ch in text:
        if char_type(ch) == "letter":
            out, at = grown(out, char_case(ch), at), at + 1
    return out


def _greek_upper(text: str) -> str:
    """Capitals without accents; a vowel's lost accent shows as a dialytika on the iota or upsilon after it; a lone eta keeps its accent."""
    out: list[str] = []
    units = re.findall(r"[^̀-ͯ][̀-ͯ]*|[̀-ͯ]+", unicodedata.normalize("NFD", text))
    alone = re.compile(r"\w")
    for k, unit in enumerate(units):
        base, marks = unit[0], unit[1:]
        near = (k and alone.match(units[k - 1])) or (k + 1 < len(units) and alone.match(units[k + 1]))
        if base in "ηΗ" and "́" in marks and not near:
            out.append("Ή")
            continue
        before = units[k - 1] if k else ""
        split = base in "ιυΙΥ" and "́" in before[1:] and before[0] in "αεηοιυωΑΕΗΟΙΥΩ" and not marks
        kept = "̈" if "̈" in marks or split else ""
        rest = "".join(m for m in marks if m not in "̀́͂̈̓̔ͅ")
        out.append(unicodedata.normalize("NFC", base.upper() + kept + rest) + ("Ι" if "ͅ" in marks else ""))
    return "".join(out)


def locale_lower(text: str, lang: str) -> str:
    code = lang.replace("_", "-").split("-")[0].lower()
    if code in ("tr", "az"):
        text = text.replace("İ", "i").replace("İ", "i").replace("I", "ı")
    return text.lower()


def locale_upper(text: str, lang: str) -> str:
    code = lang.replace("_", "-").split("-")[0].lower()
    if code in ("tr", "az"):
        text = text.replace("i", "İ")
    if code == "lt":
        text = re.sub("([ijį])̇", r"\1", text)
    return _greek_upper(text) if code == "el" else text.upper()


def locale_title(text: str, lang: str) -> str:
    code = lang.replace("_", "-").split("-")[0].lower()
    if code == "nl" and re.match("ij", text, re.I):
        return "IJ" + text[2:].lower()
    head = text[:1]
    head = locale_upper(head, lang) if code in ("tr", "az", "lt") else head.title()
    return head + locale_lower(text[1:], lang)


def lowered(text: str, lang: str = "") -> tuple[str, Casing]:
    """(lower-case text, casing before): letters by simple mapping, or everything by the rules of lang."""
    casing = casing_of(text)
    if lang:
        return locale_lower(text, lang), casing
    if casing in (N, L) and not any(char_case(c) == "upper" for c in text):
        return text, casing
    return "".join(simple_lower(c) if char_case(c) == "upper" and char_type(c) == "letter" else c for c in text), casing


def restored(text: str, casing: Casing, lang: str = "") -> str:
    if not text or casing in (L, N):
        return text
    if casing is M:
        raise ValueError("a token of mixed casing has lost its capitals")
    if lang:
        return locale_title(text, lang) if casing is C else locale_upper(text, lang)
    return simple_upper(text[0]) + (text[1:] if casing is C else "".join(map(simple_upper, text[1:])))


def read_mark(text: str) -> tuple[str, Casing] | None:
    """(kind, casing) if text is a case markup token."""
    found = MARK.fullmatch(text)
    return (found[1], Casing.of(found[2])) if found else None


def mark(kind: str, casing: Casing) -> str:
    return f"｟mrk_{kind}_{casing.value}｠"


def case_marks(tokens: list[Token], soft: bool) -> list[tuple[str | None, str | None]]:
    """(markup before, markup after) of each token. A region is a run of tokens shown in capitals: hard ones last for a word and its subwords, soft ones for all that is not lower case between capitals."""
    single = [t.casing is C and len(t) == 1 for t in tokens]
    capital_next, follow = [False] * len(tokens), False
    for k in range(len(tokens) - 1, -1, -1):  # whether capitals come next, past tokens without case
        capital_next[k] = follow
        follow = True if tokens[k].casing is U or single[k] else follow if tokens[k].casing is N else False

    def goes_on(k: int) -> bool:
        t = tokens[k]
        if not soft:
            return t.casing is U and t.type is TokenType.TRAILING_SUBWORD
        if t.casing is U or single[k]:
            return True
        return t.casing is N and not is_placeholder(t.surface) and (capital_next[k] or all(char_type(c) == "number" for c in t.surface))

    out: list[list[str | None]] = [[None, None] for _ in tokens]
    inside = False
    for k, t in enumerate(tokens):
        if inside and not goes_on(k):
            out[k - 1][1] = mark("end_case_region", U)
            inside = False
        if not inside:
            if t.casing is U or (soft and single[k] and capital_next[k]):
                out[k][0], inside = mark("begin_case_region", U), True
            elif t.casing is C:
                out[k][0] = mark("case_modifier", C)
    if inside:
        out[-1][1] = mark("end_case_region", U)
    return [(a, b) for a, b in out]
