"""Tokens as strings and back: joiners, spacers, case markup and features; detokenization with ranges; token lines."""

from __future__ import annotations

import re

from tokenloom.operators.casing import case_marks, read_mark, restored
from tokenloom.operators.segmenter import segment
from tokenloom.operators.token import Casing, Token
from tokenloom.options import ESCAPE, FEATURE, SPACER, Options

_ESCAPED = re.compile(ESCAPE + "(.{4})", re.S)


def serialize(tokens: list[Token], o: Options) -> tuple[list[str], list[list[str]] | None]:
    """(strings, features by column or None). The case feature is the last column; the first token says how many others there are."""
    columns = len(tokens[0].features or []) if tokens else 0
    features: list[list[str]] = [[] for _ in range(columns + o.case_feature)]
    out: list[str] = []
    marks = case_marks(tokens, o.soft_case_regions) if o.case_markup else None

    def put(text: str, casing: Casing = Casing.NONE) -> None:
        if text:
            out.append(text)
            if o.case_feature:
                features[-1].append(casing.value)

    for k, t in enumerate(tokens):
        for column, value in zip(features, t.features or [], strict=False):
            column.append(value)
        before = after = ""
        together = not t.preserve
        if o.joiner_annotate:
            before = o.joiner if t.join_left and k else ""
            after = o.joiner if t.join_right and k + 1 < len(tokens) else ""
            together = (together or t.spacer) and not o.joiner_new
        elif o.spacer_annotate:
            apart = not t.join_left and not tokens[k - 1].join_right if k else t.spacer
            before = SPACER if apart else ""
            together = together and not o.spacer_new
        if marks and marks[k][0]:
            out.append(marks[k][0])
        if together or not (before or after):
            put(before + t.surface + after, t.casing)
        else:
            put(before)
            put(t.surface, t.casing)
            put(after)
        if marks and marks[k][1]:
            out.append(marks[k][1])
    return out, features or None


def strip_marks(word: str, o: Options) -> Token:
    """A token from its string: join marks become flags."""
    if o.spacer_annotate:
        spaced = word.startswith(SPACER)
        return Token(word[len(SPACER) :] if spaced else word, join_left=not spaced)
    right = word.endswith(o.joiner)
    left = word.startswith(o.joiner)
    body = word[: len(word) - len(o.joiner)] if right else word
    return Token(body[len(o.joiner) :] if left else body, join_left=left, join_right=right)


def parse(words: list[str], features: list[list[str]] | None, o: Options) -> tuple[list[Token], list[int]]:
    """(tokens, the place of each in words). Case markup is consumed; a modifier waits for the next token with text."""
    tokens, places = [], []
    region = modifier = Casing.NONE
    for k, word in enumerate(words):
        if not word:
            continue
        if o.case_feature:
            if not features:
                raise RuntimeError("with case_feature, tokens come with their casings as the first feature")
            modifier = Casing.of(features[0][k][:1])
        elif found := read_mark(word):
            kind, casing = found
            if kind == "case_modifier":
                modifier = casing
            else:
                region, modifier = casing if kind == "begin_case_region" else Casing.NONE, Casing.NONE
            continue
        else:
            modifier = modifier if modifier is not Casing.NONE else region
        t = strip_marks(word, o)
        t.casing = modifier
        if features and (rest := [c[k] for c in features[o.case_feature :]]):
            t.features = rest
        if t.surface:
            modifier = Casing.NONE
        tokens.append(t)
        places.append(k)
    return tokens, places


def unescape(text: str) -> str:
    """Characters for their escapes, where those are written as escaped() writes them."""

    def one(found: re.Match) -> str:
        code = found[1]
        if re.fullmatch("[0-9a-f]{4}", code) and code != "0000" and not "d800" <= code <= "dfff":
            return chr(int(code, 16))
        return found[0]

    if ESCAPE not in text:
        return text
    out, at = [], 0
    while (k := text.find(ESCAPE, at)) >= 0 and k + 5 <= len(text):
        made = _ESCAPED.sub(one, text[k : k + 5])
        if len(made) == 1:
            out.append(text[at:k] + made)
            at = k + 5
        else:
            out.append(text[at : k + 1])
            at = k + 1
    return "".join([*out, text[at:]])


def join(tokens: list[Token], o: Options) -> tuple[str, dict[int, tuple[int, int]]]:
    """(text, code-point ranges, ends included, of tokens that show)."""
    parts, ranges, at = [], {}, 0
    for k, t in enumerate(tokens):
        if k and not o.with_separators and not tokens[k - 1].join_right and not t.join_left:
            parts.append(" ")
            at += 1
        text = t.surface
        if not t.is_placeholder():
            text = unescape(restored(text, t.casing, o.lang))
        if text:
            ranges[k] = (at, at + len(text) - 1)
            parts.append(text)
            at += len(text)
    return "".join(parts), ranges


def merged(text: str, ranges: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Neighbouring ranges as one, unless plain segmentation would part them."""
    out: dict[int, tuple[int, int]] = {}
    group: list[int] = []
    plain = Options()
    keys = list(ranges)
    for n, k in enumerate(keys):
        a, b = ranges[k]
        if group:
            before = ranges[keys[n - 1]]
            if before[1] + 1 != a or len(segment(text[before[0] : b + 1], plain)) > 1:
                group = []
        group.append(k)
        begin = ranges[group[0]][0]
        for g in group:
            out[g] = (begin, b)
    return out


class Reader:
    """Texts of token strings: join(parse(words)) without features, in one pass; what a string is (markup, or a surface with its joins) is remembered."""

    MOST = 200_000  # strings

    def __init__(self, o: Options) -> None:
        self.o, self.known = o, {}

    def __getstate__(self) -> dict:
        return {"o": self.o, "known": {}}

    def _make(self, word: str) -> tuple:
        """(surface as it shows, surface, left, right, placeholder), or the kind and casing of markup."""
        if len(self.known) >= self.MOST:
            self.known.clear()
        found = read_mark(word)
        if found:
            made = found
        else:
            t = strip_marks(word, self.o)
            held = t.is_placeholder()
            made = t.surface if held else unescape(t.surface), t.surface, t.join_left, t.join_right, held
        self.known[word] = made
        return made

    def text(self, words: list[str]) -> str:
        known, parts, joined, o = self.known, [], True, self.o
        none = region = modifier = Casing.NONE
        for word in words:
            if not word:
                continue
            made = known.get(word) or self._make(word)
            if len(made) == 2:
                if made[0] == "case_modifier":
                    modifier = made[1]
                else:
                    region, modifier = made[1] if made[0] == "begin_case_region" else none, none
                continue
            shown, surface, left, right, held = made
            if not joined and not left and not o.with_separators:
                parts.append(" ")
            if modifier is none:
                modifier = region
            if modifier is not none:
                if not held:
                    shown = unescape(restored(surface, modifier, o.lang))
                if surface:
                    modifier = none
            parts.append(shown)
            joined = right
        return "".join(parts)


def detokenize(tokens: list[Token], o: Options) -> str:
    return join(tokens, o)[0]


def detokenize_ranges(tokens: list[Token], o: Options, places: list[int] | None = None, *, merge: bool = False, unicode: bool = False) -> tuple[str, dict[int, tuple[int, int]]]:
    """(text, ranges by place), in bytes or code points."""
    text, ranges = join(tokens, o)
    if merge:
        ranges = merged(text, ranges)
    if not unicode:
        at = [0]
        for ch in text:
            at.append(at[-1] + len(ch.encode()))
        ranges = {k: (at[a], at[b + 1] - 1) for k, (a, b) in ranges.items()}
    return text, {places[k] if places else k: r for k, r in ranges.items()}


def write_line(tokens: list[str], features: list[list[str]] | None, delimiter: str = " ") -> str:
    if not features:
        return delimiter.join(tokens)
    return delimiter.join(FEATURE.join([t, *(c[k] for c in features)]) for k, t in enumerate(tokens))


def read_line(line: str, delimiter: str = " ") -> tuple[list[str], list[list[str]] | None]:
    """Tokens and features of a line. Two empty pieces in a row are the delimiter itself as a token; the first token says whether there are features."""
    if delimiter * 2 not in line and line != delimiter and FEATURE not in line:
        return [p for p in line.split(delimiter) if p], None
    tokens: list[str] = []
    pieces, k = line.split(delimiter), 0
    while k < len(pieces):
        if pieces[k]:
            tokens.append(pieces[k])
        elif k + 1 < len(pieces) and not pieces[k + 1]:
            tokens.append(delimiter)
            k += 1
        k += 1
    if not tokens or FEATURE not in tokens[0]:
        return tokens, None
    fields = [[f for f in t.split(FEATURE) if f] for t in tokens]
    width = max(len(f) for f in fields) - 1
    return [f[0] if f else "" for f in fields], [[f[j] for f in fields if j < len(f)] for j in range(1, width + 1)]
