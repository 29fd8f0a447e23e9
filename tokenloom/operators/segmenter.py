"""Segmentation in plain Python, for all options: a text is read into lexemes, and flags follow from pairs of neighbours.

A lexeme is a run that one token will hold: word, number, sign, placeholder or separator. Two lexemes are glued if no separator stands between them; JOINS says which of the two carries
the join mark then. The native tier (native.py) computes the same with one regular expression for the options it covers.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from tokenloom.functions.chars import char_case, char_type, characters, scripts
from tokenloom.operators.casing import grown
from tokenloom.operators.token import Casing, Token
from tokenloom.options import CLOSE, ESCAPE, FEATURE, OPEN, SUBSTITUTES, Options

#: which side carries the mark when `right` directly follows `left`
JOINS = {
    ("word", "word"): "left", ("number", "word"): "left", ("placeholder", "word"): "left", ("sign", "word"): "left",
    ("word", "number"): "right", ("number", "number"): "left", ("placeholder", "number"): "left", ("sign", "number"): "left",
    ("word", "placeholder"): "right", ("number", "placeholder"): "right", ("placeholder", "placeholder"): "left", ("sign", "placeholder"): "left",
    **{(left, "sign"): "right" for left in ("word", "number", "placeholder", "sign")},
}


@dataclass
class Lexeme:
    kind: str
    text: str
    glued: bool
    casing: Casing = Casing.NONE
    length: int = 0
    cut: str | None = None  # why it begins here, if within a run
    alphabet: object = None
    marked_left: bool = False  # a joiner of the input stands before or after it
    marked_right: bool = False
    isolated: bool = False


def escaped(ch: str, options: Options) -> str:
    return ch if options.no_substitution else f"{ESCAPE}{ord(ch):04x}"


def shown(ch: str, options: Options) -> str:
    return ch if options.no_substitution else SUBSTITUTES.get(ch, ch)


class _Reader:
    """Lexemes of a text in the modes conservative, aggressive and char."""

    def __init__(self, text: str, options: Options, alphabets: Counter | None) -> None:
        self.o, self.text, self.alphabets = options, characters(text), alphabets
        need = options.segment_alphabet or options.segment_alphabet_change or alphabets is not None
        self.script = scripts(self.text) if need else None
        self.out: list[Lexeme] = []
        self.open: Lexeme | None = None  # the word, number or separator run that goes on
        self.glued = self.pending = False

    def _past_marks(self, i: int) -> int:
        """The next place that is no mark of the character at i."""
        k, text = i + 1, self.text
        while k < len(text) and char_type(text[k]) == "mark":
            if self.o.allow_isolated_marks and (char_type(text[i]) == "separator" or (self.o.segment_alphabet_change and self.script[k] != self.script[i])):
                break
            k += 1
        return k

    def _begin(self, kind: str, text: str, **more) -> Lexeme:
        lexeme = Lexeme(kind, text, self.glued and kind != "separator", marked_left=self.pending, **more)
        self.pending = False
        self.out.append(lexeme)
        self.glued = kind != "separator"
        self.open = lexeme if kind in ("word", "number", "separator") else None
        return lexeme

    def read(self) -> list[Lexeme]:
        o, text, i, n = self.o, self.text, 0, len(self.text)
        while i < n:
            ch = text[i]
            if ch < " " or ch == "﻿":
                i += 1
                continue
            kind, after = char_type(ch), self._past_marks(i)
            if ch == OPEN:
                i = self._placeholder(i)
            elif kind == "separator":
                if after > i + 1:
                    self._begin("sign", escaped(ch, o) + text[i + 1 : after])
                else:
                    self._separator(ch, i)
                i = after
            elif o.support_prior_joiners and ch == o.joiner:
                self._joiner()
                i += 1
            else:
                self._character(i, ch, kind, after)
                i = after
        return self.out

    def _placeholder(self, i: int) -> int:
        text, parts, k = self.text, [OPEN], i + 1
        while k < len(text):
            ch = text[k]
            k += 1
            if ch < " " or ch == "﻿":
                continue
            parts.append(escaped(ch, self.o) if ch != CLOSE and char_type(ch) == "separator" else ch)
            if ch == CLOSE:
                break
        self._begin("placeholder", "".join(parts))
        return k

    def _separator(self, ch: str, i: int) -> None:
        if self.o.with_separators:
            if self.open is not None and self.open.kind == "separator":
                self.open.text += ch
            else:
                self._begin("separator", ch)
            if i + 1 >= len(self.text) or char_type(self.text[i + 1]) != "separator":
                self.open = None
        else:
            self.open = None
        self.glued = False

    def _joiner(self) -> None:
        if self.glued:
            self.out[-1].marked_right = True
            if self.out[-1].kind != "sign":
                self.open, self.glued = None, False
        else:
            self.pending = True

    def _character(self, i: int, ch: str, kind: str, after: int) -> None:
        o = self.o
        letter, number = kind == "letter", kind == "number"
        alphabet: object = "number" if number else self.script[i] if letter and self.script else None
        if self.alphabets is not None:
            self.alphabets["Numeric" if number else alphabet if letter and alphabet else "Other"] += 1
        if o.mode == "conservative":
            inside = self.glued and self.out[-1].kind in ("word", "placeholder")
            dotted = ch in ".," and after < len(self.text) and char_type(self.text[after]) in ("letter", "number")
            if number or ch == "_" or (inside and (ch == "-" or dotted)):
                letter, alphabet = True, "number"
        body = shown(ch, o) + self.text[i + 1 : after]
        size = 1 + after - i - 1
        if letter and o.mode != "char":
            self._word(ch, body, size, alphabet)
        elif number and o.mode != "char":
            if self.open is not None and self.open.kind == "number" and not o.segment_numbers:
                self.open.text += body
            else:
                split = self.open is not None and self.open.kind == "number"
                self._begin("number", body, cut="number" if split else None)
        else:
            self._begin("sign", body, isolated=kind == "mark")

    def _word(self, ch: str, body: str, size: int, alphabet: object) -> None:
        o, run = self.o, self.open
        cut = None
        if run is not None and run.kind == "word":
            casing = grown(run.casing, char_case(ch), run.length)
            if run.alphabet == alphabet and alphabet != "number" and alphabet in o.segment_alphabet:
                cut = "alphabet"
            elif o.segment_alphabet_change and run.alphabet != alphabet:
                cut = "change"
            elif o.segment_case and (casing is Casing.MIXED or (run.casing is Casing.CAPITALIZED and run.length == 1 and alphabet == "number")):
                cut = "case"  # a number or sign goes on with no cased letters, one capital or more
            if cut is None:
                run.text += body
                run.length += size
                run.casing, run.alphabet = casing, alphabet
                return
        elif self.glued and self.out[-1].kind == "placeholder" and o.segment_alphabet_change:
            cut = "change"
        self._begin("word", body, casing=grown(Casing.NONE, char_case(ch), 0), length=size, cut=cut, alphabet=alphabet)


def _flags(lexemes: list[Lexeme], o: Options) -> list[Token]:
    tokens = [Token(x.text, casing=x.casing, join_left=x.marked_left, join_right=x.marked_right, preserve=x.kind == "placeholder" and o.preserve_placeholders and x.text.endswith(CLOSE)) for x in lexemes]
    for k in range(1, len(lexemes)):
        left, right = lexemes[k - 1], lexemes[k]
        if not right.glued:
            continue
        if JOINS[left.kind, right.kind] == "left":
            tokens[k - 1].join_right = True
        else:
            tokens[k].join_left = True
        if o.preserve_segmented_tokens:
            if right.cut:
                tokens[k - 1].preserve = True
            elif right.isolated:
                tokens[k].preserve = True
    return tokens


def _unsegmented(text: str, o: Options) -> list[Token]:
    """Modes space and none: separators (space) and placeholders are the only borders."""
    chars, tokens, now = characters(text), [], Token()
    feature: list[str] | None = None
    inside = False

    def finish() -> None:
        nonlocal now
        if now.surface:
            tokens.append(now)
            now = Token()

    def end_feature() -> None:
        nonlocal feature
        if feature:
            now.features = [*(now.features or []), "".join(feature)]
        feature = None

    for i, ch in enumerate(chars):
        gap = char_type(ch) == "separator"
        if inside:
            now.surface += escaped(ch, o) if gap else ch
            if ch == CLOSE:
                now.join_right = i + 1 < len(chars) and char_type(chars[i + 1]) != "separator"
                now.preserve = now.preserve or o.preserve_placeholders or o.preserve_segmented_tokens
                finish()
                inside = False
        elif o.support_prior_joiners and ch == o.joiner:
            if now.surface:
                now.join_right = True
                finish()
            elif i and char_type(chars[i - 1]) == "separator":
                now.join_left = True
            elif tokens:
                tokens[-1].join_right = True
        elif ch == OPEN:
            if now.surface:
                now.join_right = now.join_right or char_type(chars[i - 1]) != "separator"
                now.preserve = now.preserve or o.preserve_segmented_tokens
                finish()
            now.surface, inside = ch, True
        elif o.mode == "space" and ch == FEATURE:
            end_feature()
            feature = []
        elif o.mode == "space" and gap:
            end_feature()
            finish()
        elif feature is not None:
            feature.append(ch)
        else:
            now.surface += shown(ch, o)
    end_feature()
    finish()
    return tokens


def segment(text: str, options: Options, alphabets: Counter | None = None) -> list[Token]:
    """Tokens of a text, before case and subwords. alphabets: counts the script of every character, in the modes that look at characters."""
    if not text:
        return []
    if options.mode in ("space", "none"):
        return _unsegmented(text, options)
    return _flags(_Reader(text, options, alphabets).read(), options)
