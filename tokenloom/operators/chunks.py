"""Texts by their chunks. What stands between two spaces is segmented alike wherever it stands, so a worker cuts each different chunk once and remembers its tokens.

Texts in which a chunk does not stand for itself take the whole way through the segmenter: marks upon spaces, joiners of the input, characters whose script is that of the text before them.
"""

from __future__ import annotations

import re
from collections import Counter

import regex

from tokenloom.functions.chars import char_type, characters, own_script
from tokenloom.operators import annotate
from tokenloom.operators.casing import C, N, U, mark
from tokenloom.operators.segmenter import segment
from tokenloom.operators.token import Token
from tokenloom.options import CLOSE, FEATURE, OPEN, SPACER, Options

REMEMBERED = 200_000  # chunks that a worker keeps
_HELD = re.compile(f"{OPEN}[^{CLOSE}]*{CLOSE}?")
_INSIDE = "﷐"  # a space within a placeholder; a noncharacter
_UPON = regex.compile(r" [\x00-\x1f﻿]*\p{M}")
_WORD = re.compile("[a-zß-öø-ÿ]+")
#: a soft region in the codes of tokens (U capitals, S one capital, d digits, n other tokens without case, p placeholders): from capitals, or from one before more of them, over what stands between, and over digits
_REGION = re.compile("(?:U|S(?=[ndp]*[US]))(?:[nd]*[US])*(?:[nd]+(?=p[ndp]*[US])|d*)")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_KINDS = ("word", "number", "sign")
_CONTROLS = dict.fromkeys([*range(1, 32), 0xFEFF])
_worker: dict = {}


def _casing(text: str) -> str:
    """casing_of() of letters of _L, as a code."""
    letters = text if text.isalpha() else "".join(filter(str.isalpha, text))
    if not letters or letters.islower():
        return "L" if letters else "N"
    if letters.isupper():
        return "U" if len(letters) > 1 else "C"
    return "C" if letters[0].isupper() and letters[1:].islower() else "M"


class _Simple:
    """Lexemes of chunks of letters A to ÿ, digits and ASCII signs, by regular expressions: (kind, text, whether it was cut off what stands before it)."""

    fit = re.compile(f"[\\x01-\\x1f!-~{_L}]*")

    def __init__(self, o: Options) -> None:
        if o.mode == "conservative":
            unit = f"([{_L}0-9_](?:[{_L}0-9_-]|[.,](?=[{_L}0-9]))*)|(?!)()|(.)"
        else:
            unit = f"([{_L}]+)|([0-9]{'' if o.segment_numbers else '+'})|(.)" if o.mode == "aggressive" else "(?!)()|(?!)()|(.)"
        self.units, self.conservative = re.compile(unit), o.mode == "conservative"
        self.cuts = [re.compile(p) for on, p in (
            ("Latin" in o.segment_alphabet, f"(?:[^{_L}]+[{_L}]?|[{_L}])[^{_L}]*(?:(?<=[^{_L}])[{_L}][^{_L}]*)*"), (o.segment_alphabet_change, f"[{_L}]+|[^{_L}]+"),
            (o.segment_case, f"[A-ZÀ-ÖØ-Þ]{{2,}}|[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]*|[a-zß-öø-ÿ]+|[^{_L}]+"),
        ) if on]
        self.stopped = re.compile("[.,][\x01-\x1f]")

    def __call__(self, chunk: str) -> list[tuple[str, str, bool]] | None:
        if not self.fit.fullmatch(chunk) or (self.conservative and self.stopped.search(chunk)):
            return None
        out: list[tuple[str, str, bool]] = []
        for m in self.units.finditer(chunk if chunk.isprintable() else chunk.translate(_CONTROLS)):
            kind, parts = _KINDS[m.lastindex - 1], [m[0]]
            if kind == "word":
                for cut in self.cuts:
                    parts = [x for p in parts for x in cut.findall(p)]
            out.append((kind, parts[0], kind == "number" and bool(out) and out[-1][0] == "number"))
            out += [("word", x, True) for x in parts[1:]]
        return out


def _code(t: Token) -> str:
    if t.casing is U:
        return "U"
    if t.casing is C:
        return "S" if len(t) == 1 else "C"
    if t.casing is not N:
        return "l"
    return "p" if t.is_placeholder() else "d" if all(char_type(c) == "number" for c in t.surface) else "n"


class Chunks:
    """Tokens, lines and scripts of texts by a loom without random draws. A loom without an encoder shares what it knows with all of its kind in the process."""

    def __init__(self, loom) -> None:
        self.loom, o = loom, loom.options
        self.o = o
        self.scripts = bool(o.segment_alphabet or o.segment_alphabet_change)
        self.words = o.mode in ("conservative", "aggressive") and not o.segment_alphabet and loom.encoder is None
        self.letters = o.mode != "char" and "Latin" in o.segment_alphabet and o.joiner_annotate and loom.encoder is None and not (o.joiner_new or o.preserve_segmented_tokens or o.case_feature)
        self.soft = o.case_markup and o.soft_case_regions
        self.bare = o.with_(case_markup=False, soft_case_regions=False) if self.soft else o
        plain = loom.encoder is None and not (o.joiner_new or o.spacer_new) and o.lang.replace("_", "-").split("-")[0].lower() not in ("tr", "az")
        self.simple = _Simple(o) if plain else None
        self.known = _worker.setdefault(o, {}) if loom.encoder is None else {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = _worker.setdefault(self.o, {}) if self.loom.encoder is None else {}

    @staticmethod
    def fit(o: Options) -> bool:
        """Whether texts of these options have chunks."""
        soft = o.case_markup and o.soft_case_regions
        return o.mode in ("conservative", "aggressive", "char") and not o.with_separators and not (soft and (o.joiner_new or o.spacer_new or o.preserve_placeholders or o.preserve_segmented_tokens))

    def split(self, text: str) -> list[str] | None:
        """Chunks of a text, or None where they don't stand for themselves. Spaces within placeholders are INSIDE."""
        text = text.split("\0", 1)[0]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = characters(text)
            if _INSIDE in text or _UPON.search(text) or (self.o.support_prior_joiners and self.o.joiner in text):
                return None
            if OPEN in text:
                text = _HELD.sub(lambda m: m[0].replace(" ", _INSIDE), text)
        else:
            if self.o.support_prior_joiners and self.o.joiner in text:
                return None
        return text.split(" ")

    def _contextual(self, chunk: str) -> bool:
        """Whether scripts in a chunk follow from the text before it."""
        return not chunk.isascii() and any(char_type(c) in ("letter", "mark") and own_script(c)[0] in ("Common", "Inherited") for c in chunk)

    def _remember(self, kind: str, chunk: str, made):
        known = self.known.setdefault(kind, {})
        if len(known) >= REMEMBERED:
            known.clear()
        known[chunk] = made
        return made

    def tokens(self, chunk: str) -> list[Token] | None:
        if self.scripts and self._contextual(chunk):
            return None
        return self.loom.tokens(chunk.replace(_INSIDE, " "), False)

    def _made(self, kind: str, chunk: str):
        """Token strings of a chunk that is the first of a text ("first") or not ("later"), or (codes, strings) for soft regions; () where it is contextual."""
        later = kind.endswith("later")
        if self.words and _WORD.fullmatch(chunk):
            chunk_line = chunk + f"{FEATURE}L" if kind.startswith("line") else chunk
            words = [SPACER + chunk_line if later and self.o.spacer_annotate and not self.o.spacer_new else chunk_line]
            if not (later and self.o.spacer_new):
                return self._remember(kind, chunk, ("l", words) if self.soft else words)
        if self.letters and _WORD.fullmatch(chunk):
            return self._remember(kind, chunk, [*(c + self.o.joiner for c in chunk[:-1]), chunk[-1]])
        lexemes = self.simple and self.simple(chunk)
        if lexemes is not None:
            return self._remember(kind, chunk, self._direct(lexemes, later, kind.startswith("line")))
        tokens = self.tokens(chunk)
        if tokens is None:
            return self._remember(kind, chunk, ())
        if later:
            strings, features = annotate.serialize([Token("x"), *tokens], self.bare)
            strings, features = strings[1:], features and [f[1:] for f in features]
        else:
            strings, features = annotate.serialize(tokens, self.bare)
        if self.soft:
            return self._remember(kind, chunk, ("".join(map(_code, tokens)), strings) if len(strings) == len(tokens) else ())
        if kind.startswith("line"):
            return self._remember(kind, chunk, [annotate.write_line([s], features and [[f[k]] for f in features]) for k, s in enumerate(strings)])
        return self._remember(kind, chunk, strings)

    def _direct(self, lexemes: list[tuple[str, str, bool]], later: bool, line: bool):
        """What serialize() makes of simple lexemes."""
        o, n, out, codes = self.o, len(lexemes), [], []
        cased = o.case_markup or o.case_feature
        right = False
        for k, (kind, text, _) in enumerate(lexemes):
            left = k > 0 and not right
            following = lexemes[k + 1] if k + 1 < n else None
            right = following is not None and not (following[0] == "sign" or (following[0] == "number" and kind == "word"))
            before = after = ""
            if o.joiner_annotate:
                before, after = o.joiner if left else "", o.joiner if right else ""
            elif o.spacer_annotate and k == 0 and later:
                before = SPACER
            code = _casing(text) if cased else ""
            text = text.lower() if cased else text
            if self.soft:
                codes.append("l" if code in "LM" else code if code == "U" else "S" if code == "C" and len(text) == 1 else code if code == "C" else "d" if text.isdigit() else "n")
            hard = o.case_markup and not self.soft
            if hard and code in "UC":
                out.append(mark("begin_case_region", U) if code == "U" else mark("case_modifier", C))
            parts = [before + text + after]
            if (before or after) and o.preserve_segmented_tokens and following is not None and following[2]:
                parts = [p for p in (before, text, after) if p]
            if line:
                parts = [p + FEATURE + (code if p == text or len(parts) == 1 else "N") for p in parts]
            out += parts
            if hard and code == "U":
                out.append(mark("end_case_region", U))
        return ("".join(codes), out) if self.soft else out

    def _by_chunks(self, text: str, line: bool) -> list[str] | None:
        chunks = self.split(text)
        if chunks is None:
            return None
        prefix = "line " if line and self.o.case_feature else ""
        kind = prefix + ("later" if self.o.spacer_annotate else "any")
        known, make, out, codes = self.known.setdefault(kind, {}), self._made, [], []
        if self.o.spacer_annotate:  # the first token of a text has no spacer
            at = 0
            while at < len(chunks) and not out:
                made = make(prefix + "first", chunks[at])
                if made == ():
                    return None
                if self.soft:
                    codes.append(made[0])
                    made = made[1]
                out += made
                at += 1
            chunks = chunks[at:]
        if self.soft:
            for c in chunks:
                made = known.get(c)
                if made is None:
                    made = make(kind, c)
                if not made:
                    return None
                codes.append(made[0])
                out += made[1]
            return self._marked("".join(codes), out)
        for c in chunks:
            made = known.get(c)
            if made is None:
                made = make(kind, c)
            if made == ():
                return None
            out += made
        return out

    @staticmethod
    def _marked(codes: str, strings: list[str]) -> list[str]:
        """Strings with the markup of soft regions and of single capitals."""
        out, at = [], 0

        def plain(a: int, b: int) -> None:
            for m in re.finditer("[CS]", codes[a:b]):
                k = a + m.start()
                out.extend(strings[plain.at : k])
                out.append(mark("case_modifier", C))
                plain.at = k
            out.extend(strings[plain.at : b])

        for m in _REGION.finditer(codes):
            plain.at = at
            plain(at, m.start())
            out.append(mark("begin_case_region", U))
            out.extend(strings[m.start() : m.end()])
            out.append(mark("end_case_region", U))
            at = m.end()
        plain.at = at
        plain(at, len(codes))
        return out

    def strings(self, text: str) -> list[str]:
        made = self._by_chunks(text, False)
        return self.loom(text, False) if made is None else made

    def line(self, text: str, delimiter: str = " ") -> tuple[str, int]:
        """(token line, number of tokens)."""
        if not self.soft and not self.o.spacer_annotate and (chunks := self.split(text)) is not None:
            kind, prefix = f"joined {delimiter}", "line any" if self.o.case_feature else "any"
            known, lines, n = self.known.setdefault(kind, {}), [], 0
            for c in chunks:
                made = known.get(c)
                if made is None:
                    parts = self.known.get(prefix, {}).get(c)
                    parts = self._made(prefix, c) if parts is None else parts
                    made = self._remember(kind, c, () if parts == () else (delimiter.join(parts), len(parts)))
                if not made:
                    break
                if made[1]:
                    lines.append(made[0])
                    n += made[1]
            else:
                return delimiter.join(lines), n
        made = self._by_chunks(text, True)
        if made is None:
            strings, features = self.loom.tokenize(text, training=False)
            return annotate.write_line(strings, features, delimiter), len(strings)
        return delimiter.join(made), len(made)

    def flags(self, text: str) -> tuple[list[str], list[bool], list[bool]] | None:
        """Surfaces and join flags of a text's tokens, or None where its chunks don't stand for themselves."""
        if (chunks := self.split(text)) is None:
            return None
        known, out = self.known.setdefault("flags", {}), ([], [], [])
        for c in chunks:
            made = known.get(c)
            if made is None:
                tokens = self.tokens(c)
                made = self._remember("flags", c, () if tokens is None else ([t.surface for t in tokens], [t.join_left for t in tokens], [t.join_right for t in tokens]))
            if not made:
                return None
            for column, values in zip(out, made, strict=True):
                column += values
        return out

    def alphabets(self, text: str) -> dict[str, int]:
        chunks = self.split(text)
        if chunks is None:
            return self.loom.alphabets(text)
        found: dict[str, int] = {}
        known = self.known.setdefault("alphabets", {})
        for c in chunks:
            made = known.get(c)
            if made is None:
                counted: Counter = Counter()
                contextual = self._contextual(c)
                if not contextual:
                    segment(c.replace(_INSIDE, " "), self.o, counted)
                made = self._remember("alphabets", c, None if contextual else list(counted.items()))
            if made is None:
                return self.loom.alphabets(text)
            for k, n in made:
                found[k] = found.get(k, 0) + n
        return found
