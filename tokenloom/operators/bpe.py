"""Byte-pair encoding of tokens: model files, merging, case-insensitive models, dropout, vocabulary restriction."""

from __future__ import annotations

import random
from collections.abc import Iterable

from tokenloom.functions.chars import char_case, char_type, characters, simple_lower
from tokenloom.operators.subword import SubwordEncoder
from tokenloom.operators.token import Token
from tokenloom.options import ESCAPE, SPACER, Options

NEVER = float("inf")
REMEMBERED = 200_000  # words whose pieces a worker keeps


def initial_pieces(text: str, lowercase: bool = False) -> list[str]:
    """Characters with their marks; an escape of five characters is one piece."""
    out: list[str] = []
    rest = 0
    for ch in text:
        if rest:
            out[-1] += ch
            rest -= 1
        elif ch == ESCAPE:
            out.append(ch)
            rest = 4
        elif out and char_type(ch) == "mark":
            out[-1] += ch
        else:
            out.append(simple_lower(ch) if lowercase and char_case(ch) == "upper" else ch)
    return out


class BPE(SubwordEncoder):
    """A model: ranks of merge results. Any two neighbours whose concatenation is a result may merge, whatever the pair was that the model learned."""

    def __init__(self, model: str | Iterable[str], dropout: float = 0.0, *, options: Options | None = None) -> None:
        if not 0 <= dropout <= 1:
            raise ValueError("bpe_dropout should be between 0.0 and 1.0")
        self.dropout = dropout
        self.options = options or Options(joiner_annotate=True)
        self.vocabulary: frozenset[str] = frozenset()
        self._known: dict[str, list[str]] = {}
        if isinstance(model, str):
            try:
                with open(model, encoding="utf-8", newline="\n") as f:
                    lines = f.read().split("\n")
            except OSError as e:
                raise ValueError(f"Unable to open BPE model {model}") from e
        else:
            lines = list(model)
        self._load(lines)

    def _load(self, lines: list[str]) -> None:
        self.version, self.prefix, self.suffix, self.insensitive = None, False, True, False
        self.begin, self.end = "<w>", "</w>"
        head = lines[0] if lines else ""
        parts = head.split(";")
        if head.startswith("#version:"):
            self.version = head[-3:]
            if self.version not in ("0.1", "0.2"):
                raise RuntimeError("unsupported BPE version")
            lines = lines[1:]
        elif len(parts) == 6 and parts[0] == "v3":
            self.prefix, self.suffix, self.insensitive = (p == "true" for p in parts[1:4])
            self.begin, self.end = parts[4:]
            lines = lines[1:]
        start = next((k for k, line in enumerate(lines) if not line.startswith("#")), len(lines))
        self.rank: dict[str, int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        for line in lines[start:]:
            left, space, right = line.partition(" ")
            if space and right:
                self.rank.setdefault(left + right, len(self.rank))
                self.split.setdefault(left + right, (left, right))

    def set_vocabulary(self, vocabulary: Iterable[str], options: Options | None = None) -> None:
        self.vocabulary = frozenset(vocabulary)
        self.options = options or self.options

    def reset_vocabulary(self) -> None:
        self.vocabulary = frozenset()

    def merge(self, pieces: list[str], rng: random.Random | None = None) -> list[str]:
        """Lowest rank first, leftmost of equal ones; with rng, each candidate of each round is passed over with the chance of dropout."""
        pieces = list(pieces)
        ranks = [self.rank.get(a + b, NEVER) for a, b in zip(pieces, pieces[1:], strict=False)]
        while ranks:
            if rng is None:
                best = min(ranks)
                at = ranks.index(best) if best < NEVER else -1
            else:
                usable = [(r, k) for k, r in enumerate(ranks) if rng.random() >= self.dropout and r < NEVER]
                at = min(usable)[1] if usable else -1
            if at < 0:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            del ranks[at]
            for k in (at - 1, at):
                if 0 <= k < len(ranks):
                    ranks[k] = self.rank.get(pieces[k] + pieces[k + 1], NEVER)
        return pieces

    def encode(self, text: str, training: bool = True, rng: random.Random | None = None) -> list[str]:
        drop = training and self.dropout > 0
        if not drop and text in self._known:
            return self._known[text]
        out = self._encode(text, (rng or random) if drop else None)
        if not drop and len(self._known) < REMEMBERED:
            self._known[text] = out
        return out

    def _encode(self, text: str, rng) -> list[str]:
        pieces, ranks, text = self.start(text)
        if not pieces:
            return [text] if text else []
        return self.finish(self.merge(pieces) if rng is None else self.merge_some(pieces, ranks, rng), text)

    def merge_some(self, pieces: list[str], ranks: list[float], rng: random.Random) -> list[str]:
        """merge() in which each candidate of each round is passed over with the chance of dropout. Neighbours that no merge joins need no draw."""
        pieces, ranks, draw, dropout = list(pieces), list(ranks), rng.random, self.dropout
        while True:
            at, best = -1, NEVER
            for k, r in enumerate(ranks):
                if r < NEVER and draw() >= dropout and r < best:
                    at, best = k, r
            if at < 0:
                return pieces
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            del ranks[at]
            for k in (at - 1, at):
                if 0 <= k < len(ranks):
                    ranks[k] = self.rank.get(pieces[k] + pieces[k + 1], NEVER)

    def start(self, text: str) -> tuple[list[str], list[float], str]:
        """(pieces before all merges, ranks of neighbours, text); no pieces where there is nothing to merge."""
        text = characters(text)
        pieces = initial_pieces(text, self.insensitive)
        if len(pieces) < 2:
            return [], [], text
        if self.version == "0.2":
            pieces[-1] += self.end
        elif self.version == "0.1":
            pieces.append(self.end)
        else:
            pieces = [self.begin] * self.prefix + pieces + [self.end] * self.suffix
        return pieces, [self.rank.get(a + b, NEVER) for a, b in zip(pieces, pieces[1:], strict=False)], text

    def finish(self, pieces: list[str], text: str) -> list[str]:
        """Merged pieces without the marks of begin and end."""
        if not pieces:
            return [text] if text else []
        if self.prefix and pieces[0].startswith(self.begin):
            pieces[0] = pieces[0][len(self.begin) :]
        if self.suffix and pieces[-1].endswith(self.end):
            pieces[-1] = pieces[-1][: -len(self.end)]
        pieces = pieces[not pieces[0] :]
        pieces = pieces[:-1] if not pieces[-1] else pieces
        return self._true_case(text, pieces) if self.insensitive else pieces

    @staticmethod
    def _true_case(text: str, pieces: list[str]) -> list[str]:
        """The same cuts in the text as it was; lower-case forms may have other sizes in bytes."""
        out, at = [], 0
        for piece in pieces:
            size, have, start = len(piece.encode()), 0, at
            while at < len(text) and have < size:
                ch = text[at]
                have += len((simple_lower(ch) if char_case(ch) == "upper" else ch).encode())
                at += 1
            out.append(text[start:at])
        return out

    def encode_token(self, token: Token, training: bool = True, rng: random.Random | None = None) -> list[Token]:
        pieces = self.encode(token.surface, training, rng)
        last = len(pieces) - 1
        out = [
            Token(
                p,
                join_left=token.join_left if k == 0 else False,
                join_right=True if k < last else token.join_right,
                preserve=token.preserve and ((k == 0 and token.join_left) or (k == last and token.join_right)),
            )
            for k, p in enumerate(pieces)
        ]
        if self.vocabulary:
            out = [t for k, p in enumerate(out) for t in self._within(p, k == 0, k == last)]
        return self.propagate(token, out)

    def _in_vocabulary(self, t: Token, first: bool, last: bool) -> bool:
        o, text = self.options, t.surface
        if o.joiner_annotate and not o.joiner_new:
            text = o.joiner * (t.join_left and not (first and t.preserve)) + text + o.joiner * (t.join_right and not (last and t.preserve))
        elif o.spacer_annotate and not o.spacer_new and not t.join_left and not (first and t.preserve):
            text = SPACER + text
        return text in self.vocabulary

    def _within(self, t: Token, first: bool, last: bool) -> list[Token]:
        """t, or the parts that its merge was made of, until all are in the vocabulary or can't be parted."""
        if self._in_vocabulary(t, first, last):
            return [t]
        head, tail = self.begin * (self.prefix and first), self.end * (self.suffix and last)
        found = self.split.get(head + t.surface + tail)
        if found is None:
            return [t]
        left = Token(found[0][len(head) :], join_left=first and t.join_left, join_right=True, preserve=first and t.join_left and t.preserve)
        right = Token(found[1][: len(found[1]) - len(tail)], join_right=not last or t.join_right, preserve=last and t.join_right and t.preserve)
        return self._within(left, first, False) + self._within(right, False, last)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}


def read_vocabulary(path: str, threshold: int = 0) -> list[str]:
    """Tokens of a restriction file (token, then a space or else a tab, then a count; 1 where it is missing) that reach the threshold."""
    out = []
    try:
        with open(path, encoding="utf-8", newline="\n") as f:
            lines = f.read().split("\n")
    except OSError as e:
        raise ValueError(f"Unable to open vocabulary file {path}") from e
    for line in lines[: len(lines) - (lines[-1] == "")]:
        sep = " " if " " in line else "\t"
        token, found, count = line.partition(sep)
        if found and not count.lstrip().lstrip("+-")[:1].isdigit():
            raise ValueError(f"invalid frequency in vocabulary file: {line}")
        digits = "".join(c for c in count if c.isdigit())
        if (int(digits) if found else 1) >= threshold:
            out.append(token)
    return out
