"""The interface of subword encoders, and what all of them share."""

from __future__ import annotations

import random
from collections.abc import Iterable

from tokenloom.operators.casing import casing_of
from tokenloom.operators.token import Casing, Token, TokenType
from tokenloom.options import Options


class SubwordEncoder:
    """Subclasses give encode(text) and encode_token(token)."""

    def encode(self, text: str, training: bool = True, rng: random.Random | None = None) -> list[str]:
        raise NotImplementedError

    def encode_token(self, token: Token, training: bool = True, rng: random.Random | None = None) -> list[Token]:
        raise NotImplementedError

    def set_vocabulary(self, vocabulary: Iterable[str], options: Options | None = None) -> None:
        """Nothing, unless a subclass can be restricted."""

    def reset_vocabulary(self) -> None:
        """Nothing, unless a subclass can be restricted."""

    def adapt(self, options: Options) -> Options:
        """The options that a loom with this encoder works with."""
        return options

    def encode_tokens(self, tokens: list[Token], training: bool = True, rng: random.Random | None = None) -> list[Token]:
        return [x for t in tokens for x in ([t] if t.is_placeholder() else self.encode_token(t, training, rng))]

    @staticmethod
    def propagate(token: Token, pieces: list[Token]) -> list[Token]:
        """pieces with the casing, the place and the features of the token they come from."""
        for k, p in enumerate(pieces):
            if token.casing is Casing.CAPITALIZED and k:
                p.casing = Casing.LOWERCASE
            elif token.casing is Casing.MIXED:
                p.casing = casing_of(p.surface)
            elif token.casing is not Casing.NONE:
                p.casing = token.casing
            if len(pieces) > 1:
                p.type = TokenType.TRAILING_SUBWORD if k else TokenType.LEADING_SUBWORD
            if token.features:
                p.features = list(token.features)
        return pieces
