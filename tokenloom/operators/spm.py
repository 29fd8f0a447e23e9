"""SentencePiece models as subword encoders."""

from __future__ import annotations

import random
from collections.abc import Iterable

from tokenloom.operators.subword import SubwordEncoder
from tokenloom.operators.token import Token
from tokenloom.options import SPACER, Options


class SentencePiece(SubwordEncoder):
    """model: a file, or its bytes, which travel to workers with the closure; a worker loads them once."""

    def __init__(self, model: str | bytes, nbest_size: int = 0, alpha: float = 0.1) -> None:
        try:
            self.model = open(model, "rb").read() if isinstance(model, str) else model
        except OSError as e:
            raise ValueError(f"Unable to open SentencePiece model {model}") from e
        self.nbest_size, self.alpha, self._processor, self._vocabulary = nbest_size, alpha, None, None
        self.processor()

    def processor(self):
        if self._processor is None:
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor()
            try:
                made.LoadFromSerializedProto(self.model)
            except RuntimeError as e:
                raise ValueError(f"Unable to load the SentencePiece model: {e}") from e
            if self._vocabulary is not None:
                made.SetVocabulary(self._vocabulary)
            self._processor = made
        return self._processor

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_processor": None}

    def enable_regularization(self, nbest_size: int, alpha: float) -> None:
        self.nbest_size, self.alpha = nbest_size, alpha

    def adapt(self, options: Options) -> Options:
        plain = options.mode == "none" and not options.joiner_annotate and not options.spacer_annotate
        return options.with_(spacer_annotate=True, no_substitution=True) if plain else options

    def set_vocabulary(self, vocabulary: Iterable[str], options: Options | None = None) -> None:
        if options and (options.joiner_annotate or options.spacer_new):
            raise ValueError('SentencePiece vocabulary restriction requires the tokenization to use "spacer_annotate" (same as spm_encode)')
        self._vocabulary = list(vocabulary)
        self.processor().SetVocabulary(self._vocabulary)

    def reset_vocabulary(self) -> None:
        self._vocabulary = None
        self.processor().ResetVocabulary()

    def encode(self, text: str, training: bool = True, rng: random.Random | None = None) -> list[str]:
        if training and self.nbest_size:
            return self.processor().encode(text, out_type=str, enable_sampling=True, nbest_size=self.nbest_size, alpha=self.alpha)
        return self.processor().encode(text, out_type=str)

    def encode_token(self, token: Token, training: bool = True, rng: random.Random | None = None) -> list[Token]:
        out: list[Token] = []
        waiting = False  # a lone spacer goes to the next piece
        for piece in self.encode(token.surface, training, rng):
            if piece == SPACER:
                waiting = True
            elif piece.startswith(SPACER):
                out.append(Token(piece[len(SPACER) :], spacer=True))
            else:
                out.append(Token(piece, spacer=waiting, preserve=waiting, join_left=not waiting and bool(out)))
                waiting = False
        if not out:
            return [token]
        out[0].join_left, out[-1].join_right = token.join_left, token.join_right
        out[0].preserve |= token.join_left and token.preserve
        out[-1].preserve |= token.join_right and token.preserve
        return self.propagate(token, out)
