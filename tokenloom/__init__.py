"""Reversible text segmentation, subword processing and vocabularies at DataFrame scale."""

from tokenloom.operators.bpe import BPE
from tokenloom.operators.learn import BPELearner, SentencePieceLearner, SPMLearner
from tokenloom.operators.spm import SentencePiece
from tokenloom.operators.subword import SubwordEncoder
from tokenloom.operators.token import Casing, Token, TokenType
from tokenloom.operators.loom import Loom, is_placeholder, sentencepiece_loom, set_random_seed
from tokenloom.operators.vocab import Vocab, build_vocab_from_lines, build_vocab_from_tokens
from tokenloom.options import Options, is_valid_language

__all__ = ["BPE", "BPELearner", "Casing", "Options", "SPMLearner", "SentencePiece", "SentencePieceLearner", "SubwordEncoder", "Token", "TokenType", "Loom", "Vocab", "build_vocab_from_lines", "build_vocab_from_tokens", "is_placeholder", "is_valid_language", "sentencepiece_loom", "set_random_seed"]
