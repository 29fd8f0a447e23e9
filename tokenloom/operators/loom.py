"""The loom: options and a subword encoder, for single texts in Python and for DataFrame columns."""

from __future__ import annotations

import random
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.chars import is_placeholder
from tokenloom.operators import annotate, native
from tokenloom.operators.bpe import BPE, NEVER, REMEMBERED, read_vocabulary
from tokenloom.operators.casing import lowered
from tokenloom.operators.chunks import Chunks
from tokenloom.operators.segmenter import segment
from tokenloom.operators.spm import SentencePiece
from tokenloom.operators.subword import SubwordEncoder
from tokenloom.operators.token import TOKEN_SCHEMA, Token
from tokenloom.options import JOINER, SPACER, Options

_seed = random.Random()
PROGRESS = 10_000  # lines of a local file that are held, and between two lines of progress


def set_random_seed(seed: int) -> None:
    """Of dropout in this process. Columns take their own seed and draw by row, so that reruns agree on any cluster."""
    _seed.seed(seed)


def write_lines(read: Iterable[str], write, f, threads: int = 1, verbose: bool = False) -> None:
    """f of every line, in order. Some thousand lines are held at once, whatever the number of threads. Verbose: lines done, on the error stream."""
    lines = (line.removesuffix("\n") for line in read)
    done = 0
    with ThreadPoolExecutor(max(1, threads)) as pool:
        while part := list(islice(lines, PROGRESS)):
            for x in pool.map(f, part) if threads > 1 else map(f, part):
                write.write(x + "\n")
            done += len(part)
            if verbose:
                print(f"{done} lines", file=sys.stderr)


class Loom:
    """Made from a mode and options, from Options, or from another loom; with at most one subword encoder."""

    def __init__(
        self, mode: str | Options | Loom = "conservative", *, encoder: SubwordEncoder | None = None, bpe_model_path: str = "", bpe_vocab_path: str = "", bpe_vocab_threshold: int = 50,
        bpe_dropout: float = 0.0, vocabulary: Iterable[str] | None = None, vocabulary_path: str = "", vocabulary_threshold: int = 0, sp_model_path: str = "", sp_nbest_size: int = 0,
        sp_alpha: float = 0.1, **options,
    ) -> None:
        if isinstance(mode, Loom):
            self.options, self.encoder = mode.options, mode.encoder
            return
        self.options = mode if isinstance(mode, Options) else Options(mode=mode, **options)
        if sp_model_path:
            encoder = SentencePiece(sp_model_path, sp_nbest_size, sp_alpha)
        elif bpe_model_path:
            encoder = BPE(bpe_model_path, bpe_dropout)
        self.encoder = encoder
        if encoder is not None:
            self.options = encoder.adapt(self.options)
            if isinstance(encoder, BPE) and not encoder.vocabulary:
                encoder.options = self.options
            if vocabulary is not None and not isinstance(vocabulary, str):
                encoder.set_vocabulary(vocabulary, self.options)
            elif vocabulary_path:
                encoder.set_vocabulary(read_vocabulary(vocabulary_path, vocabulary_threshold), self.options)
            elif bpe_vocab_path:
                encoder.set_vocabulary(read_vocabulary(bpe_vocab_path, bpe_vocab_threshold), self.options)

    def __copy__(self) -> Loom:
        return Loom(self)

    def __deepcopy__(self, _memo) -> Loom:
        return Loom(self)

    def with_encoder(self, encoder: SubwordEncoder | None) -> Loom:
        return Loom(self.options, encoder=encoder)

    # single texts

    def tokens(self, text: str, training: bool = True, alphabets: Counter | None = None, rng: random.Random | None = None) -> list[Token]:
        out = segment(text, self.options, alphabets)
        if self.options.case_feature or self.options.case_markup:
            for t in out:
                if not t.is_placeholder():
                    t.surface, t.casing = lowered(t.surface, self.options.lang)
        return self.encoder.encode_tokens(out, training, rng or _seed) if self.encoder is not None else out

    def __call__(self, text: str, training: bool = True) -> list[str]:
        return annotate.serialize(self.tokens(text, training), self.options)[0]

    def tokenize(self, text: str, as_token_objects: bool = False, training: bool = True):
        made = self.tokens(text, training)
        return made if as_token_objects else annotate.serialize(made, self.options)

    def tokenize_batch(self, batch_text: Iterable[str], as_token_objects: bool = False, training: bool = True) -> list:
        return [self.tokenize(text, as_token_objects, training) for text in batch_text]

    def serialize_tokens(self, tokens: list[Token]):
        return annotate.serialize(tokens, self.options)

    def deserialize_tokens(self, tokens: list[str], features=None) -> list[Token]:
        """Tokens of the text that the strings stand for: it is segmented anew."""
        return self.tokens(self.detokenize(tokens, features), training=False)

    def _parsed(self, tokens, features=None) -> tuple[list[Token], list[int] | None]:
        tokens = list(tokens)
        return (tokens, None) if tokens and isinstance(tokens[0], Token) else annotate.parse(tokens, features, self.options)

    def detokenize(self, tokens, features=None) -> str:
        return annotate.detokenize(self._parsed(tokens, features)[0], self.options)

    def detokenize_with_ranges(self, tokens, merge_ranges: bool = False, unicode_ranges: bool = False, features=None):
        parsed, places = self._parsed(tokens, features)
        return annotate.detokenize_ranges(parsed, self.options, places, merge=merge_ranges, unicode=unicode_ranges)

    def alphabets(self, text: str) -> dict[str, int]:
        found: Counter = Counter()
        segment(text, self.options, found)
        return dict(found)

    def tokenize_file(self, input_path: str, output_path: str, num_threads: int = 1, verbose: bool = False, training: bool = True, tokens_delimiter: str = " ") -> None:
        """A local file, line by line, in order. For files of any size see sources.text_files."""
        self._file(input_path, output_path, lambda line: annotate.write_line(*self.tokenize(line, training=training), tokens_delimiter), num_threads, verbose)

    def detokenize_file(self, input_path: str, output_path: str, tokens_delimiter: str = " ") -> None:
        self._file(input_path, output_path, lambda line: self.detokenize(*annotate.read_line(line, tokens_delimiter)))

    @staticmethod
    def _file(input_path: str, output_path: str, f, threads: int = 1, verbose: bool = False) -> None:
        try:
            read = open(input_path, encoding="utf-8", newline="\n")
        except OSError as e:
            raise ValueError(f"{input_path} can't be read") from e
        with read:
            try:
                write = open(output_path, "w", encoding="utf-8", newline="\n")
            except OSError as e:
                raise ValueError(f"{output_path} can't be written") from e
            with write:
                write_lines(read, write, f, threads, verbose)

    # columns

    @property
    def is_native(self) -> bool:
        """Whether columns of this loom are Catalyst expressions alone."""
        return self.encoder is None and native.covers(self.options)

    def _draws(self, training: bool) -> bool:
        return bool(training and (getattr(self.encoder, "dropout", 0) or getattr(self.encoder, "nbest_size", 0)))

    def _by_chunks(self, training: bool) -> Chunks | None:
        """What cuts texts by their chunks, where options and encoder allow it."""
        encoder = self.encoder is None or (isinstance(self.encoder, BPE) and not self._draws(training))
        return Chunks(self) if encoder and Chunks.fit(self.options) else None

    def _draws_by_words(self, training: bool) -> bool:
        """Whether merges with dropout can be drawn token string by token string."""
        return self._draws(training) and isinstance(self.encoder, BPE) and not self.encoder.vocabulary and self.options.joiner_annotate and self.options.mode != "space" and self._plain_words()

    def _drawn(self, word: str, rng: random.Random) -> list[str]:
        """Strings of the subwords of one token string, by draws."""
        known = self.__dict__.setdefault("_starts", {})
        start = known.get(word)
        if start is None:
            left, right = word.startswith(JOINER), word.endswith(JOINER)
            held = is_placeholder(word)
            start = left, right, None if held else self.encoder.start(word[left : len(word) - right])
            if held or not any(r < NEVER for r in start[2][1]):  # nothing to draw
                start = [word] if held else self._shown(self.encoder.finish(*start[2][::2]), left, right)
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = start
        if isinstance(start, list):
            return start
        left, right, (pieces, ranks, text) = start
        return self._shown(self.encoder.finish(self.encoder.merge_some(pieces, ranks, rng), text), left, right)

    @staticmethod
    def _shown(pieces: list[str], left: bool, right: bool) -> list[str]:
        if not pieces:  # joiners alone
            return []
        out = [p + JOINER for p in pieces]
        out[-1] = pieces[-1] + JOINER * right
        out[0] = JOINER * left + out[0]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_starts"}

    def _by_words(self, training: bool) -> bool:
        """Whether the pieces of a native token follow from its string alone, so that each different one is encoded once."""
        return isinstance(self.encoder, BPE) and not self._draws(training) and self._plain_words() and not (self.options.spacer_annotate and self.encoder.vocabulary)

    def _plain_words(self) -> bool:
        o = self.options
        plain = o.joiner == JOINER and not (o.joiner_new or o.spacer_new or o.no_substitution or o.with_separators or o.preserve_placeholders or o.preserve_segmented_tokens or o.case_feature)
        return native.covers(o) and plain

    def _pieces(self, word: str) -> list[str]:
        """Strings of the subwords of one token string."""
        if is_placeholder(word):
            return [word]
        o = self.options
        if not (o.joiner_annotate or o.spacer_annotate):
            return [t.surface for t in self.encoder.encode_token(Token(word), False)]
        if o.spacer_annotate:
            apart = word.startswith(SPACER)
            pieces = [t.surface for t in self.encoder.encode_token(Token(word[apart:]), False)]
            return [SPACER * apart + pieces[0], *pieces[1:]] if pieces else [word]
        left, right = word.startswith(JOINER), word.endswith(JOINER)
        pieces = self.encoder.encode_token(Token(word[left : len(word) - right], join_left=left, join_right=right), False)
        return [JOINER * t.join_left + t.surface + JOINER * t.join_right for t in pieces]

    def _word_pieces(self, lists: pa.Array) -> pa.Array:
        """Token strings of a batch, each different one cut into pieces once."""
        words = lists.flatten().dictionary_encode()
        made = [self._pieces(w) for w in words.dictionary.to_pylist()]
        sizes = np.array([len(m) for m in made], np.int64)
        first = np.cumsum(sizes) - sizes
        own = words.indices.to_numpy(zero_copy_only=False)
        at = np.append(0, np.cumsum(sizes[own]))
        flat = pa.array([p for m in made for p in m], pa.string()).take(pa.array(np.arange(at[-1]) + np.repeat(first[own] - at[:-1], sizes[own])))
        edges = at[np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), flat, mask=lists.is_null() if lists.null_count else None)

    def column(self, text: Column | str, *, training: bool = True, seed: int | None = None, key: Column | str | None = None, tier: str = "auto") -> Column:
        """array<string> of tokens; null for null. With dropout and a seed, a row draws by (seed, key), so give a key that names it."""
        text = F.col(text) if isinstance(text, str) else text
        if tier == "native" or (tier == "auto" and self.is_native):
            return native.tokens(text, self.options)
        if tier == "auto" and self._draws_by_words(training) and key is not None and seed is not None:

            def drawn(lists: pa.Array, keys: pa.Array) -> pa.Array:
                made = []
                for words, k in zip(lists.to_pylist(), keys.to_pylist(), strict=True):
                    rng = random.Random(f"{seed}:{k}")
                    made.append(None if words is None else [p for w in words for p in self._drawn(w, rng)])
                return pa.array(made, pa.list_(pa.string()))

            return F.arrow_udf(drawn, "array<string>")(native.tokens(text, self.options), F.col(key) if isinstance(key, str) else key)
        if tier == "auto" and self._by_words(training):
            return F.arrow_udf(self._word_pieces, "array<string>")(native.tokens(text, self.options))

        by_chunks = self._by_chunks(training)

        def rows(texts, keys):
            if by_chunks is not None:
                return [None if x is None else by_chunks.strings(x) for x in texts]
            if not self._draws(training):
                return [None if x is None else self(x, training) for x in texts]
            rngs = (random.Random(f"{seed}:{k}") for k in keys)
            return [None if x is None else annotate.serialize(self.tokens(x, training, rng=r), self.options)[0] for x, r in zip(texts, rngs, strict=True)]

        return self._udf(rows, text, key, seed, pa.list_(pa.string()), "array<string>")

    def token_column(self, text: Column | str, *, training: bool = True) -> Column:
        """array<struct> of token objects (TOKEN_SCHEMA)."""
        kinds = pa.list_(pa.struct([(f.name, {"boolean": pa.bool_(), "string": pa.string()}.get(f.dataType.simpleString(), pa.list_(pa.string()))) for f in TOKEN_SCHEMA]))
        names = TOKEN_SCHEMA.names

        def rows(texts, _keys):
            return [None if x is None else [dict(zip(names, t.as_tuple(), strict=True)) for t in self.tokens(x, training)] for x in texts]

        return self._udf(rows, F.col(text) if isinstance(text, str) else text, None, None, kinds, T.ArrayType(TOKEN_SCHEMA))

    def line_column(self, text: Column | str, delimiter: str = " ", *, training: bool = True, tier: str = "auto") -> Column:
        """The token line: tokens with their features, joined by delimiter. Tier "chunks" is the faster one for tables whose texts have placeholders, or any case feature."""
        text = F.col(text) if isinstance(text, str) else text
        chunks = Chunks.fit(self.options) and (tier == "chunks" or self.options.case_feature)
        if self.is_native and self.options.mode != "space" and not chunks:  # where texts may hold features
            return native.line(text, self.options, delimiter)
        if self._by_words(training) and self.options.mode != "space" and self.encoder is not None:
            return F.array_join(self.column(text, training=training), delimiter)

        by_chunks = self._by_chunks(training)

        def rows(texts, _keys):
            if by_chunks is not None:
                return [None if x is None else by_chunks.line(x, delimiter)[0] for x in texts]
            return [None if x is None else annotate.write_line(*self.tokenize(x, training=training), delimiter) for x in texts]

        return self._udf(rows, text, None, None, pa.string(), "string")

    def counted_line_column(self, text: Column | str) -> Column:
        """struct<line string, n long>: the token line and the number of its tokens, which need not come back as an array."""
        text = F.col(text) if isinstance(text, str) else text
        by_chunks = self._by_chunks(False)

        def rows(texts, _keys):
            if by_chunks is not None:
                made = [(None, None) if x is None else by_chunks.line(x) for x in texts]
            else:
                cut = [None if x is None else self.tokenize(x, training=False) for x in texts]
                made = [(None, None) if x is None else (annotate.write_line(*x), len(x[0])) for x in cut]
            return [{"line": a, "n": b} for a, b in made]

        return self._udf(rows, text, None, None, pa.struct([("line", pa.string()), ("n", pa.int64())]), "struct<line: string, n: long>")

    def detokenized(self, tokens: Column | str) -> Column:
        """Text of an array<string> column."""
        tokens = F.col(tokens) if isinstance(tokens, str) else tokens

        reader = None if self.options.case_feature else annotate.Reader(self.options)

        def rows(lists, _keys):
            return [None if x is None else reader.text(x) if reader else self.detokenize(x) for x in lists]

        return self._udf(rows, tokens, None, None, pa.string(), "string")

    def ranges_column(self, tokens: Column | str, *, merge: bool = False, unicode: bool = False) -> Column:
        """array<struct<token, start, end>> (ends included) of an array<string> column, in bytes or code points."""
        tokens = F.col(tokens) if isinstance(tokens, str) else tokens
        kind = pa.list_(pa.struct([("token", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        if merge and not self.options.case_feature:

            def whole(lists: pa.Array) -> pa.Array:
                return self._merged_ranges(lists, unicode).cast(kind)

            return F.arrow_udf(whole, "array<struct<token: long, start: long, end: long>>")(tokens)

        def rows(lists, _keys):
            return [None if x is None else [{"token": k, "start": a, "end": b} for k, (a, b) in self.detokenize_with_ranges(x, merge, unicode)[1].items()] for x in lists]

        return self._udf(rows, tokens, None, None, kind, "array<struct<token: long, start: long, end: long>>")

    def _merged_ranges(self, lists: pa.Array, unicode: bool) -> pa.Array:
        """Merged ranges of a batch. Whether two neighbours stay one is asked once for each different pair of them; lists with placeholders, markup or escapes are read one by one."""
        kind = pa.list_(pa.struct([("token", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.match_substring(flat, "｟"), pc.match_substring(flat, "％")).fill_null(False).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), sizes)
        strange = np.zeros(len(lists), bool)
        strange[owner[odd]] = True
        if strange.any():
            some = pa.array(strange)
            slow = pa.array([[{"token": k, "start": a, "end": b} for k, (a, b) in self.detokenize_with_ranges(x, True, unicode)[1].items()] for x in lists.filter(some).to_pylist()], kind)
            both = pa.concat_arrays([self._merged_ranges(lists.filter(pc.invert(some)), unicode), slow])
            place = np.empty(len(lists), np.int64)
            place[np.flatnonzero(~strange)] = np.arange((~strange).sum())
            place[np.flatnonzero(strange)] = np.arange((~strange).sum(), len(lists))
            return both.take(pa.array(place))
        points = native.running_ranges(self.options, True)(lists)
        shown = points if unicode else native.running_ranges(self.options, False)(lists)
        counts = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        places, starts, ends = (points.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
        own = np.repeat(np.arange(len(lists)), counts)
        words = flat.dictionary_encode()
        surfaces = [annotate.strip_marks(w or "", self.options).surface for w in words.dictionary.to_pylist()]
        code = words.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[np.append(0, np.cumsum(sizes))[:-1][own] + places]
        begins = np.ones(len(own), bool)
        near = np.flatnonzero((own[1:] == own[:-1]) & (starts[1:] == ends[:-1] + 1)) + 1
        pairs, which = np.unique(code[near - 1] * len(surfaces) + code[near], return_inverse=True)
        plain = Loom()
        simple = Chunks(plain).simple
        texts = (surfaces[p // len(surfaces)] + surfaces[p % len(surfaces)] for p in pairs.tolist())
        apart = np.array([len(simple(x) if simple.fit.fullmatch(x) and not simple.stopped.search(x) else segment(x, plain.options)) > 1 for x in texts], bool)
        begins[near] = apart[which] if len(near) else False
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(own)))
        values = shown.flatten()
        a, b = values.field(1).to_numpy(zero_copy_only=False), values.field(2).to_numpy(zero_copy_only=False)
        made = pa.StructArray.from_arrays([pa.array(places.astype(np.int64)), pa.array(np.repeat(a[first], length)), pa.array(np.repeat(b[first + length - 1], length))], names=["token", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), made, mask=lists.is_null() if lists.null_count else None)

    def size_column(self, texts: Column | str) -> Column:
        """The number of tokens of all texts of an array<string> column; each different text of a batch is cut once."""

        def sizes(lists: pa.Array) -> pa.Array:
            words = lists.flatten().dictionary_encode()
            each = np.array([len(self(w, False)) for w in words.dictionary.to_pylist()], np.int64)
            at = np.append(0, np.cumsum(each[words.indices.to_numpy(zero_copy_only=False)]))
            edges = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            return pa.array(np.diff(at[edges]), mask=lists.is_null().to_numpy(zero_copy_only=False))

        return F.arrow_udf(sizes, "long")(F.col(texts) if isinstance(texts, str) else texts)

    def flag_column(self, text: Column | str) -> Column:
        """array<struct<surface, join_left, join_right>> of tokens, of a loom without random draws."""
        by_chunks = self._by_chunks(False)

        def flags(x: str):
            made = by_chunks.flags(x) if by_chunks is not None else None
            if made is None:
                tokens = self.tokens(x, False)
                made = [t.surface for t in tokens], [t.join_left for t in tokens], [t.join_right for t in tokens]
            return made

        def whole(texts: pa.Array) -> pa.Array:
            columns, edges = ([], [], []), [0]
            for x in texts.to_pylist():
                if x is not None:
                    for column, values in zip(columns, flags(x), strict=True):
                        column += values
                edges.append(len(columns[0]))
            made = pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.bool_())], names=["surface", "join_left", "join_right"])
            return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), made, mask=texts.is_null() if texts.null_count else None)

        return F.arrow_udf(whole, "array<struct<surface: string, join_left: boolean, join_right: boolean>>")(F.col(text) if isinstance(text, str) else text)

    def alphabet_column(self, text: Column | str) -> Column:
        """map<string, long>: characters by script."""

        by_chunks = self._by_chunks(False)

        def rows(texts, _keys):
            return [None if x is None else list((by_chunks or self).alphabets(x).items()) for x in texts]

        return self._udf(rows, F.col(text) if isinstance(text, str) else text, None, None, pa.map_(pa.string(), pa.int64()), "map<string, long>")

    def _udf(self, rows, column: Column, key, seed, arrow, kind) -> Column:
        def apply(columns: Iterator) -> Iterator[pa.Array]:
            for batch in columns:
                values, keys = batch if isinstance(batch, tuple) else (batch, None)
                yield pa.array(rows(values.to_pylist(), keys.to_pylist() if keys is not None else [0] * len(values)), arrow)

        if key is not None and seed is not None:

            def both(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                return apply(columns)

            return F.arrow_udf(both, kind)(column, F.col(key) if isinstance(key, str) else key)

        def one(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return apply(columns)

        made = F.arrow_udf(one, kind)
        random_draws = (getattr(self.encoder, "dropout", 0) or getattr(self.encoder, "nbest_size", 0)) and seed is None
        return (made.asNondeterministic() if random_draws else made)(column)


def sentencepiece_loom(model_path: str, vocabulary_path: str | None = None, vocabulary_threshold: int = 0, nbest_size: int = 0, alpha: float = 0.1) -> Loom:
    """A loom that does what the model alone would do."""
    return Loom("none", sp_model_path=model_path, vocabulary_path=vocabulary_path or "", vocabulary_threshold=vocabulary_threshold, sp_nbest_size=nbest_size, sp_alpha=alpha)


__all__ = ["Loom", "is_placeholder", "sentencepiece_loom", "set_random_seed"]
