"""Command line: tokenize and detokenize standard input line by line, or whole text files with Spark, and learn subword models from files."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from tokenloom.operators.annotate import read_line, write_line
from tokenloom.operators.learn import BPELearner, SentencePieceLearner
from tokenloom.operators.loom import Loom, set_random_seed, write_lines
from tokenloom.options import Options
from tokenloom.sources.text_files import detokenize_text_files, tokenize_text_files


def _tokenization(p: argparse.ArgumentParser, prefix: str = "") -> None:
    for f in dataclasses.fields(Options):
        flag = f"--{prefix}{f.name}"
        if f.name == "segment_alphabet":
            p.add_argument(flag, action="append", default=[])
        elif isinstance(f.default, bool):
            p.add_argument(flag, action="store_true")
        else:
            p.add_argument(flag, default=f.default)


def _options(args: argparse.Namespace) -> Options:
    return Options(**{f.name: getattr(args, f.name) for f in dataclasses.fields(Options) if hasattr(args, f.name)})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tokenloom")
    commands = top.add_subparsers(dest="command", required=True)
    t = commands.add_parser("tokenize")
    _tokenization(t)
    t.add_argument("--tokens_delimiter", default=" ")
    t.add_argument("--seed", type=int)
    t.add_argument("--bpe_model", "--bpe_model_path", dest="bpe_model", default="")
    t.add_argument("--bpe_dropout", type=float, default=0)
    t.add_argument("--bpe_vocab", default="")
    t.add_argument("--bpe_vocab_threshold", type=int, default=50)
    t.add_argument("--sp_model", "--sp_model_path", dest="sp_model", default="")
    t.add_argument("--sp_nbest_size", type=int, default=0)
    t.add_argument("--sp_alpha", type=float, default=0.1)
    t.add_argument("--vocabulary", default="")
    t.add_argument("--vocabulary_threshold", type=int, default=0)
    t.add_argument("--num_threads", type=int, default=1)
    t.add_argument("-v", "--verbose", action="store_true")
    d = commands.add_parser("detokenize")
    d.add_argument("--lang", default="")
    d.add_argument("--joiner", default=Options.joiner)
    for name in ("spacer_annotate", "case_feature", "with_separators"):
        d.add_argument(f"--{name}", action="store_true")
    d.add_argument("--tokens_delimiter", default=" ")
    for p in (t, d):
        p.add_argument("--files", nargs=2, metavar=("INPUT", "OUTPUT"), help="text files to read and a folder to write, with Spark, in the order of the lines")
    s = commands.add_parser("subword_learn")
    s.add_argument("-i", "--input", action="append", default=[])
    s.add_argument("-o", "--output", required=True)
    _tokenization(s)
    s.add_argument("kind", choices=["bpe", "sentencepiece"])
    s.add_argument("-s", "--symbols", type=int, default=10_000)
    s.add_argument("--min-frequency", type=int, default=2)
    s.add_argument("--dict-input", action="store_true")
    s.add_argument("-t", "--total-symbols", action="store_true")
    s.add_argument("-v", "--verbose", action="store_true")
    s.add_argument("--tmpfile", default="", help="where lines for the sentencepiece trainer are kept while it runs; deleted afterwards")
    s.add_argument("--option", action="append", default=[], help="key=value for the sentencepiece trainer")
    return top


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def main(argv: list[str] | None = None, read=sys.stdin, write=sys.stdout) -> int:
    args = parser().parse_args(argv)
    if args.command == "tokenize":
        if args.seed is not None:
            set_random_seed(args.seed)
        sp = "" if args.bpe_model else args.sp_model  # a BPE model comes first here
        t = Loom(_options(args), bpe_model_path=args.bpe_model, bpe_dropout=args.bpe_dropout, bpe_vocab_path=args.bpe_vocab, bpe_vocab_threshold=args.bpe_vocab_threshold, sp_model_path=sp, sp_nbest_size=args.sp_nbest_size, sp_alpha=args.sp_alpha, vocabulary_path=args.vocabulary, vocabulary_threshold=args.vocabulary_threshold)
        if args.files:
            tokenize_text_files(_spark(), *args.files, t, delimiter=args.tokens_delimiter, ordered=True)
        else:
            write_lines(read, write, lambda line: write_line(*t.tokenize(line), args.tokens_delimiter), args.num_threads, args.verbose)
    elif args.command == "detokenize":
        t = Loom(_options(args))
        if args.files:
            detokenize_text_files(_spark(), *args.files, t, delimiter=args.tokens_delimiter, ordered=True)
        else:
            write_lines(read, write, lambda line: t.detokenize(*read_line(line, args.tokens_delimiter)))
    else:
        default = args.mode == "conservative" and not args.joiner_annotate and not args.spacer_annotate
        t = None if default else Loom(_options(args))
        if args.kind == "bpe":
            learner = BPELearner(t, args.symbols, args.min_frequency, args.total_symbols, args.dict_input)
        else:
            learner = SentencePieceLearner(t, **dict(x.split("=", 1) for x in args.option))
        for path in args.input:
            learner.ingest_file(path)
        if not args.input:
            for line in read:
                learner.ingest(line.rstrip("\n"))
        if args.tmpfile and args.kind == "sentencepiece":
            learner.input_path = args.tmpfile
        learner.learn(args.output, args.verbose)
    return 0
