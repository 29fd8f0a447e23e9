"""The native tier: segmentation, annotation, case features and detokenization as Catalyst expressions (no Python on the executors).

Units of a text are found by one regular expression. Their join marks depend on the characters about each boundary alone, so boundaries become marks in the text, a few replacements tell them apart,
and one split makes the tokens. Texts with placeholders, with marks upon separators, or with the marks themselves take a longer way: an array of (gap, unit) matches, in which each looks at
its neighbours. Neither way shuffles or multiplies rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.chars import is_placeholder, simple_upper
from tokenloom.operators.casing import lowered
from tokenloom.options import CLOSE, FEATURE, OPEN, SPACER, SUBSTITUTES, Options

CONTROL = "\\x01-\\x1f\\uFEFF"
#: marks of boundaries: not told apart yet; a separator stood there; the right token joins the left one; the left one joins the right one. Noncharacters, which no text should hold
BOUND, APART, LEFT, RIGHT = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
ODD = f"{OPEN}|\\p{{Z}}\\p{{M}}|[{BOUND}-{RIGHT}]"
WORD = "[\\p{L}\\p{N}_]\\p{M}*"


def covers(o: Options) -> bool:
    """Whether these options have a native form. Placeholders are read in all of them."""
    never = o.case_markup or o.segment_case or o.segment_alphabet or o.segment_alphabet_change or o.allow_isolated_marks or o.support_prior_joiners or o.lang
    if o.mode in ("space", "none"):
        never = never or o.joiner_annotate or o.spacer_annotate or o.case_feature
    return not never


def _unit(o: Options) -> str:
    sign = f"[^\\p{{Z}}{CONTROL}]\\p{{M}}*"
    control = f"[{CONTROL}]"
    held = f"{OPEN}[^{CLOSE}]*(?:{CLOSE}|\\z)"
    spaced = "\\p{Z}\\p{M}+"
    if o.mode == "conservative":
        # a hyphen, or a point or comma before a letter, also begins a word where a placeholder has just ended
        ended = f"(?<={OPEN}[^{CLOSE}]{{1,255}}{CLOSE})(?:-\\p{{M}}*|[.,]\\p{{M}}*(?=[\\p{{L}}\\p{{N}}]))"
        word = f"(?:{WORD}|{ended})(?:{WORD}|-\\p{{M}}*|[.,]\\p{{M}}*(?=[\\p{{L}}\\p{{N}}])|{control})*"
        return f"{held}|{spaced}|{word}|{sign}"
    if o.mode == "aggressive":
        letters = f"\\p{{L}}\\p{{M}}*(?:\\p{{L}}\\p{{M}}*|{control})*"
        numbers = "\\p{N}\\p{M}*" if o.segment_numbers else f"\\p{{N}}\\p{{M}}*(?:\\p{{N}}\\p{{M}}*|{control})*"
        return f"{held}|{spaced}|{letters}|{numbers}|{sign}"
    return f"{held}|{spaced}|{sign}"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _neighbours(rows: Column) -> Column:
    """array<struct<x, before, after>>: each element with those beside it, null at the ends. (An inner lambda must not name an outer one's variable: Python UDFs could not take the result.)"""
    before = F.slice(F.concat(F.array(F.lit(None)), rows), F.lit(1), F.size(rows))
    pairs = F.zip_with(rows, before, lambda x, b: F.struct(x.alias("x"), b.alias("before")))
    return F.zip_with(pairs, F.slice(rows, F.lit(2), F.size(rows)), lambda p, a: F.struct(p["x"].alias("x"), p["before"].alias("before"), a.alias("after")))


def _first(text: Column) -> Column:
    return F.split(text, "\\x00", 2)[0]  # a text ends at its first NUL


def _substituted(text: Column, o: Options) -> Column:
    return text if o.no_substitution else F.translate(text, "".join(SUBSTITUTES), "".join(SUBSTITUTES.values()))


def _escaped(text: Column, o: Options) -> Column:
    if o.no_substitution:
        return text
    parts = F.transform(F.regexp_extract_all(text, F.lit("(?s)\\p{Z}|[^\\p{Z}]+"), F.lit(0)), lambda p: F.when(p.rlike("^\\p{Z}$"), F.concat(F.lit("％"), F.lpad(F.lower(F.hex(F.ascii(p))), 4, "0"))).otherwise(p))
    return F.array_join(parts, "")


def lexemes(text: Column, o: Options) -> Column:
    """array<struct<kind, surface, glued>> of the modes that look at characters; a separator run is a lexeme with with_separators."""
    gap = f"(?:[{CONTROL}]|\\p{{Z}}(?!\\p{{M}}))*"
    unit = _unit(o)
    pattern = f"{gap}(?:{unit})" if not o.with_separators else f"\\p{{Z}}+(?!\\p{{M}})|[{CONTROL}]*(?:{unit})"
    found = F.regexp_extract_all(_first(text), F.lit(pattern), F.lit(0))

    def lexeme(match: Column) -> Column:
        body = F.regexp_replace(match, f"^{gap}", "") if not o.with_separators else F.regexp_replace(match, f"^[{CONTROL}]*", "")
        held = body.startswith(OPEN)
        combined = body.rlike("^\\p{Z}\\p{M}")
        kind = F.when(held, "placeholder").when(body.rlike("^\\p{Z}+$"), "separator")
        if o.mode == "conservative":
            kind = kind.when(body.rlike("^[\\p{L}\\p{N}_]|^[-.,]\\p{M}*[^\\p{M}]"), "word")
        elif o.mode == "aggressive":
            kind = kind.when(body.rlike("^\\p{L}"), "word").when(body.rlike("^\\p{N}"), "number")
        clean = F.regexp_replace(body, f"[{CONTROL}]", "")
        surface = F.when(held | combined, _escaped(clean, o)).when(body.rlike("^\\p{Z}+$"), clean).otherwise(_substituted(clean, o))
        return F.struct(kind.otherwise("sign").alias("kind"), surface.alias("surface"), (~match.rlike(f"^[{CONTROL}]*\\p{{Z}}(?!\\p{{M}})")).alias("apart"))

    return F.transform(found, lexeme)


def annotated(lex: Column, o: Options) -> Column:
    """array<struct<surface, join_left, join_right, preserve>> of lexemes."""

    def flags(rows: Column) -> Column:
        def one(p: Column) -> Column:
            x, before, after = p["x"], p["before"], p["after"]
            glued = before.isNotNull() & x["apart"] & (before["kind"] != "separator") & (x["kind"] != "separator")
            next_glued = after.isNotNull() & after["apart"] & (x["kind"] != "separator") & (after["kind"] != "separator")
            left = glued & ((x["kind"] == "sign") | ((x["kind"] == "number") & (before["kind"] == "word")) | ((x["kind"] == "placeholder") & before["kind"].isin("word", "number")))
            takes = (after["kind"] == "word") | ((after["kind"] == "number") & (x["kind"] != "word")) | ((after["kind"] == "placeholder") & x["kind"].isin("sign", "placeholder"))
            digits = F.lit(o.segment_numbers and o.preserve_segmented_tokens) & (x["kind"] == "number") & (after["kind"] == "number")
            marks = F.lit(o.preserve_segmented_tokens) & (x["kind"] == "sign") & x["surface"].rlike("^\\p{M}")
            keep = (F.lit(o.preserve_placeholders) & (x["kind"] == "placeholder") & x["surface"].endswith(CLOSE)) | F.coalesce(digits & next_glued, F.lit(False)) | F.coalesce(marks & glued, F.lit(False))
            return F.struct(x["surface"].alias("surface"), F.coalesce(left, F.lit(False)).alias("join_left"), F.coalesce(next_glued & takes, F.lit(False)).alias("join_right"), keep.alias("preserve"))

        return F.transform(_neighbours(rows), one)

    def hyphens(rows: Column) -> Column:
        """A hyphen right after a placeholder is a word."""

        def one(p: Column) -> Column:
            x = p["x"]
            word = p["before"].isNotNull() & x["apart"] & (x["kind"] == "sign") & x["surface"].startswith("-") & (p["before"]["kind"] == "placeholder")
            return F.struct(F.when(word, "word").otherwise(x["kind"]).alias("kind"), x["surface"].alias("surface"), x["apart"].alias("apart"))

        return F.transform(_neighbours(rows), one)

    return _let(_let(lex, hyphens) if o.mode == "conservative" else lex, flags)


def strings(marked: Column, o: Options) -> Column:
    """array<string>: the tokens with their joiners or spacers."""

    def made(rows: Column) -> Column:
        def one(p: Column) -> Column:
            t, before = p["x"], p["before"]
            if o.joiner_annotate:
                pre = F.when(t["join_left"] & before.isNotNull(), F.lit(o.joiner)).otherwise("")
                post = F.when(t["join_right"] & p["after"].isNotNull(), F.lit(o.joiner)).otherwise("")
                apart = F.lit(o.joiner_new) | t["preserve"]
            else:
                pre = F.when(before.isNotNull() & ~t["join_left"] & ~before["join_right"], F.lit(SPACER)).otherwise("")
                post = F.lit("")
                apart = F.lit(o.spacer_new) | t["preserve"]
            return F.when(apart, F.array(pre, t["surface"], post)).otherwise(F.array(F.concat(pre, t["surface"], post)))

        return F.filter(F.flatten(F.transform(_neighbours(rows), one)), lambda s: s != "")

    return _let(marked, made)


CONTROLS = "".join(map(chr, range(1, 32))) + "\ufeff"


def _bounded(text: Column, o: Options) -> Column:
    """array<string>: the tokens of a text without ODD, with their joiners or spacers."""
    t = F.regexp_replace(text, f"(?>{_unit(o)})", f"$0{BOUND}")
    t = F.regexp_replace(F.translate(t, CONTROLS, ""), "^\\p{Z}+", "")
    t = F.regexp_replace(t, f"{BOUND}(?:\\p{{Z}}+|\\z)", APART)
    if o.mode == "aggressive":
        t = F.regexp_replace(t, f"(\\p{{L}}\\p{{M}}*){BOUND}(?=\\p{{N}})", f"$1{LEFT}")
        t = F.regexp_replace(t, f"{BOUND}(?=[\\p{{L}}\\p{{N}}])", RIGHT)
    elif o.mode == "conservative":
        t = F.regexp_replace(t, f"{BOUND}(?=[\\p{{L}}\\p{{N}}_])", RIGHT)
    source, target = ("", "") if o.no_substitution else ("".join(SUBSTITUTES), "".join(SUBSTITUTES.values()))
    t = F.translate(t, source + BOUND, target + LEFT)
    if o.joiner_annotate:
        t = F.replace(t, F.lit(LEFT), F.lit(APART + o.joiner + APART * o.joiner_new))
        t = F.replace(t, F.lit(RIGHT), F.lit(APART * o.joiner_new + o.joiner + APART))
    else:
        t = F.translate(F.replace(t, F.lit(APART), F.lit(APART + SPACER + APART * o.spacer_new)), LEFT + RIGHT, APART + APART)
        t = F.regexp_replace(t, f"{APART}{SPACER}{APART * o.spacer_new}\\z", "")  # nothing follows the last boundary
    return F.filter(F.split(t, APART), lambda x: x != "")


def _plain(text: Column, o: Options) -> Column:
    """Tokens without marks between them: units alone, each cleaned by one translation."""
    unit = f"\\p{{Z}}+(?!\\p{{M}})|{_unit(o)}" if o.with_separators else _unit(o)
    source, target = ("", "") if o.no_substitution else ("".join(SUBSTITUTES), "".join(SUBSTITUTES.values()))

    def clean(x: Column) -> Column:
        kept = F.when(x.startswith(OPEN) | x.rlike("^\\p{Z}\\p{M}"), _escaped(F.translate(x, CONTROLS, ""), o))
        return kept.otherwise(F.translate(x, source + CONTROLS, target))

    return F.filter(F.transform(F.regexp_extract_all(_first(text), F.lit(unit), F.lit(0)), clean), lambda s: s != "")


def tokens(text: Column, o: Options) -> Column:
    """array<string>; in lower case with case_feature, whose values line() adds."""
    made = _tokens(text, o)
    return F.transform(case_features(made), lambda x: x["token"]) if o.case_feature else made


def _tokens(text: Column, o: Options) -> Column:
    if o.mode == "none":
        pieces = F.regexp_extract_all(_first(text), F.lit(f"(?s){OPEN}.*?(?:{CLOSE}|\\z)|[^{OPEN}]+"), F.lit(0))
        return F.transform(pieces, lambda p: F.when(p.startswith(OPEN), _escaped(p, o)).otherwise(_substituted(p, o)))
    if o.mode == "space":
        pieces = F.regexp_extract_all(_first(text), F.lit(f"(?s){OPEN}.*?(?:{CLOSE}|\\z)|[^{OPEN}\\p{{Z}}]+"), F.lit(0))
        plain = F.transform(pieces, lambda p: F.when(p.startswith(OPEN), _escaped(p, o)).otherwise(_substituted(F.regexp_replace(p, "￨.*$", ""), o)))
        return F.filter(plain, lambda p: p != "")
    if not (o.joiner_annotate or o.spacer_annotate):
        return _plain(text, o)
    marked = strings(annotated(lexemes(text, o), o), o)
    if o.with_separators or o.preserve_segmented_tokens:
        return marked
    return F.when(text.rlike(ODD), marked).otherwise(_bounded(_first(text), o))


def line(text: Column, o: Options, delimiter: str = " ") -> Column:
    if o.case_feature:
        return F.array_join(F.transform(case_features(_tokens(text, o)), lambda x: F.concat(x["token"], F.lit(FEATURE), x["casing"])), delimiter)
    return F.array_join(tokens(text, o), delimiter)


# case, as expressions over a column of tokens


def casing(token: Column) -> Column:
    """N, L, U, C or M: the casing of a token's letters."""
    letters = F.regexp_replace(token, "\\P{L}", "")
    return (
        F.when(~letters.rlike("[\\p{Lu}\\p{Ll}]"), "N").when(letters.rlike("^\\p{Ll}+$"), "L").when(letters.rlike("^\\p{Lu}$|^\\p{Lu}[^\\p{Lu}]\\p{Ll}*$"), "C").when(letters.rlike("^\\p{Lu}{2,}$"), "U").otherwise("M")
    )


#: characters whose full upper case is several characters, with the one character of their simple mapping
LONGER = {c: simple_upper(c) for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1}


def lowercase(token: Column, lang: str = "") -> Column:
    """Lower case, character by character: no final sigma, and one character for a dotted capital I. With a language, by its collation's rules."""
    return F.collate(F.lower(F.collate(token, lang)), "UTF8_BINARY") if lang else F.lower(F.translate(token, "Σİ", "σi"))


def uppercase(token: Column, lang: str = "") -> Column:
    """Upper case, character by character: what would become several characters takes its simple mapping, or stays."""
    if lang:
        return F.collate(F.upper(F.collate(token, lang)), "UTF8_BINARY")
    table = F.create_map(*(F.lit(x) for pair in LONGER.items() for x in pair))
    each = F.transform(F.split(token, ""), lambda c: F.coalesce(F.element_at(table, c), F.upper(c)))
    return F.when(token.rlike(f"[{''.join(LONGER)}]"), F.array_join(each, "")).otherwise(F.upper(token))


def restore_casing(token: Column, code: Column, lang: str = "") -> Column:
    """A token by its casing code; mixed casing raises."""
    head = F.when(lowercase(F.substring(token, 1, 2)) == "ij", F.concat(F.lit("IJ"), F.substring(token, F.lit(3), F.char_length(token)))) if lang == "nl" else F.when(F.lit(False), F.lit(""))
    title = F.coalesce(head, F.concat(uppercase(F.substring(token, 1, 1), lang), F.substring(token, F.lit(2), F.char_length(token))))
    return F.when(code == "C", title).when(code == "U", uppercase(token, lang)).when(code == "M", F.raise_error(F.lit("a token of mixed casing has lost its capitals")).cast("string")).otherwise(token)


def case_features(toks: Column) -> Column:
    """array<struct<token, casing>>: lower-case tokens and the casing they had; placeholders stay."""
    return F.arrow_udf(_cased, "array<struct<token: string, casing: string>>")(toks)


def _cased(lists: pa.Array) -> pa.Array:
    """case_features() of a batch, each different token once."""
    words = lists.flatten().dictionary_encode()
    made = [(w, "N") if is_placeholder(w) else lowered(w) for w in words.dictionary.to_pylist()]
    both = pa.StructArray.from_arrays([pa.array([a for a, _ in made], pa.string()), pa.array([str(getattr(b, "value", b)) for _, b in made], pa.string())], names=["token", "casing"])
    edges = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), both.take(words.indices), mask=lists.is_null() if lists.null_count else None)


# the way back


def join_flags(toks: Column, o: Options) -> Column:
    """array<struct<surface, join_left, join_right, place>> of token strings; empty ones are left out."""

    def one(t: Column, i: Column) -> Column:
        if o.spacer_annotate:
            body, left, right = F.when(t.startswith(SPACER), F.substring(t, F.lit(2), F.char_length(t))).otherwise(t), ~t.startswith(SPACER), F.lit(False)
        else:
            n = len(o.joiner)
            right, left = t.endswith(o.joiner), t.startswith(o.joiner)
            cut = F.when(right, F.substring(t, F.lit(1), F.char_length(t) - n)).otherwise(t)
            body = F.when(left, F.substring(cut, F.lit(n + 1), F.char_length(cut))).otherwise(cut)
        return F.struct(body.alias("surface"), left.alias("join_left"), right.alias("join_right"), i.alias("place"), t.alias("t"))

    return F.filter(F.transform(toks, one), lambda x: x["t"] != "")


def spaced(marked: Column, o: Options) -> Column:
    """array<struct<text, place, lead>>: each token's text, and the number of spaces (0 or 1) before it."""

    def made(rows: Column) -> Column:
        def one(p: Column) -> Column:
            x, before = p["x"], p["before"]
            lead = F.when(before.isNotNull() & F.lit(not o.with_separators) & ~x["join_left"] & ~before["join_right"], 1).otherwise(0)
            return F.struct(x["surface"].alias("text"), x["place"].alias("place"), lead.alias("lead"))

        return F.transform(_neighbours(rows), one)

    return _let(marked, made)


def detokenize(toks: Column, o: Options) -> Column:
    """Text of tokens without case markup and escapes."""
    marked = F.array_join(F.transform(spaced(join_flags(toks, o), o), lambda x: F.concat(F.repeat(F.lit(" "), x["lead"]), x["text"])), "")
    if o.with_separators:
        return marked
    # the tokens in one text, with marks between them: joins are where a joiner (or no spacer) stands at a mark
    t = F.array_join(F.filter(toks, lambda x: x != ""), APART)
    if o.spacer_annotate:
        plain = F.replace(F.replace(F.regexp_replace(t, f"^{SPACER}", ""), F.lit(APART + SPACER), F.lit(" ")), F.lit(APART), F.lit(""))
    else:
        j = re.escape(o.joiner)
        t = F.regexp_replace(t, f"(?<={j}){APART}|{APART}(?={j})", BOUND)
        plain = F.translate(F.regexp_replace(t, f"(?<=^|[{APART}{BOUND}]){j}|{j}(?=[{APART}{BOUND}]|\\z)", ""), APART + BOUND, " ")
    return F.when(F.exists(toks, lambda x: x.rlike(f"[{BOUND}{APART}]")), marked).otherwise(plain)


def ranges(toks: Column, o: Options, *, unicode: bool = False) -> Column:
    """array<struct<token, start, end>> of tokens that show, in bytes or code points; ends are included.

    Running sums over arrays of any length: whole Arrow batches at once (a fold in SQL would copy its growing array for every token).
    """
    return F.arrow_udf(running_ranges(o, unicode), "array<struct<token: int, start: bigint, end: bigint>>")(toks)


def range_totals(toks: Column, o: Options, *, unicode: bool = False) -> Column:
    """struct<n, starts, ends, last>: the number of ranges() of tokens, the sums of their starts and ends, and the last end; null where there are none."""
    ranged = running_ranges(o, unicode)

    def totals(rows: pa.Array) -> pa.Array:
        made = ranged(rows)
        edges = np.append(0, np.cumsum(made.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
        flat = made.flatten()
        n = np.diff(edges)
        ends = flat.field(2).to_numpy(zero_copy_only=False)
        sums = [np.diff(np.append(0, np.cumsum(flat.field(k).to_numpy(zero_copy_only=False)))[edges]) for k in (1, 2)]
        last = np.append(ends, 0)[np.maximum(edges[1:] - 1, 0)]
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (n, *sums, last)], names=["n", "starts", "ends", "last"], mask=pa.array(n == 0))

    return F.arrow_udf(totals, "struct<n: bigint, starts: bigint, ends: bigint, last: bigint>")(toks)


def running_ranges(o: Options, unicode: bool):
    def sizes(texts: pa.Array) -> np.ndarray:
        return (pc.utf8_length(texts) if unicode else pc.binary_length(texts)).to_numpy(zero_copy_only=False).astype(np.int64)

    def sums(rows: pa.Array) -> pa.Array:
        flat, edges = rows.flatten(), np.append(0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
        full = sizes(flat)
        held = full > 0  # empty tokens are left out, and join nothing
        mark = SPACER if o.spacer_annotate else o.joiner
        wide = len(mark) if unicode else len(mark.encode())
        left = pc.starts_with(flat, mark).to_numpy(zero_copy_only=False)
        right = np.zeros(len(flat), bool) if o.spacer_annotate else pc.ends_with(flat, mark).to_numpy(zero_copy_only=False)
        size = np.maximum(full - wide * (left.astype(np.int64) + right), 0)  # one mark may be both
        joined = ~left if o.spacer_annotate else left
        place = (np.arange(len(flat)) - np.repeat(edges[:-1], np.diff(edges)))[held]
        kept = np.append(0, np.cumsum(held))[edges]
        size, joined, right = size[held], joined[held], right[held]
        first = np.zeros(len(size) + 1, bool)
        first[kept[:-1]] = True
        lead = np.zeros(len(size), np.int64)
        lead[1:] = ~joined[1:] & ~right[:-1] & ~first[1:-1] & (not o.with_separators)
        end = np.append(0, np.cumsum(size + lead))
        stop = end[1:] - np.repeat(end[kept[:-1]], np.diff(kept))
        shows = size > 0
        made = pa.StructArray.from_arrays([pa.array(place[shows].astype(np.int32)), pa.array((stop - size)[shows]), pa.array((stop - 1)[shows])], names=["token", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(shows))[kept].astype(np.int32)), made, mask=rows.is_null() if rows.null_count else None)

    return sums
