"""DuckDB SQL for the queries: independent formulations with RE2, ordinality and window functions."""

from __future__ import annotations

X = r"\x01-\x1f\x{FEFF}"
AHEAD = r"\x{E000}"  # marks a point or comma that a letter or number follows: RE2 has no look-ahead
CONSERVATIVE = rf"[\p{{L}}\p{{N}}_]\p{{M}}*(?:[\p{{L}}\p{{N}}_]\p{{M}}*|-\p{{M}}*|[.,]\p{{M}}*{AHEAD}|[{X}])*|[^\p{{Z}}\p{{L}}\p{{N}}_{X}{AHEAD}]\p{{M}}*"
AGGRESSIVE = rf"\p{{L}}\p{{M}}*(?:\p{{L}}\p{{M}}*|[{X}])*|\p{{N}}\p{{M}}*(?:\p{{N}}\p{{M}}*|[{X}])*|[^\p{{Z}}\p{{L}}\p{{N}}{X}]\p{{M}}*"
NUMBERS = AGGRESSIVE.replace(rf"\p{{N}}\p{{M}}*(?:\p{{N}}\p{{M}}*|[{X}])*", r"\p{N}\p{M}*")
CHAR = rf"[^\p{{Z}}{X}]\p{{M}}*"


def _marked(column: str = "text") -> str:
    return rf"regexp_replace({column}, '([.,]\p{{M}}*)([\p{{L}}\p{{N}}])', '\1' || chr(57344) || '\2', 'g')"


def _clean(x: str, substitute: bool = True) -> str:
    body = rf"regexp_replace({x}, '[{X}{AHEAD}]', '', 'g')"
    return f"translate({body}, '▁￭￨％＃：', '_■│%#:')" if substitute else body


def _list(unit: str, column: str = "text", substitute: bool = True) -> str:
    source = _marked(column) if unit is CONSERVATIVE or "E000" in unit else column
    return f"list_transform(regexp_extract_all({source}, '{unit}'), lambda x: {_clean('x', substitute)})"


def _lines(unit: str, **more) -> str:
    return f"SELECT doc_id, array_to_string({_list(unit, **more)}, ' ') AS tokens, CAST(len({_list(unit, **more)}) AS BIGINT) AS n_tokens FROM documents"


def _rows(unit: str, where: str = "documents", key: str = "doc_id") -> str:
    """One row for each lexeme: key, pos, kind, apart (a separator stands before it), s."""
    gap = rf"[{X}\p{{Z}}]*"
    return rf"""
    lex AS (SELECT {key}, unnest(m) AS x, generate_subscripts(m, 1) AS pos FROM (SELECT {key}, regexp_extract_all(text, '{gap}(?:{unit})') AS m FROM {where})),
    t AS (SELECT {key}, pos, {_clean("regexp_replace(x, '^" + gap + "', '')")} AS s, regexp_matches(x, '^[{X}]*\p{{Z}}') AS apart FROM lex),
    k AS (SELECT *, CASE WHEN regexp_matches(s, '^\p{{L}}') THEN 'w' WHEN regexp_matches(s, '^\p{{N}}') THEN 'n' ELSE 's' END AS kind FROM t),
    n AS (SELECT *, lag(kind) OVER p AS bk, lead(kind) OVER p AS ak, lead(apart) OVER p AS aa FROM k WINDOW p AS (PARTITION BY {key} ORDER BY pos)),
    f AS (SELECT {key}, pos, s, apart, bk IS NOT NULL AND NOT apart AND (kind = 's' OR (kind = 'n' AND bk = 'w')) AS l, ak IS NOT NULL AND NOT aa AND (ak = 'w' OR (ak = 'n' AND kind <> 'w')) AS r FROM n)"""


CHAR_ROWS = _rows(CHAR).replace(r"CASE WHEN regexp_matches(s, '^\p{L}') THEN 'w' WHEN regexp_matches(s, '^\p{N}') THEN 'n' ELSE 's' END", "'s'")
CONS_ROWS = _rows(CONSERVATIVE).replace("regexp_extract_all(text,", f"regexp_extract_all({_marked()},").replace(rf"'[{X}\p{{Z}}]*(?:", rf"'[{X}\p{{Z}}{AHEAD}]*(?:").replace(rf"'^[{X}\p{{Z}}]*'", rf"'^[{X}\p{{Z}}{AHEAD}]*'").replace(
    rf"'^[{X}]*\p{{Z}}'", rf"'^[{X}{AHEAD}]*\p{{Z}}'").replace(r"CASE WHEN regexp_matches(s, '^\p{L}') THEN 'w' WHEN regexp_matches(s, '^\p{N}') THEN 'n' ELSE 's' END", r"CASE WHEN regexp_matches(s, '^[\p{L}\p{N}_]') THEN 'w' ELSE 's' END")


def _agg(rows: str, parts: str) -> str:
    """Token lists of each document from the pieces (b, s, a) of its lexemes."""
    return f"""WITH {rows}, g AS (SELECT doc_id, pos, list_filter([{parts}], lambda q: q <> '') AS q FROM f), a AS (SELECT doc_id, flatten(list(q ORDER BY pos)) AS q FROM g GROUP BY doc_id)
    SELECT doc_id, coalesce(array_to_string(q, ' '), '') AS tokens, CAST(coalesce(len(q), 0) AS BIGINT) AS n_tokens FROM documents LEFT JOIN a USING (doc_id)"""


def _joined(j: str) -> str:
    return f"CASE WHEN l THEN '{j}' ELSE '' END || s || CASE WHEN r THEN '{j}' ELSE '' END"


FLAT = rf"trim(regexp_replace(regexp_replace(text, '[{X}]', '', 'g'), '\p{{Z}}+', ' ', 'g'))"
SPACED = "CASE WHEN pos > 1 AND NOT l AND NOT coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN '▁' ELSE '' END"
TOKENS = f"SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {_list(CONSERVATIVE)} AS t FROM documents)"
LETTERS = r"regexp_replace(token, '\P{L}', '', 'g')"
CASING = rf"""CASE WHEN NOT regexp_matches({LETTERS}, '[\p{{Lu}}\p{{Ll}}]') THEN 'N' WHEN regexp_full_match({LETTERS}, '\p{{Ll}}+') THEN 'L'
 WHEN regexp_full_match({LETTERS}, '\p{{Lu}}|\p{{Lu}}[^\p{{Lu}}]\p{{Ll}}*') THEN 'C' WHEN regexp_full_match({LETTERS}, '\p{{Lu}}{{2,}}') THEN 'U' ELSE 'M' END"""
MOST = "18446744073709551615"
COUNTED = "SELECT token, count(*) AS n, min((doc_id, pos)) AS first FROM tok GROUP BY token"
SPECIAL = f"SELECT 0 AS id, '<blank>' AS token, '{MOST}' AS frequency UNION ALL SELECT 1, '<unk>', '{MOST}'"


def _vocab(order: str, where: str = "") -> str:
    return f"WITH tok AS ({TOKENS}), c AS ({COUNTED}), v AS ({SPECIAL} UNION ALL SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) + 1 AS id, token, CAST(n AS VARCHAR) AS frequency FROM c {where}))"


V1000 = _vocab("n DESC, first") + ", w AS (SELECT id, token FROM v WHERE id < 1000)"
PAIRS = rf"""WITH words AS (SELECT word, count(*) AS n FROM (SELECT unnest({_list(AGGRESSIVE)}) AS word FROM documents) GROUP BY word),
 ch AS (SELECT word, n, regexp_extract_all(word, '.\p{{M}}*') AS c FROM words), p AS (SELECT n, unnest(range(1, len(c))) AS i, c FROM ch WHERE len(c) > 1),
 q AS (SELECT c[i] AS "left", c[i + 1] || CASE WHEN i + 1 = len(c) THEN '</w>' ELSE '' END AS "right", n FROM p)
 SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY 1, 2"""


def _spans(size: str) -> str:
    return f"""WITH tok AS ({TOKENS}), s AS (SELECT doc_id, pos, {size} AS z FROM tok), r AS (SELECT doc_id, z, coalesce(sum(z + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
    SELECT doc_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS starts, CAST(sum(b + z - 1) AS BIGINT) AS ends, CAST(max(b + z - 1) AS BIGINT) AS last FROM r GROUP BY doc_id"""


# what the state machine adds: case, scripts, markup

CASED = rf"\p{{Lu}}\p{{M}}*[{X}]*\p{{Lu}}\p{{M}}*(?:\p{{Lu}}\p{{M}}*|[{X}])*|\p{{Lu}}\p{{M}}*(?:\p{{Ll}}\p{{M}}*|[{X}])*|\p{{Ll}}\p{{M}}*(?:\p{{Ll}}\p{{M}}*|[{X}])*"
SEGMENT_CASE = AGGRESSIVE.replace(rf"\p{{L}}\p{{M}}*(?:\p{{L}}\p{{M}}*|[{X}])*", CASED, 1)
CASE_PARTS = r"(?:\p{Lu}\p{M}*){2,}|\p{Lu}\p{M}*(?:\p{Ll}\p{M}*)*|(?:\p{Ll}\p{M}*)+|[^\p{L}]+"
CODE = r"CASE WHEN regexp_matches(s, '^\p{Lu}\p{M}*\p{Lu}') THEN 'U' WHEN regexp_matches(s, '^\p{Lu}') THEN 'C' WHEN regexp_matches(s, '^\p{Ll}') THEN 'L' ELSE 'N' END"
BEGIN_U, END_U, MODIFIER = "｟mrk_begin_case_region_U｠", "｟mrk_end_case_region_U｠", "｟mrk_case_modifier_C｠"
LETTER_RUN = rf"\p{{L}}\p{{M}}*[{X}]*"
OTHER_RUN = rf"(?:(?:[\p{{N}}_]\p{{M}}*|-\p{{M}}*|[.,]\p{{M}}*{AHEAD})[{X}]*)"
LATIN_CUT = rf"(?:{LETTER_RUN}|[\p{{N}}_]\p{{M}}*[{X}]*{OTHER_RUN}*{LETTER_RUN}|[\p{{N}}_]\p{{M}}*[{X}]*)(?:{OTHER_RUN}+(?:{LETTER_RUN})?)*|[^\p{{Z}}\p{{L}}\p{{N}}_{X}{AHEAD}]\p{{M}}*"
#: parts of conservative words that case cuts: doc_id, pos, sub, parts, s, l, r (joins of the word), p (one row for each part)
CUT_ROWS = CONS_ROWS + rf""", w AS (SELECT doc_id, pos, l, r, CASE WHEN kind = 'w' THEN regexp_extract_all(s, '{CASE_PARTS}') ELSE [s] END AS parts FROM (SELECT f.*, k.kind FROM f JOIN k USING (doc_id, pos))),
 c AS (SELECT doc_id, pos, generate_subscripts(parts, 1) AS sub, len(parts) AS parts, unnest(parts) AS s, l, r FROM w)"""


def _marked_up(prior: str, joined: str) -> str:
    """Tokens with hard case markup from rows c (doc_id, pos, sub, s) of prior; joined: each token's string."""
    return f"""WITH {prior}, m AS (SELECT *, {CODE} AS code FROM c),
    g AS (SELECT doc_id, pos, sub, list_filter([CASE code WHEN 'U' THEN '{BEGIN_U}' WHEN 'C' THEN '{MODIFIER}' END, {joined}, CASE code WHEN 'U' THEN '{END_U}' END], lambda q: q IS NOT NULL) AS q FROM m),
    a AS (SELECT doc_id, flatten(list(q ORDER BY pos, sub)) AS q FROM g GROUP BY doc_id)
    SELECT doc_id, coalesce(array_to_string(q, ' '), '') AS tokens, CAST(coalesce(len(q), 0) AS BIGINT) AS n_tokens FROM documents LEFT JOIN a USING (doc_id)"""


#: lower-case conservative tokens with spacers; a region of capitals begins at capitals or, before more of them, at a lone one, and lasts over numbers and what stands between capitals
SOFT = f"""WITH {CUT_ROWS}, n1 AS (SELECT *, {CODE} AS code, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS i, coalesce(lag(r) OVER p, false) AS br, CASE WHEN sub > 1 THEN true ELSE l END AS jl FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY pos, sub)),
 n2 AS (SELECT *, code = 'U' OR (code = 'C' AND length(s) = 1) AS big, lead(CASE WHEN code = 'N' THEN NULL ELSE (code = 'U' OR (code = 'C' AND length(s) = 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS cap FROM n1),
 n3 AS (SELECT *, big OR (code = 'N' AND (coalesce(cap, false) OR regexp_full_match(s, '\\p{{N}}+'))) AS goes, code = 'U' OR (big AND coalesce(cap, false)) AS starts FROM n2),
 n4 AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n3),
 n5 AS (SELECT *, goes AND coalesce(max(CASE WHEN goes AND starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY i ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM n4),
 n6 AS (SELECT *, coalesce(lag(inside AND TRUE) OVER w, false) AS was, coalesce(lead(inside) OVER w, false) AS will, lag(run) OVER w AS wrun, lead(run) OVER w AS nrun FROM n5 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 g AS (SELECT doc_id, i, list_filter([CASE WHEN inside AND NOT was THEN '{BEGIN_U}' WHEN NOT inside AND code = 'C' THEN '{MODIFIER}' END,
   CASE WHEN i > 1 AND NOT jl AND NOT br THEN '▁' ELSE '' END || lower(s), CASE WHEN inside AND NOT will THEN '{END_U}' END], lambda q: q IS NOT NULL) AS q FROM n6),
 a AS (SELECT doc_id, flatten(list(q ORDER BY i)) AS q FROM g GROUP BY doc_id)
 SELECT doc_id, coalesce(array_to_string(q, ' '), '') AS tokens, CAST(coalesce(len(q), 0) AS BIGINT) AS n_tokens FROM documents LEFT JOIN a USING (doc_id)"""

#: ranges in code points of aggressive tokens; those of one plain word (letters, numbers, low lines and hyphens after them) are one range
MERGED = rf"""WITH {_rows(AGGRESSIVE)}, z AS (SELECT doc_id, pos, s, length(s) AS n, l OR coalesce(lag(r) OVER w, false) AS joined, lag(s) OVER w AS b FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 e AS (SELECT *, sum(n + CASE WHEN pos > 1 AND NOT joined THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS last,
   CASE WHEN joined AND regexp_full_match(b || s, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}\p{{M}}_]*-?') THEN 0 ELSE 1 END AS cut FROM z),
 h AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM e)
 SELECT doc_id, pos - 1 AS token, CAST(min(last - n + 1) OVER (PARTITION BY doc_id, run) AS BIGINT) AS start, CAST(max(last) OVER (PARTITION BY doc_id, run) AS BIGINT) AS "end" FROM h"""

#: words as pieces, each between two spaces; every round joins the most frequent pair of neighbours, the smallest of equal ones
WORDS = rf"""words AS (SELECT word, count(*) AS n FROM (SELECT unnest({_list(AGGRESSIVE)}) AS word FROM documents) GROUP BY word)"""


def _merges(symbols: int) -> str:
    return rf"""WITH RECURSIVE {WORDS},
 ch AS (SELECT n, regexp_extract_all(word, '.\p{{M}}*') AS c FROM words),
 spelled AS (SELECT n, ' ' || array_to_string(c, '  ') || '</w> ' AS p FROM ch),
 steps(rank, p, n, l, r) AS (
  SELECT -1, p, n, '', '' FROM spelled
  UNION ALL
  SELECT rank + 1, replace(p, ' ' || l2 || '  ' || r2 || ' ', ' ' || l2 || r2 || ' '), n, l2, r2 FROM steps, (
   SELECT l2, r2 FROM (SELECT q[i] AS l2, q[i + 1] AS r2, n FROM (SELECT q, n, unnest(range(1, len(q))) AS i FROM (SELECT string_split(trim(p), '  ') AS q, n FROM steps) WHERE len(q) > 1))
   GROUP BY l2, r2 ORDER BY sum(n) DESC, l2, r2 LIMIT 1) AS best WHERE rank + 1 < {symbols}),
 merges AS (SELECT DISTINCT rank, l AS "left", r AS "right" FROM steps WHERE rank >= 0)"""


#: pieces of each different word: in every round the pair whose joint form has the lowest rank, the first of equal ones, becomes one piece
def _pieces(symbols: int) -> str:
    return _merges(symbols) + rf""",
 ranks AS (SELECT "left" || "right" AS made, min(rank) AS rank FROM merges GROUP BY 1),
 known AS (SELECT map(list(made), list(rank)) AS m FROM ranks),
 enc(word, q, spot, step) AS (
  SELECT word, q, spot, 0 FROM (SELECT word, q, list_position(k, list_min(k)) AS spot FROM (SELECT word, q, list_transform(range(1, len(q)), lambda i: coalesce(m[q[i] || q[i + 1]], 1000000)) AS k FROM (SELECT word, string_split(array_to_string(regexp_extract_all(word, '.\p{{M}}*'), '  ') || '</w>', '  ') AS q FROM words), known))
  UNION ALL
  SELECT word, q, CASE WHEN list_min(k) < 1000000 THEN list_position(k, list_min(k)) END, step + 1 FROM (SELECT word, q, step, list_transform(range(1, len(q)), lambda i: coalesce(m[q[i] || q[i + 1]], 1000000)) AS k FROM (
   SELECT word, step, list_concat(q[1:spot - 1], list_concat([q[spot] || q[spot + 1]], q[spot + 2:])) AS q FROM enc, known WHERE spot IS NOT NULL AND m[q[spot] || q[spot + 1]] IS NOT NULL), known)),
 cut AS (SELECT word, list_filter(list_transform(q, lambda x: regexp_replace(x, '</w>$', '')), lambda x: x <> '') AS q FROM (SELECT word, arg_max(q, step) AS q FROM enc GROUP BY word))"""


#: a private-use sign stands for the placeholder where tokens are found
HELD = AGGRESSIVE, "(SELECT doc_id, replace(text, '. ', '. ' || chr(57345)) AS text FROM documents)"
SHOWN = "replace(%s, chr(57345), '｟p％0020q｠')"


def _held(parts: str) -> str:
    return _agg(_rows(*HELD), parts).replace("coalesce(array_to_string(q, ' '), '') AS tokens, CAST(coalesce(len(q), 0) AS BIGINT) AS n_tokens", SHOWN % "coalesce(array_to_string(q, ' '), '')" + " AS tokens")


#: pieces outside the vocabulary, parted by the merge that made them until all are in it or were not merged: path orders the parts of a piece
RESTRICTED = _pieces(100) + rf""", {_rows(AGGRESSIVE)},
 splits AS (SELECT "left" || "right" AS made, arg_min("left", rank) AS a, arg_min("right", rank) AS b FROM merges GROUP BY 1),
 tok AS (SELECT doc_id, pos, i, q[i] AS core, l AND i = 1 AS lj, r OR i < len(q) AS rj, i = len(q) AS fin FROM (SELECT doc_id, pos, l, r, q, unnest(range(1, len(q) + 1)) AS i FROM f JOIN cut ON cut.word = f.s)),
 kinds AS (SELECT core, lj, rj, fin, count(*) AS n FROM tok GROUP BY ALL),
 vocabulary AS (SELECT CASE WHEN lj THEN '￭' ELSE '' END || core || CASE WHEN rj THEN '￭' ELSE '' END AS piece FROM kinds GROUP BY 1 HAVING sum(n) >= 200),
 parts(core, lj, rj, fin, path, c, cl, cr, cf) AS (
  SELECT core, lj, rj, fin, '', core, lj, rj, fin FROM kinds
  UNION ALL
  SELECT core, lj, rj, fin, path || side, CASE side WHEN '0' THEN a ELSE regexp_replace(b, '</w>$', '') END, cl AND side = '0', cr OR side = '0', cf AND side = '1'
   FROM parts JOIN splits ON splits.made = c || CASE WHEN cf THEN '</w>' ELSE '' END, (SELECT unnest(['0', '1']) AS side)
   WHERE CASE WHEN cl THEN '￭' ELSE '' END || c || CASE WHEN cr THEN '￭' ELSE '' END NOT IN (SELECT piece FROM vocabulary)),
 leaves AS (SELECT p.* FROM parts p WHERE NOT EXISTS (SELECT 1 FROM parts x WHERE (x.core, x.lj, x.rj, x.fin) = (p.core, p.lj, p.rj, p.fin) AND x.path = p.path || '0')),
 shown AS (SELECT core, lj, rj, fin, string_agg(CASE WHEN cl THEN '￭' ELSE '' END || c || CASE WHEN cr THEN '￭' ELSE '' END, ' ' ORDER BY path) AS t FROM leaves GROUP BY ALL)
 SELECT doc_id, coalesce(line, '') AS tokens FROM documents LEFT JOIN (SELECT doc_id, string_agg(t, ' ' ORDER BY pos, i) AS line FROM tok JOIN shown USING (core, lj, rj, fin) GROUP BY doc_id) USING (doc_id)"""

TYPE = r"CASE WHEN regexp_matches(ch, '\p{L}') THEN 'letter' WHEN regexp_matches(ch, '\p{M}') THEN 'mark' WHEN regexp_matches(ch, '\p{N}') THEN 'number' WHEN regexp_matches(ch, '\p{Z}') THEN 'separator' ELSE 'other' END"
CHARS = "SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents"

SQL = {
    "tok_conservative": _lines(CONSERVATIVE), "tok_aggressive": _lines(AGGRESSIVE), "tok_char": _lines(CHAR), "tok_segment_numbers": _lines(NUMBERS), "tok_no_substitution": _lines(CONSERVATIVE, substitute=False),
    "tok_space": r"SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\p{Z}'), lambda x: x <> '') AS t FROM documents)",
    "tok_none": "SELECT doc_id, text AS tokens, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS BIGINT) AS n_tokens FROM documents",
    "tok_with_separators": rf"SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM (SELECT doc_id, list_transform(regexp_extract_all({_marked()}, '\p{{Z}}+|{CONSERVATIVE}'), lambda x: {_clean('x')}) AS t FROM documents)",
    "tok_joiner": _agg(_rows(AGGRESSIVE), _joined("￭")), "tok_joiner_custom": _agg(_rows(AGGRESSIVE), _joined("@@")), "tok_joiner_conservative": _agg(CONS_ROWS, _joined("￭")),
    "tok_joiner_new": _agg(_rows(AGGRESSIVE), "CASE WHEN l THEN '￭' ELSE '' END, s, CASE WHEN r THEN '￭' ELSE '' END"),
    "tok_spacer": _agg(_rows(AGGRESSIVE) + f", f2 AS (SELECT *, {SPACED} AS b FROM f)", "b || s").replace("FROM f)", "FROM f)", 1).replace("AS q FROM f)", "AS q FROM f2)"),
    "tok_spacer_new": _agg(_rows(AGGRESSIVE) + f", f2 AS (SELECT *, {SPACED} AS b FROM f)", "b, s").replace("AS q FROM f)", "AS q FROM f2)"),
    "tok_char_spacer": _agg(CHAR_ROWS + f", f2 AS (SELECT *, {SPACED} AS b FROM f)", "b || s").replace("AS q FROM f)", "AS q FROM f2)"),
    "tok_conversations": f"SELECT conv_id, turn, CAST(len({_list(CONSERVATIVE)}) AS BIGINT) AS n_tokens FROM conversations",
    "tok_pages": f"SELECT page_id, CAST(len({_list(AGGRESSIVE, 'html')}) AS BIGINT) AS n_tokens, array_to_string({_list(AGGRESSIVE, 'html')}, ' ') AS tokens FROM pages",
    "tok_lines": f"SELECT doc_id, CAST(line - 1 AS INTEGER) AS line, array_to_string({_list(CONSERVATIVE)}, ' ') AS tokens FROM (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))",
    "token_objects": f"WITH {_rows(AGGRESSIVE)} SELECT doc_id, count(*) AS n, CAST(sum(l::INT) AS BIGINT) AS n_left, CAST(sum(r::INT) AS BIGINT) AS n_right, CAST(sum((pos - 1) * length(s)) AS BIGINT) AS weight FROM f GROUP BY doc_id",
    "detok_joiner": f"SELECT doc_id, {FLAT} AS text FROM documents", "detok_spacer": f"SELECT doc_id, {FLAT} AS text FROM documents", "detok_case_markup": f"SELECT doc_id, {FLAT} AS text FROM documents",
    "ranges_bytes": _spans("strlen(token)"), "ranges_unicode": _spans("length(token)"),
    "case_feature": f"WITH tok AS ({TOKENS}), c AS (SELECT doc_id, pos, lower(token) || '￨' || {CASING} AS x FROM tok) SELECT doc_id, coalesce(line, '') AS line FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS line FROM c GROUP BY doc_id) USING (doc_id)",
    "tok_case_feature": f"WITH tok AS ({TOKENS}), c AS (SELECT doc_id, pos, lower(token) || '￨' || {CASING} AS x FROM tok) SELECT doc_id, coalesce(line, '') AS line FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS line FROM c GROUP BY doc_id) USING (doc_id)",
    "case_histogram": f"WITH tok AS ({TOKENS}) SELECT {CASING} AS casing, count(*) AS n FROM tok GROUP BY 1",
    "case_restore": f"WITH tok AS ({TOKENS}), c AS (SELECT doc_id, pos, CASE WHEN {CASING} = 'M' THEN '?' ELSE token END AS x FROM tok) SELECT doc_id, coalesce(t, '') AS tokens FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t FROM c GROUP BY doc_id) USING (doc_id)",
    "char_types": f"SELECT {TYPE} AS type, CASE WHEN regexp_matches(ch, '\\p{{Lu}}') THEN 'upper' WHEN regexp_matches(ch, '\\p{{Ll}}') THEN 'lower' ELSE 'none' END AS \"case\", count(*) AS n FROM ({CHARS}) GROUP BY 1, 2",
    "char_functions": r"SELECT doc_id, length(text) AS n_chars, CAST(len(regexp_extract_all(text, '(?s).\p{M}*')) AS BIGINT) AS n_units, CAST(unicode(text) AS BIGINT) AS code, left(text, 1) AS ch, lpad(lower(to_hex(unicode(text))), 4, '0') AS hexed, CAST(len(list_filter(string_split(text, '. '), lambda x: x <> '')) AS BIGINT) AS pieces FROM documents",
    "char_alphabets": rf"SELECT CASE WHEN regexp_matches(ch, '\p{{N}}') THEN 'Numeric' WHEN regexp_matches(ch, '\p{{Latin}}') AND regexp_matches(ch, '\p{{L}}') THEN 'Latin' ELSE 'Other' END AS alphabet, count(*) AS n FROM ({CHARS}) WHERE NOT regexp_matches(ch, '[\p{{Z}}\p{{M}}{X}]') GROUP BY 1",
    "placeholder_filter": "SELECT doc_id % 2 = 0 AS held, count(*) AS n FROM documents GROUP BY 1",
    "vocab_build": _vocab("n DESC, first") + " SELECT id, token, frequency FROM v WHERE id < 500", "vocab_insertion_order": _vocab("first") + " SELECT id, token, frequency FROM v",
    "vocab_minimum_frequency": _vocab("n DESC, first", "WHERE n >= 20") + " SELECT id, token, frequency FROM v",
    "vocab_encode": V1000 + ", e AS (SELECT doc_id, pos, coalesce(w.id, 1) AS i FROM tok LEFT JOIN w USING (token)) SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN (SELECT doc_id, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY pos) AS ids FROM e GROUP BY doc_id) USING (doc_id)",
    "vocab_decode": _vocab("first") + ' SELECT id AS "index", token FROM v UNION ALL SELECT unnest([-1, -2]), \'<unk>\'',
    "vocab_lookup": V1000 + f", t AS (SELECT DISTINCT unnest({_list(CONSERVATIVE)}) AS token FROM conversations) SELECT token, coalesce(w.id, 1) AS id FROM t LEFT JOIN w USING (token)",
    "tok_placeholders": _held(_joined("￭")), "tok_placeholders_preserved": _held(f"CASE WHEN l THEN '￭' || CASE WHEN s = chr(57345) THEN ' ' ELSE '' END ELSE '' END || s || CASE WHEN r THEN CASE WHEN s = chr(57345) THEN ' ' ELSE '' END || '￭' ELSE '' END"),
    "detok_placeholders": "SELECT doc_id, " + SHOWN % FLAT.replace("text", "replace(text, '. ', '. ' || chr(57345))") + " AS text FROM documents",
    "tok_escapes": "SELECT doc_id, '｟' || replace(text, ' ', '％0020') || '｠' AS tokens FROM documents", "detok_escapes": "SELECT doc_id, text FROM documents",
    "char_simple_case": "SELECT doc_id, lower(text) AS lower, replace(upper(replace(text, 'ß', chr(57345))), chr(57345), 'ß') AS upper FROM documents",
    "distinct_tokens": f"SELECT lang, count(DISTINCT token) AS n FROM (SELECT lang, unnest({_list(CONSERVATIVE)}) AS token FROM documents) GROUP BY lang",
    "sql_functions": f"SELECT doc_id, CAST(len({_list(AGGRESSIVE)}) AS BIGINT) AS n, CAST(len({_list(AGGRESSIVE)}) AS INTEGER) AS n_tokens, {FLAT} AS text FROM documents",
    "io_files": f"SELECT {FLAT} AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY 1",
    "io_bpe_model": _merges(60) + ' SELECT CAST(rank AS INTEGER) AS rank, "left", "right" FROM merges',
    "io_bpe_dictionary": r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\p{Z}'), lambda x: x <> '')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)) GROUP BY word",
    "io_vocabulary_restriction": f"WITH tok AS ({TOKENS}) SELECT token, CAST(count(*) AS INTEGER) AS frequency FROM tok GROUP BY token HAVING count(*) >= 20",
    "bpe_vocabulary": RESTRICTED,
    "stream_windows": "WITH t AS (SELECT CAST(ts AS DATE) AS day, unnest(regexp_extract_all(event_type, '\\p{L}+|[^\\p{L}\\p{Z}]')) AS token FROM events) SELECT day, token, count(*) AS n FROM t WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2",
    "vocab_out_of": V1000 + " SELECT doc_id, count(*) AS n FROM tok WHERE token NOT IN (SELECT token FROM w) GROUP BY doc_id",
    "learn_word_counts": r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\p{Z}'), lambda x: x <> '')) AS word FROM documents) GROUP BY word",
    "learn_pair_counts": PAIRS, "learn_first_merge": PAIRS + ' ORDER BY n DESC, "left", "right" LIMIT 1',
    "corpus_rollup": f"SELECT lang, source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS chars FROM (SELECT lang, source, len({_list(CONSERVATIVE)}) AS n, length(text) AS c FROM documents) GROUP BY ROLLUP (lang, source)",
    "stream_tokens": f"SELECT doc_id, array_to_string({_list(CONSERVATIVE)}, ' ') AS tokens FROM documents",
    "stream_vocabulary": f"WITH tok AS ({TOKENS}) SELECT token, count(*) AS n FROM tok GROUP BY token",
    "tok_segment_case": _agg(_rows(SEGMENT_CASE), _joined("￭")), "tok_prior_joiners": _agg(_rows(AGGRESSIVE), _joined("￭")), "tok_segment_alphabet": _agg(CONS_ROWS.replace(CONSERVATIVE, LATIN_CUT), _joined("￭")),
    "tok_segment_alphabet_change": _agg(CONS_ROWS + r", f2 AS (SELECT f.doc_id, f.pos, CASE WHEN l THEN '￭' ELSE '' END || CASE WHEN kind = 'w' THEN array_to_string(regexp_extract_all(f.s, '(?:\p{L}\p{M}*)+|[^\p{L}]+'), ' ￭ ') ELSE f.s END || CASE WHEN r THEN '￭' ELSE '' END AS t FROM f JOIN k USING (doc_id, pos))", "t").replace("list_filter([t], lambda q: q <> '') AS q FROM f)", "string_split(t, ' ') AS q FROM f2)"),
    "tok_case_markup": _marked_up(_rows(SEGMENT_CASE) + ", c AS (SELECT doc_id, pos, 1 AS sub, s, l, r FROM f)", "CASE WHEN l THEN '￭' ELSE '' END || lower(s) || CASE WHEN r THEN '￭' ELSE '' END"),
    "tok_lang": _marked_up(CUT_ROWS, "CASE WHEN l THEN '￭' ELSE '' END || lower(s) || CASE WHEN r OR sub < parts THEN '￭' ELSE '' END"),
    "tok_soft_case_regions": SOFT, "ranges_merged": MERGED, "learn_bpe": _merges(60) + ' SELECT CAST(rank AS INTEGER) AS rank, "left", "right" FROM merges',
    "bpe_encode_words": _pieces(100) + rf" SELECT doc_id, CAST(sum(len(q)) AS BIGINT) AS n_pieces FROM (SELECT doc_id, unnest({_list(AGGRESSIVE)}) AS word FROM documents) JOIN cut USING (word) GROUP BY doc_id",
    "bpe_encode": _pieces(100) + f""", {_rows(AGGRESSIVE)}, j AS (SELECT doc_id, string_agg(CASE WHEN l THEN '￭' ELSE '' END || array_to_string(q, '￭ ') || CASE WHEN r THEN '￭' ELSE '' END, ' ' ORDER BY pos) AS line FROM f JOIN cut ON cut.word = f.s GROUP BY doc_id)
    SELECT doc_id, coalesce(line, '') AS tokens FROM documents LEFT JOIN j USING (doc_id)""",
    "io_line_round_trip": f"SELECT doc_id, CAST(len({_list(AGGRESSIVE)}) AS BIGINT) AS n FROM documents",
}
