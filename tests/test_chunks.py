import random

import pytest

import tokenloom as tl
from tokenloom.operators.annotate import write_line
from tokenloom.operators.chunks import Chunks
from tokenloom.options import Options

ATOMS = ["a", "be", "É", "B", "AB", "Ab", "ABC", "9", "23", "9A8", "A8", ".", ",", "-", "_", "!", " ", " ", " ", " ", "  ", "\n", "\t", "　", "́", "｟", "｠", "｟p q｠", "￭", "▁", "％", "字", "ー", "Б", "अ़", "Σ", "ǅ", "﷐", "\0"]
OPTIONS = [
    {"mode": "aggressive", "segment_case": True, "joiner_annotate": True}, {"mode": "aggressive", "case_markup": True, "joiner_annotate": True}, {"case_markup": True, "soft_case_regions": True, "spacer_annotate": True},
    {"case_markup": True, "soft_case_regions": True, "joiner_annotate": True}, {"segment_alphabet": ("Latin",), "joiner_annotate": True}, {"case_feature": True}, {"case_feature": True, "spacer_annotate": True},
    {"segment_alphabet_change": True, "allow_isolated_marks": True, "joiner_annotate": True, "preserve_segmented_tokens": True}, {"mode": "char", "spacer_annotate": True}, {"spacer_annotate": True, "spacer_new": True},
    {"mode": "aggressive", "support_prior_joiners": True, "joiner_annotate": True, "preserve_placeholders": True}, {"case_markup": True, "lang": "de", "joiner_annotate": True}, {"case_markup": True, "spacer_annotate": True},
    {"mode": "aggressive", "joiner_annotate": True}, {"mode": "aggressive", "joiner_annotate": True, "preserve_placeholders": True}, {"allow_isolated_marks": True, "joiner_annotate": True, "joiner_new": True},
]


@pytest.mark.parametrize("options", OPTIONS)
def test_chunks_equal_the_segmenter(options):
    rng = random.Random(7)
    t = tl.Loom(Options(**options))
    assert Chunks.fit(t.options)
    c, whole = Chunks(t), 0
    for _ in range(4000):
        text = "".join(rng.choice(ATOMS[: rng.choice((22, len(ATOMS)))]) for _ in range(rng.randrange(0, 16)))
        strings, features = t.tokenize(text)
        assert c.strings(text) == strings, repr(text)
        assert c.line(text) == (write_line(strings, features), len(strings)), repr(text)
        assert c.alphabets(text) == t.alphabets(text)
        whole += c._by_chunks(text, False) is not None
    assert whole > 1500


def test_chunks_are_cut_once(monkeypatch):
    """A worker segments a different chunk once, not each text letter by letter."""
    from tokenloom.operators import loom, segmenter

    seen = []
    monkeypatch.setattr(loom, "segment", lambda text, *more: seen.append(text) or segmenter.segment(text, *more))
    c = Chunks(tl.Loom("aggressive", joiner_annotate=True, case_markup=True, joiner="@@"))
    for _ in range(50):
        assert c.strings("Жук WORLD, soЖ.")[1] == "жук" and c.line("Жук WORLD, soЖ.")[1] == 10
    assert {x: seen.count(x) for x in set(seen)} == {"soЖ.": 1, "Жук": 1} and len(seen) == 2  # letters to ÿ don't come to the segmenter


def test_a_sign_after_one_capital_begins_a_token():
    """As in the SQL of tok_lang and tok_soft_case_regions."""
    t = tl.Loom(case_markup=True, lang="de", joiner_annotate=True)
    assert " ".join(t("A8ECF7 a-B_c")) == "｟mrk_case_modifier_C｠ a￭ 8￭ ｟mrk_begin_case_region_U｠ ecf￭ ｟mrk_end_case_region_U｠ 7 a￭ -￭ ｟mrk_case_modifier_C｠ b￭ _￭ c"
    assert t.detokenize(t("A8ECF7 a-B_c")) == "A8ECF7 a-B_c"
    t = tl.Loom(case_markup=True, soft_case_regions=True, spacer_annotate=True)
    assert " ".join(t("x A8b A8ECF")) == "x ｟mrk_case_modifier_C｠ ▁a 8 b ｟mrk_begin_case_region_U｠ ▁a 8 ecf ｟mrk_end_case_region_U｠"
