"""Tokenization options: one frozen value, validated when it is made, shipped to workers by closure."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

JOINER, SPACER = "￭", "▁"
OPEN, CLOSE = "｟", "｠"
ESCAPE, FEATURE = "％", "￨"
#: fixed values: what special characters of the input are written as
SUBSTITUTES = {"▁": "_", "￭": "■", "￨": "│", "％": "%", "＃": "#", "：": ":"}
MODES = ("conservative", "aggressive", "char", "space", "none")
#: language codes that are in use though withdrawn from the standard
OLD_LANGUAGES = ("tl", "iw", "in", "ji", "mo", "sh")
#: two-letter ISO 639-1 codes
LANGUAGES = """aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv
ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl
nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh
yi yo za zh zu""".split()


def is_valid_language(lang: str) -> bool:
    """Whether lang begins with a known ISO 639 code (a region or script may follow)."""
    code = lang.replace("_", "-").split("-")[0].lower()
    return code in LANGUAGES or code in OLD_LANGUAGES


@dataclass(frozen=True)
class Options:
    mode: str = "conservative"
    lang: str = ""
    no_substitution: bool = False
    case_feature: bool = False
    case_markup: bool = False
    soft_case_regions: bool = False
    with_separators: bool = False
    allow_isolated_marks: bool = False
    joiner_annotate: bool = False
    joiner_new: bool = False
    joiner: str = JOINER
    spacer_annotate: bool = False
    spacer_new: bool = False
    preserve_placeholders: bool = False
    preserve_segmented_tokens: bool = False
    support_prior_joiners: bool = False
    segment_case: bool = False
    segment_numbers: bool = False
    segment_alphabet_change: bool = False
    segment_alphabet: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        from tokenloom.functions.chars import known_script

        put = lambda name, value: object.__setattr__(self, name, value)
        put("segment_alphabet", tuple(self.segment_alphabet or ()))
        put("joiner", self.joiner or JOINER)
        if self.mode not in MODES:
            raise ValueError(f"invalid tokenization mode: {self.mode}")
        wrong = [
            (self.case_markup and self.mode in ("none", "space"), 'case_markup option requires the tokenization mode "conservative", "aggressive" or "char"'),
            (self.case_feature and self.case_markup, "case_markup and case_feature options can't be set at the same time"),
            (self.joiner_annotate and self.spacer_annotate, "joiner_annotate and spacer_annotate can't be set at the same time"),
            (self.spacer_new and not self.spacer_annotate, "spacer_new options requires spacer_annotate"),
            (self.joiner_new and not self.joiner_annotate, "joiner_new options requires joiner_annotate"),
            (self.support_prior_joiners and len(self.joiner) != 1, "support_prior_joiners requires the joiner to be a single Unicode character"),
            (self.with_separators and (self.joiner_annotate or self.spacer_annotate), "with_separators can't be used with joiner_annotate or spacer_annotate"),
        ]
        for bad, why in wrong:
            if bad:
                raise ValueError(why)
        for name in self.segment_alphabet:
            if not known_script(name):
                raise ValueError(f"invalid Unicode script: {name}")
        if self.lang and not is_valid_language(self.lang):
            raise ValueError(f"lang argument must be a valid ISO language code: {self.lang}")
        if self.case_markup:
            put("segment_case", True)

    def with_(self, **changes) -> Options:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self) | {"segment_alphabet": list(self.segment_alphabet)}
