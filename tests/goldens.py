"""Fixed values: (options, text, token line, whether the line detokenizes to the text)."""

AGG, CONS, CHAR, SPACE, NONE = ({"mode": m} for m in ("aggressive", "conservative", "char", "space", "none"))
J, S = {"joiner_annotate": True}, {"spacer_annotate": True}
CASES = [
    ({}, "", "", True),
    ({}, "a b", "a b", False),
    ({}, "Your Hardware-Enablement Stack (HWE) is supported until April 2019.", "Your Hardware-Enablement Stack ( HWE ) is supported until April 2019 .", False),
    (NONE, "Hello World!", "Hello World!", False),
    (NONE | J, "Hello:｟World｠!", "Hello:￭ ｟World｠￭ !", False),
    (NONE, "｟a b c｠", "｟a％0020b％0020c｠", False),
    (NONE | {"no_substitution": True}, "｟a b c｠", "｟a b c｠", False),
    (NONE | J | {"preserve_placeholders": True}, "Hello:｟World｠!", "Hello:￭ ｟World｠ ￭ !", False),
    (NONE | J | {"preserve_segmented_tokens": True}, "Hello｟World｠!", "Hello ￭ ｟World｠ ￭ !", False),
    (SPACE, "49th meeting Social and human rights questions: human rights [14 (g)]", "49th meeting Social and human rights questions: human rights [14 (g)]", True),
    (SPACE, "  Hello   World ", "Hello World", False),
    (SPACE | J, "a｟b c｠ d", "a￭ ｟b％0020c｠ d", False),
    (SPACE | {"case_feature": True}, "Hello￨12￨AB world￨34￨CD", "hello￨12￨AB￨C world￨34￨CD￨L", False),
    (CHAR, "  Hello   World 123.", "H e l l o W o r l d 1 2 3 .", False),
    (CHAR | S, "  Hello   World 123.", "H e l l o ▁W o r l d ▁1 2 3 .", False),
    (CHAR | S | {"spacer_new": True}, "  Hello   World 123.", "H e l l o ▁ W o r l d ▁ 1 2 3 .", False),
    (AGG | J, "Isn't it so-greatly working?", "Isn ￭'￭ t it so ￭-￭ greatly working ￭?", True),
    (AGG | J, "MP3", "MP ￭3", True),
    (AGG | J, "A380", "A ￭380", True),
    (AGG | J, "$1", "$￭ 1", True),
    (SPACE | J | {"support_prior_joiners": True, "preserve_placeholders": True}, "It is a test-aggressive ￭'￭ with pre￭ tokenizat ￭ions World￭ 123 and double ￭｟mrk_place｠｟mrk_holder｠￭ .", "It is a test-aggressive ￭'￭ with pre￭ tokenizat ￭ions World￭ 123 and double ￭ ｟mrk_place｠ ￭ ｟mrk_holder｠ ￭ .", False),
    (AGG | J | {"support_prior_joiners": True}, "It is a test-aggressive ￭'￭ with pre￭ tokenizat ￭ions World￭ 123.", "It is a test ￭-￭ aggressive ￭'￭ with pre￭ tokenizat ￭ions World￭ 123 ￭.", False),
    (AGG | J | {"support_prior_joiners": True}, "｟a￭b｠", "｟a￭b｠", False),
    (AGG | S, "Isn't it so-greatly working?", "Isn ' t ▁it ▁so - greatly ▁working ?", True),
    (AGG | S, "MP3", "MP 3", True),
    (AGG | S | {"spacer_new": True}, "Isn't it so-greatly working?", "Isn ' t ▁ it ▁ so - greatly ▁ working ?", True),
    *[(m | J, a, b, True) for m in (CONS, AGG) for a, b in [("｟1,023｠km", "｟1,023｠￭ km"), ("A｟380｠", "A ￭｟380｠"), ("｟1,023｠｟380｠", "｟1,023｠￭ ｟380｠"), ("｟1023｠.", "｟1023｠ ￭."), ("$｟0.23｠", "$￭ ｟0.23｠"), ("｟0.23｠$", "｟0.23｠ ￭$"), ("｟US$｠23", "｟US$｠￭ 23"), ("1｟ABCD｠0", "1 ￭｟ABCD｠￭ 0")]],
    *[(J | {"preserve_placeholders": True}, a, b, True) for a, b in [("｟1,023｠km", "｟1,023｠ ￭ km"), ("A｟380｠", "A ￭ ｟380｠"), ("｟1,023｠｟380｠", "｟1,023｠ ￭ ｟380｠"), ("｟1023｠.", "｟1023｠ ￭."), ("$｟0.23｠", "$￭ ｟0.23｠"), ("｟US$｠23", "｟US$｠ ￭ 23"), ("1｟ABCD｠0", "1 ￭ ｟ABCD｠ ￭ 0")]],
    *[(S | {"preserve_placeholders": True}, a, b, True) for a, b in [("｟1,023｠km", "｟1,023｠ km"), ("A ｟380｠", "A ▁ ｟380｠"), ("｟1,023｠ ｟380｠", "｟1,023｠ ▁ ｟380｠"), ("｟1023｠.", "｟1023｠ ."), ("｟1023｠ .", "｟1023｠ ▁.")]],
    *[(J | {"joiner_new": True}, a, b, True) for a, b in [("｟1,023｠km", "｟1,023｠ ￭ km"), ("A｟380｠", "A ￭ ｟380｠"), ("｟1023｠.", "｟1023｠ ￭ .")]],
    ({}, "test￭ protect￨, ：, ▁, and ％ or ＃...", "test ■ protect │ , : , _ , and % or # . . .", False),
    ({}, "｟tag：value with spaces｠", "｟tag：value％0020with％0020spaces｠", False),
    ({"no_substitution": True}, "test￭ protect￨, ：, ▁, and ％ or ＃...", "test ￭ protect ￨ , ： , ▁ , and ％ or ＃ . . .", False),
    (SPACE | J, "It is a test-aggressive ■'■ with pre￭ tokenizat ■ions ｟entity＃1：World￭｠ 123.", "It is a test-aggressive ■'■ with pre■ tokenizat ■ions ｟entity＃1：World￭｠ 123.", False),
    (J, "👨‍👩‍👦", "👨 ￭‍ ￭👩 ￭‍ ￭👦", True),
    (J, "वर्तमान लिपि (स्क्रिप्ट) खो जाएगी।", "वर्तमान लिपि (￭ स्क्रिप्ट ￭) खो जाएगी ￭।", True),
    (J, "b ̇c", "b ￭％0020̇￭ c", True),
    (J | {"allow_isolated_marks": True}, "b ̇c", "b ̇￭ c", True),
    (S, "b ̇c", "b ％0020̇ c", True),
    (J | {"preserve_placeholders": True}, "｟a｠ׂb", "｟a｠ ￭ׂ￭ b", True),
    (AGG | {"segment_alphabet_change": True}, "rawБ", "raw Б", False),
    (J | {"case_feature": True}, "test \\\\\\\\a Capitalized lowercased UPPERCASÉ miXêd - cyrillic-Б", "test￨L \\￨N ￭\\￨N ￭\\￨N ￭\\￭￨N a￨L capitalized￨C lowercased￨L uppercasé￨U mixêd￨M -￨N cyrillic-б￨M", False),
    (AGG | J | {"case_feature": True, "joiner_new": True}, "a-b.", "a￨L ￭￨N -￨N ￭￨N b￨L ￭￨N .￨N", False),
    (S | {"case_feature": True, "spacer_new": True}, "a b", "a￨L ▁￨N b￨L", False),
    *[(J | {"case_markup": True}, a, b, True) for a, b in [
        ("Hello world!", "｟mrk_case_modifier_C｠ hello world ￭!"),
        ("HELLO WORLD!", "｟mrk_begin_case_region_U｠ hello ｟mrk_end_case_region_U｠ ｟mrk_begin_case_region_U｠ world ｟mrk_end_case_region_U｠ ￭!"),
        ("Hello WOrld!", "｟mrk_case_modifier_C｠ hello ｟mrk_begin_case_region_U｠ wo￭ ｟mrk_end_case_region_U｠ rld ￭!"),
        ("hello woRlD!", "hello wo￭ ｟mrk_case_modifier_C｠ rl￭ ｟mrk_case_modifier_C｠ d ￭!"),
        ("「我々は、うまくやっていることを証明した」とヒョンCEOは話す。", "「￭ 我々は ￭、￭ うまくやっていることを証明した ￭」￭ とヒョン￭ ｟mrk_begin_case_region_U｠ ceo￭ ｟mrk_end_case_region_U｠ は話す ￭。"),
    ]],
    *[(AGG | J | {"case_markup": True, "soft_case_regions": True}, a, b, True) for a, b in [
        ("AA.BB", "｟mrk_begin_case_region_U｠ aa ￭.￭ bb ｟mrk_end_case_region_U｠"), ("A BC", "｟mrk_begin_case_region_U｠ a bc ｟mrk_end_case_region_U｠"),
        ("AA.", "｟mrk_begin_case_region_U｠ aa ｟mrk_end_case_region_U｠ ￭."), ("A-B/C", "｟mrk_begin_case_region_U｠ a ￭-￭ b ￭/￭ c ｟mrk_end_case_region_U｠"),
        ("A-B/c", "｟mrk_begin_case_region_U｠ a ￭-￭ b ｟mrk_end_case_region_U｠ ￭/￭ c"), ("A", "｟mrk_case_modifier_C｠ a"), ("A-", "｟mrk_case_modifier_C｠ a ￭-"),
        ("ID: A23X52,", "｟mrk_begin_case_region_U｠ id ￭: a ￭23￭ x ￭52 ｟mrk_end_case_region_U｠ ￭,"),
        ("Show PP-LX-DP", "｟mrk_case_modifier_C｠ show ｟mrk_begin_case_region_U｠ pp ￭-￭ lx ￭-￭ dp ｟mrk_end_case_region_U｠"),
        ("AA ｟BB｠ CC", "｟mrk_begin_case_region_U｠ aa ｟mrk_end_case_region_U｠ ｟BB｠ ｟mrk_begin_case_region_U｠ cc ｟mrk_end_case_region_U｠"),
    ]],
    (S | {"case_markup": True}, "Hello WORLD!", "｟mrk_case_modifier_C｠ hello ｟mrk_begin_case_region_U｠ ▁world ｟mrk_end_case_region_U｠ !", True),
    (S | {"case_markup": True}, "hello woRld!", "hello ▁wo ｟mrk_case_modifier_C｠ rld !", True),
    ({"case_markup": True, "soft_case_regions": True, "lang": "el"}, "ΣΙΓΜΑ ΤΕΛΙΚΟΣ", "｟mrk_begin_case_region_U｠ σιγμα τελικος ｟mrk_end_case_region_U｠", False),
    (J | {"case_feature": True, "segment_case": True}, "WiFi", "wi￭￨C fi￨C", False),
    (AGG | J | {"segment_numbers": True}, "1984 mille neuf cent quatrevingt-quatre", "1￭ 9￭ 8￭ 4 mille neuf cent quatrevingt ￭-￭ quatre", True),
    (J | {"segment_alphabet": ["Han"]}, "rawБ", "rawБ", True),
    (J | {"segment_alphabet": ["Han"]}, "有入聲（dam）「揼」（dap），意思接近，區別在於-m同-p嘅轉換。", "有￭ 入￭ 聲 ￭（￭ dam ￭） ￭「￭ 揼 ￭」 ￭（￭ dap ￭） ￭，￭ 意￭ 思￭ 接￭ 近 ￭，￭ 區￭ 別￭ 在￭ 於-m同-p嘅￭ 轉￭ 換 ￭。", False),
    ({"segment_alphabet": ["Kangxi"]}, "12⼀⼁", "12 ⼀ ⼁", False),
    ({"segment_alphabet": ["Kanbun"]}, "12㆙㆚", "12 ㆙ ㆚", False),
    ({"segment_alphabet_change": True}, "「キャント・バイ・ミー・ラヴ」", "「 キャント ・ バイ ・ ミー ・ ラヴ 」", False),
    (J | {"segment_alphabet_change": True, "allow_isolated_marks": True}, "abc়", "abc ￭়", False),
    (J | {"segment_alphabet_change": True, "allow_isolated_marks": True}, "8ে", "8 ￭ে", False),
    (J | {"segment_alphabet_change": True, "allow_isolated_marks": True, "preserve_segmented_tokens": True}, "abc়", "abc ￭ ়", False),
    (AGG | J | {"segment_numbers": True, "preserve_segmented_tokens": True}, "1234", "1 ￭ 2 ￭ 3 ￭ 4", True),
    (J | {"segment_alphabet_change": True, "preserve_segmented_tokens": True}, "rawБ", "raw ￭ Б", True),
    (AGG | J | {"segment_alphabet": ["Han"], "segment_alphabet_change": True, "preserve_segmented_tokens": True}, "測試abc", "測 ￭ 試 ￭ abc", True),
    (J | {"segment_case": True, "preserve_segmented_tokens": True}, "WiFi", "Wi ￭ Fi", True),
    ({"with_separators": True}, "Hello World!", "Hello   World !", False),
]

DETOK = [
    ({}, ["a", "", "b"], "a b"),
    ({}, "要求从１４％降到２％，动员干部参加生产，向合作社看齐。".split(), "要求从１４％降到２％，动员干部参加生产，向合作社看齐。"),
    ({"case_markup": True}, "｟mrk_case_modifier_C｠ ｟abc｠".split(), "｟abc｠"),
    ({"case_markup": True}, "hello ｟mrk_case_modifier_C｠".split(), "hello"),
    ({"case_markup": True}, "｟mrk_case_modifier_C｠ ｟mrk_case_modifier_C｠ hello".split(), "Hello"),
    ({"case_markup": True}, "｟mrk_case_modifier_C｠ ｟mrk_begin_case_region_U｠ hello ｟mrk_end_case_region_U｠".split(), "HELLO"),
    ({"case_markup": True}, "｟mrk_begin_case_region_U｠ hello ｟mrk_case_modifier_C｠ world".split(), "HELLO World"),
    ({"case_markup": True}, "｟mrk_begin_case_region_U｠ ｟mrk_case_modifier_C｠ hello world ｟mrk_end_case_region_U｠".split(), "Hello WORLD"),
    ({"case_markup": True}, "｟mrk_begin_case_region_U｠ hello ｟mrk_case_modifier_C｠ ｟mrk_end_case_region_U｠ world".split(), "HELLO world"),
    (J | {"case_markup": True, "joiner_new": True}, "hello ｟mrk_case_modifier_C｠ ￭ world !".split(), "helloWorld !"),
    (S | {"case_markup": True, "spacer_new": True}, "hello ｟mrk_case_modifier_C｠ ▁ world !".split(), "hello World!"),
    (S | {"case_markup": True, "spacer_new": True}, "hello ｟mrk_case_modifier_C｠ ▁".split(), "hello "),
    ({"case_markup": True, "lang": "nl"}, "｟mrk_case_modifier_C｠ ijssel".split(), "IJssel"),
    ({"case_markup": True, "lang": "el"}, "｟mrk_begin_case_region_U｠ την άνοιξη , απρίλιο ή μάιο , θα καταναλώσω μεγαλύτερες ποσότητες πρωτεΐνης ｟mrk_end_case_region_U｠".split(), "ΤΗΝ ΑΝΟΙΞΗ , ΑΠΡΙΛΙΟ Ή ΜΑΪΟ , ΘΑ ΚΑΤΑΝΑΛΩΣΩ ΜΕΓΑΛΥΤΕΡΕΣ ΠΟΣΟΤΗΤΕΣ ΠΡΩΤΕΪΝΗΣ"),
    ({"with_separators": True}, ["Hello", " ", "World", "!"], "Hello World!"),
]
