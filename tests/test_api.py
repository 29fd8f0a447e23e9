import copy
import pickle
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tokenloom as tl
from tokenloom import cli
from tokenloom.functions import sql
from tokenloom.functions import text as T
from tokenloom.operators import vocab
from tokenloom.operators.annotate import read_line, write_line
from tokenloom.operators.bpe import read_vocabulary
from tokenloom.operators.learn import learn_merges, learn_merges_of, pair_counts
from tokenloom.sources import text_files
from tokenloom.streaming import lines


@pytest.mark.parametrize("options", [
    {"mode": "none", "case_markup": True}, {"case_feature": True, "case_markup": True}, {"joiner_annotate": True, "spacer_annotate": True}, {"spacer_new": True}, {"joiner_new": True},
    {"support_prior_joiners": True, "joiner": "@@"}, {"with_separators": True, "joiner_annotate": True}, {"segment_alphabet": ["Klingon"]}, {"lang": "xx"}, {"mode": "words"},
])
def test_wrong_options(options):
    with pytest.raises(ValueError):
        tl.Options(**options)


def test_tokens_as_objects():
    t = tl.Loom("aggressive", joiner_annotate=True, case_markup=True)
    made = t.tokenize("Hello WORLD!", as_token_objects=True)
    assert [(x.surface, x.casing) for x in made] == [("hello", tl.Casing.CAPITALIZED), ("world", tl.Casing.UPPERCASE), ("!", tl.Casing.NONE)] and made[2].join_left
    assert t.detokenize(made) == "Hello WORLD!" and sorted(t.detokenize_with_ranges(made)[1]) == [0, 1, 2]
    line, _ = t.serialize_tokens(made)
    assert line == ["｟mrk_case_modifier_C｠", "hello", "｟mrk_begin_case_region_U｠", "world", "｟mrk_end_case_region_U｠", "￭!"] and t.deserialize_tokens(line) == made
    assert pickle.loads(pickle.dumps(made[0])) == made[0] == copy.deepcopy(made[0]) and hash(made[0]) == hash(copy.copy(made[0])) and len(made[0]) == 5
    assert repr(tl.Token("a", join_left=True)) == "Token('a', join_left=True)"
    with pytest.raises(ValueError):
        tl.Loom().detokenize([tl.Token("a", casing=tl.Casing.MIXED)])
    with pytest.raises(RuntimeError):
        tl.Loom(case_feature=True).detokenize(["a"])
    assert copy.copy(t).options == t.options == tl.Loom(t).options and t.options.as_dict()["segment_case"]


def test_bpe_learner(tmp_path):
    t = tl.Loom("aggressive", joiner_annotate=True)
    learner = tl.BPELearner(t, symbols=2, min_frequency=1)
    learner.ingest("hello world")
    made = learner.learn(str(tmp_path / "m"))
    assert (tmp_path / "m").read_text() == "#version: 0.2\ne l\nel l\n" and made("hello") == ["h￭", "ell￭", "o"]
    learner = tl.BPELearner(t, symbols=2, min_frequency=1)
    learner.ingest_token("ab￭")
    learner.ingest_token(tl.Token("cd"))
    learner.learn(str(tmp_path / "n"))
    assert (tmp_path / "n").read_text() == "#version: 0.2\na b</w>\nc d</w>\n"
    learner = tl.BPELearner(t, symbols=2, min_frequency=1)
    learner.ingest("a b")
    with pytest.raises(RuntimeError, match="beside each other"):
        learner.learn(str(tmp_path / "o"))
    assert learn_merges({"aaaa": 3, "aab": 2}, 3, 1)[0] == ("a", "a")


def test_bpe_models():
    v2 = tl.BPE(["#version: 0.2", "a b", "ab c</w>"])
    assert v2.encode("abc") == ["abc"] and v2.encode("abd") == ["ab", "d"] and v2.encode("x") == ["x"]
    both = tl.BPE(["v3;true;true;false;<w>;</w>", "<w> a", "b </w>"])
    assert both.encode("ab") == ["a", "b"] and both.encode("cab") == ["c", "a", "b"]
    free = tl.BPE(["v3;false;true;true;<w>;</w>", "l e", "le </w>"])
    assert free.encode("LE") == ["LE"] and free.encode("Leb") == ["Le", "b"]
    none = tl.BPE(["a b"])
    assert none.encode("ab") == ["ab"]
    t = tl.Loom(tl.Options(joiner_annotate=True), encoder=tl.BPE(["#version: 0.2", "w e", "we l", "wel l", "l e</w>"]), vocabulary=["wel￭"])
    assert t("welle") == ["wel￭", "le"] or t("welle")[0] == "wel￭"
    assert tl.Loom("space", encoder=tl.BPE(["#version: 0.2", "a b"], dropout=1.0))("aab") == ["a", "a", "b"]
    with pytest.raises(ValueError):
        tl.BPE(["a b"], dropout=2)
    with pytest.raises(ValueError):
        tl.BPE("/nowhere")
    with pytest.raises(RuntimeError):
        tl.BPE(["#version: 0.7"])


def test_sentencepiece(tmp_path, spark):
    learner = tl.SentencePieceLearner(vocab_size=17, character_coverage=0.98)
    learner.ingest("hello word! how are you?")
    t = learner.learn(str(tmp_path / "sp"))
    assert t("hello") == ["▁h", "e", "l", "l", "o"] and t.detokenize(t("how are you")) == "how are you"
    again = tl.sentencepiece_loom(str(tmp_path / "sp"))
    df = spark.createDataFrame([("hello",), (None,)], "t string")
    assert [r["x"] for r in df.select(again.column("t").alias("x")).collect()] == [["▁h", "e", "l", "l", "o"], None]
    with pytest.raises(ValueError):
        tl.SentencePiece("/nowhere")


def test_sentencepiece_learns_from_all_texts(tmp_path, spark):
    """Every text of a table counts, as do texts beyond the trainer's limit of 4192 bytes; repeats are weights."""
    texts = [f"w{chr(97 + k % 26)} x{chr(97 + k // 26)}" for k in range(600)] + ["long " * 1500 + "Ω", "y" * 5000 + "Ж", None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    learner = tl.SentencePieceLearner(vocab_size=120, character_coverage=1.0, model_type="unigram", hard_vocab_limit=False).ingest_dataframe(table, "text")
    words = Counter(w for t in texts for w in (t or "").split())
    assert {r["word"]: r["n"] for r in learner.word_counts().collect()} == words
    t = learner.learn(str(tmp_path / "all.model"))
    pieces = {t.encoder.processor().IdToPiece(k) for k in range(t.encoder.processor().GetPieceSize())}
    assert {"Ω", "Ж"} <= pieces and all(chr(97 + k) in "".join(pieces) for k in range(24))


def test_vocab(spark, tmp_path):
    v = tl.build_vocab_from_lines(["a b b c", "c c <x>\n"], special_tokens=["<blank>", "<unk>"])
    assert v.ids_to_tokens == ["<blank>", "<unk>", "a", "b", "c", "<x>"] and v(["c", "q", ["a"]]) == [4, 1, [2]] and v.lookup_index(99) == "<unk>" and v.counters[4] == 3
    w = copy.deepcopy(v)
    w.resize(maximum_size=3)
    assert w.ids_to_tokens == ["<blank>", "<unk>", "c"] and len(v) == 6 and pickle.loads(pickle.dumps(w)).tokens_to_ids == w.tokens_to_ids
    w.resize(maximum_size=1)
    assert w.ids_to_tokens == ["<blank>", "<unk>"] and "c" not in w
    df = spark.createDataFrame([(1, "a b b c".split()), (2, "c c <x>".split()), (3, None), (4, [])], "k int, t array<string>").repartition(3)
    for limits in ({}, {"maximum_size": 4}, {"minimum_frequency": 2}):
        table = vocab.build_vocab(df, "t", ["k"], special_tokens=["<blank>", "<unk>"], **limits)
        want = tl.build_vocab_from_lines(["a b b c", "c c <x>"], special_tokens=["<blank>", "<unk>"], **limits)
        assert tl.Vocab.from_dataframe(table).ids_to_tokens == want.ids_to_tokens and tl.Vocab.from_dataframe(table).counters == want.counters
    table = vocab.build_vocab(df, "t", ["k"], special_tokens=["<blank>", "<unk>"]).cache()
    got = {r["k"]: r["ids"] for r in vocab.encode_ids(df, "t", table.filter("token <> 'a'")).collect()}
    assert got == {1: [1, 3, 3, 4], 2: [4, 4, 5], 3: None, 4: []}
    resized = vocab.resize(v.to_dataframe(spark), maximum_size=3)
    assert tl.Vocab.from_dataframe(resized).ids_to_tokens == ["<blank>", "<unk>", "c"]


def test_vocabulary_ids_are_dense_however_plans_are_cut(spark):
    """Sorted partitions that adaptive plans cut in other places, and rows that would be pruned."""
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "5k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.range(0, 6000, 1, 7).selectExpr("id as k", "array(concat('w', id % 4099), concat('x', id), null, 'the') as t")
        for limits in ({}, {"minimum_frequency": 1, "maximum_size": 9000}, {"minimum_frequency": 2}):
            rows = vocab.build_vocab(df.withColumn("t", F.expr("filter(t, x -> x is not null)")), "t", ["k"], special_tokens=["<unk>"], **limits).select("id", "token").collect()
            want = tl.build_vocab_from_tokens((w for k in range(6000) for w in (f"w{k % 4099}", f"x{k}", "the")), special_tokens=["<unk>"], **{"maximum_size": 0, "minimum_frequency": 1, **limits})
            assert [r["token"] for r in sorted(rows)] == want.ids_to_tokens and sorted(r["id"] for r in rows) == list(range(len(want)))
        by_text = vocab.build_vocab(df.selectExpr("cast(k as string) as k", "filter(t, x -> x is not null) as t"), "t", ["k"])
        assert sorted(r["id"] for r in by_text.select("id").collect()) == list(range(4099 + 6000 + 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_large_and_small_vocabularies_encode_alike(spark, monkeypatch):
    """Repeated rows, null and repeated keys, null tokens and arrays, columns named as the operator's own."""
    rows = [(1, ["a", "b"], 5), (1, ["c"], 5), (None, ["a"], 5), (1, ["c"], 5), (2, None, 5), (3, [], None), (4, ["z", None], 5)]
    df = spark.createDataFrame(rows, "number int, token array<string>, ids int").repartition(3)
    table = spark.createDataFrame([(0, "<unk>"), (1, "a"), (2, "b"), (3, "c")], "id long, token string")
    small = sorted(map(repr, vocab.encode_ids(df, "token", table, out="pos").collect()))
    monkeypatch.setattr(vocab, "SMALL", 1)
    large = vocab.encode_ids(df, "token", table, out="pos")
    assert large.columns == ["number", "token", "ids", "pos"] and sorted(map(repr, large.collect())) == small
    assert sorted((r["number"] or 0, r["pos"]) for r in large.collect() if r["number"] != 2) == [(0, [1]), (1, [1, 2]), (1, [3]), (1, [3]), (3, []), (4, [0, 0])]
    assert vocab.encode_ids(df, "token", table, out="ids").columns == df.columns


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "in").write_text("Hello world!\na b\n\nIt's.\n", encoding="utf-8")
    t = tl.Loom("aggressive", joiner_annotate=True)
    t.tokenize_file(str(tmp_path / "in"), str(tmp_path / "tok"), tokens_delimiter="++")
    assert (tmp_path / "tok").read_text(encoding="utf-8").split("\n")[0] == "Hello++world++￭!"
    t.detokenize_file(str(tmp_path / "tok"), str(tmp_path / "back"), tokens_delimiter="++")
    assert (tmp_path / "back").read_text(encoding="utf-8") == "Hello world!\na b\n\nIt's.\n"
    with pytest.raises(ValueError):
        t.tokenize_file("/nowhere", str(tmp_path / "x"))
    text_files.tokenize_text_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), t, ordered=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text(encoding="utf-8") == "Hello world ￭!\na b\n\nIt ￭'￭ s ￭.\n"
    text_files.detokenize_text_files(spark, str(tmp_path / "out"), str(tmp_path / "text"), t)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == sorted(["Hello world!", "a b", "", "It's."])
    assert read_line("a++++++b", "++") == (["a", "++", "b"], None) and read_line("a￨1 b￨2") == (["a", "b"], [["1", "2"]]) and write_line(["a", "b"], [["1", "2"]]) == "a￨1 b￨2"
    (tmp_path / "v").write_text("a 5\nb\t7\nc\n")
    assert read_vocabulary(str(tmp_path / "v"), 6) == ["b"]
    assert {(r["token"], r["frequency"]) for r in text_files.vocabulary_restriction(spark, str(tmp_path / "v"), 1).collect()} == {("a", 5), ("b", 7), ("c", 1)}
    (tmp_path / "d").write_text("x 2\n\ny 3\nx 4\n")
    assert {(r["word"], r["n"]) for r in text_files.bpe_dictionary(spark, str(tmp_path / "d")).collect()} == {("x", 6), ("y", 3)}
    (tmp_path / "m").write_text("#version: 0.2\na b\nab c\n")
    assert [tuple(r) for r in text_files.bpe_model(spark, str(tmp_path / "m")).orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "c")]


def test_command_line(tmp_path, spark, capsys):
    class Out(list):
        write = list.append

    out, back = Out(), Out()
    cli.main(["tokenize", "--mode", "aggressive", "--joiner_annotate"], ["Hello world!\n"], out)
    cli.main(["detokenize"], out, back)
    assert out == ["Hello world ￭!\n"] and back == ["Hello world!\n"]
    many, made = [f"line {k}, so!\n" for k in range(25_000)], Out()
    cli.main(["tokenize", "--mode", "aggressive", "--joiner_annotate", "--num_threads", "3", "-v"], many, made)
    assert made == [f"line {k} ￭, so ￭!\n" for k in range(25_000)] and capsys.readouterr().err.splitlines()[-1] == "25000 lines"
    (tmp_path / "lines").write_text("".join(many), encoding="utf-8")
    cli.main(["tokenize", "--mode", "aggressive", "--joiner_annotate", "--files", str(tmp_path / "lines"), str(tmp_path / "tokens")])
    assert "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "tokens").glob("part-*"))) == "".join(made)
    cli.main(["detokenize", "--files", str(tmp_path / "tokens"), str(tmp_path / "texts")])
    assert "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "texts").glob("part-*"))) == "".join(many)
    cli.main(["subword_learn", "-i", str(tmp_path / "lines"), "-o", str(tmp_path / "sp"), "--tmpfile", str(tmp_path / "spool"), "sentencepiece", "--option", "vocab_size=30", "--option", "hard_vocab_limit=false"])
    assert (tmp_path / "sp").exists() and not (tmp_path / "spool").exists()
    (tmp_path / "in").write_text("hello world")
    assert cli.main(["subword_learn", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "m"), "bpe", "-s", "2", "--min-frequency", "1"]) == 0
    assert (tmp_path / "m").read_text().startswith("#version: 0.2\n")


def test_streams_and_sql(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("b a b\nc!\n")
    t = tl.Loom()
    stream = lines.read_line_stream(spark, str(tmp_path / "in"))
    run = lines.running_vocabulary(stream, t).writeStream.format("memory").queryName("words").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from words").collect()} == {("a", 1), ("b", 2), ("c", 1), ("!", 1)}
    run = lines.tokenize_stream(stream, t).writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["line"] for r in spark.sql("select * from lines").collect()} == {"b a b", "c !"}
    sql.register(spark, tl.Loom("aggressive", joiner_annotate=True), "tl_")
    assert spark.sql("select tl_tokenize('Hi there!') t, tl_token_count('a b') n, tl_detokenize(array('a', '￭b')) d").first()[:] == (["Hi", "there", "￭!"], 2, "ab")
    assert [tuple(r)[:2] for r in spark.sql("select * from tl_tokens('a-b')").collect()] == [(0, "a"), (1, "-"), (2, "b")]


def test_character_columns(spark):
    rows = ["a", "é", "字", "\U0001f642", "1", " ", "́", "A"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = df.select("c", T.from_code_point(T.code_point("c")).alias("b"), T.char_type("c").alias("t"), T.char_case("c").alias("k"), T.from_hex(T.to_hex(T.code_point("c"))).alias("h")).collect()
    assert all(r["b"] == r["c"] and r["h"] == ord(r["c"]) for r in got)
    assert [r["t"] for r in got] == ["letter", "letter", "letter", "other", "number", "separator", "mark", "letter"] and got[-1]["k"] == "upper"
    assert df.filter("c = '字'").select(T.script_by_icu(T.code_point("c"))).first()[0] == "Han"


def test_pairs(spark):
    words = spark.createDataFrame([("ab", 2), ("b", 5), ("abb", 1)], "word string, n long")
    assert {tuple(r) for r in pair_counts(words).collect()} == {("a", "b</w>", 2), ("a", "b", 1), ("b", "b</w>", 1)}


def test_merges_of_tables_are_those_of_the_driver(spark):
    counts = {"aaaa": 3, "aab": 2, "banana": 4, "bandana": 4, "n": 9, "％0020a": 2, "eé": 2, "": 1}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for more in ({}, {"total_symbols": True}, {"min_frequency": 5}):
        limits = {"symbols": 19, "min_frequency": 2} | more
        held = {w: n for w, n in counts.items() if w}
        assert learn_merges_of(words.filter("word <> ''"), **limits, driver_words=0) == learn_merges_of(words.filter("word <> ''"), **limits) == learn_merges(held, **limits)
    with pytest.raises(RuntimeError):
        learn_merges_of(words.filter("word = 'n'"), driver_words=0)


def test_pieces_by_words_are_those_of_texts(spark):
    texts = ["banana bandana, banana-ana! ban", "｟ph｠banana ￭ ▁ na nab", "", None, "nana  x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(2)
    model = ["#version: 0.2", "n a", "b a", "na na</w>", "a n", "ba na"]
    for mode in ("aggressive", "conservative", "space", "char"):
        for more in ({}, {"joiner_annotate": True}, {"spacer_annotate": True}):
            for vocabulary in (None, ["ba￭", "na", "￭na", "▁ba", "x"]):
                if mode == "space" and more:
                    continue
                t = tl.Loom(mode, encoder=tl.BPE(model), vocabulary=vocabulary, **more)
                got = {r["k"]: (r["x"], r["l"]) for r in df.select("k", t.column("t").alias("x"), t.line_column("t").alias("l")).collect()}
                assert got == {k: (None, None) if x is None else (t(x), " ".join(t(x))) for k, x in enumerate(texts)}, (mode, more, vocabulary)


def test_dropout_repeats(spark):
    t = tl.Loom("space", encoder=tl.BPE(["#version: 0.2", "a b", "ab c", "abc d</w>"], dropout=0.5))
    df = spark.createDataFrame([(k, "abcd abcd abcd") for k in range(20)], "k int, t string").repartition(4)
    one, two = ({r["k"]: r["x"] for r in df.repartition(n).select("k", t.column("t", seed=1, key="k").alias("x")).collect()} for n in (2, 5))
    assert one == two and len({tuple(x) for x in one.values()}) > 1
    assert df.select(F.size(t.column("t", training=False)).alias("n")).distinct().collect()[0]["n"] == 3
