import random

import pyarrow as pa
from pyspark.sql import functions as F

import tokenloom as tl
from tokenloom import queries
from tokenloom.operators import native, vocab
from tokenloom.operators.annotate import Reader


def test_case_comes_back_to_the_first_letter(spark, tmp_path):
    spark.createDataFrame([(1, "4928Erreth Of aB 7 ABC")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.case_restore(spark, str(tmp_path)).first()["tokens"] == "4928Erreth Of ? 7 ABC"


def test_tokens_are_counted_by_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([3, None, 1]), pa.array([["a", "b", "a"], ["c"], ["x", "a"]])], names=["key", "tokens"])
    (made,) = vocab._counted([batch])
    assert sorted(map(tuple, zip(*made.to_pydict().values(), strict=True))) == [("a", 3, 1, 1), ("b", 1, 3, 1), ("c", 1, None, 0), ("x", 1, 1, 0)]


def test_sentencepiece_is_not_trained_on_the_driver(spark, tmp_path, monkeypatch):
    import sentencepiece

    def train(**_):
        raise AssertionError("trained on the driver")

    learner = tl.SentencePieceLearner(vocab_size=30, hard_vocab_limit=False, model_type="unigram").ingest_dataframe(spark.createDataFrame([("hello word how are you",)], "t string"), "t")
    monkeypatch.setattr(sentencepiece.SentencePieceTrainer, "train", train)
    assert "".join(learner.learn(str(tmp_path / "m"))("hello")).endswith("o")


def test_readers_equal_the_plain_way():
    rng = random.Random(3)
    atoms = ["a", "é", "￭", "▁", "％0041", "｟p％0020q｠", "｟mrk_begin_case_region_U｠", "｟mrk_end_case_region_U｠", "｟mrk_case_modifier_C｠", "", "-"]
    for options in ({"joiner_annotate": True}, {"spacer_annotate": True}, {"case_markup": True, "lang": "de"}):
        t = tl.Loom(**options)
        reader = Reader(t.options)
        for _ in range(3000):
            words = [rng.choice(atoms) + rng.choice(["", "", "b", "￭"]) if rng.random() < 0.5 else rng.choice(atoms) for _ in range(rng.randrange(0, 7))]
            assert reader.text(words) == t.detokenize(words), words


def test_merged_ranges_by_batch():
    rng = random.Random(5)
    atoms = ["a", "b￭", "￭-", "￭c", "1￭", "￭", "", "￭,￭", "é", "｟p｠￭", "％0041"]
    t = tl.Loom("aggressive", joiner_annotate=True)
    lists = [[rng.choice(atoms) for _ in range(rng.randrange(0, 8))] for _ in range(800)] + [None]
    for unicode in (False, True):
        got = t._merged_ranges(pa.array(lists, pa.list_(pa.string())), unicode).to_pylist()
        assert got == [None if x is None else [{"token": k, "start": a, "end": b} for k, (a, b) in t.detokenize_with_ranges(x, True, unicode)[1].items()] for x in lists]


def test_range_totals(spark):
    t = tl.Loom("aggressive", joiner_annotate=True)
    df = spark.createDataFrame([(0, ["a", "￭b", "cd"]), (1, []), (2, None)], "k int, t array<string>").coalesce(1)
    assert [r["r"] and tuple(r["r"]) for r in df.orderBy("k").select(native.range_totals(F.col("t"), t.options).alias("r")).collect()] == [(3, 4, 5, 4), None, None]
