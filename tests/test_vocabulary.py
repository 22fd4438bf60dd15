import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators import batching
from seqloom.operators import vocabulary as voc
from seqloom.operators.translation import encode_parallel
from seqloom.sources import model_dir
from seqloom.sources.corpus import parallel, parse_tagged, tokenize


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")


def ids_of(vocabulary):
    return {r["tok"]: r["id"] for r in vocabulary.collect()}


def fit(df, markers, cut=1, words="toks"):
    spread = df.select("line_id", F.posexplode(words).alias("pos", "tok"))
    return voc.fit_vocabulary(spread, ("line_id", "pos"), markers, cut)


def language(spark, *texts):
    df = lines(spark, *texts).withColumn("toks", tx.sentence_marks(tx.tokens("text")))
    return df, fit(df, tx.LANGUAGE_MARKERS)


def test_language_model_corpus(spark):
    df, fitted = language(spark, "I am Philip", "I am student")
    assert ids_of(fitted) == {"<UNK>": 0, "<EOS>": 1, "{*}": 2, "<s>": 3, "</s>": 4, "i": 5, "am": 6}
    rows = voc.encode_lines(df, ["line_id"], fitted).orderBy("line_id").collect()
    assert [r["ids"][:-1] for r in rows] == [[3, 5, 6, 0]] * 2
    assert [r["ids"][1:] for r in rows] == [[5, 6, 0, 4]] * 2


def test_blank_line_keeps_its_row(spark):
    df, fitted = language(spark, "a a", "", "a")
    assert {r["line_id"]: r["ids"] for r in voc.encode_lines(df, ["line_id"], fitted).collect()}[1] == [3, 4]
    bare = df.withColumn("toks", tx.tokens("text"))
    assert {r["line_id"]: r["ids"] for r in voc.encode_lines(bare, ["line_id"], fitted).collect()}[1] == []


def test_literal_unk_is_a_word(spark):
    _, fitted = language(spark, "<unk> <unk>")
    assert ids_of(fitted)["<unk>"] == 5


def test_parallel_corpus(spark):
    src = lines(spark, "I am Philip", "I am a student", "no partner")
    trg = lines(spark, "私 は フィリップ です", "私 は 学生 です")
    text = encode_parallel(parallel(src, trg, ["line_id"]), ["line_id"])
    assert ids_of(text.src_vocabulary) == {"<UNK>": 0, "<EOS>": 1, "{*}": 2, "i": 3, "am": 4}
    assert ids_of(text.trg_vocabulary) == {"<UNK>": 0, "<EOS>": 1, "{*}": 2, "私": 3, "は": 4, "です": 5}
    rows = text.pairs.orderBy("line_id").collect()
    assert [r["src"] for r in rows] == [[3, 4, 0, 1], [3, 4, 0, 0, 1]]
    assert [r["trg"] for r in rows] == [[3, 4, 0, 5, 1]] * 2


def test_batch_of_uncut_parallel_corpus(spark):
    src = lines(spark, "I am Philip", "I am a student")
    trg = lines(spark, "私 は フィリップ です", "私 は 学生 です")
    text = encode_parallel(parallel(src, trg, ["line_id"]), ["line_id"], cut=0)
    batches = batching.length_batches(text.pairs.withColumn("n", F.size("src")), "n", ["line_id"], 2)
    rows = batching.pad_batches(batches, {"src": 2, "trg": 2}).orderBy("row_index").collect()
    assert [(r["line_id"], r["src"], r["trg"]) for r in rows] == [
        (1, [3, 4, 6, 7, 1], [3, 4, 7, 6, 1]),
        (0, [3, 4, 5, 1, 2], [3, 4, 5, 6, 1]),
    ]


def test_tagged_corpus(spark):
    df = lines(spark, "I_NNP am_VBZ Philip_NNP", "I_NNP am_VBZ student_NN", "")
    rows = parse_tagged(df, ["line_id"])
    words = voc.fit_vocabulary(rows, ("line_id", "pos"), tx.TRANSLATION_MARKERS, token="word")
    tags = voc.fit_vocabulary(rows, ("line_id", "pos"), tx.TAG_MARKERS, cut=None, token="tag")
    assert ids_of(words) == {"<UNK>": 0, "<EOS>": 1, "{*}": 2, "I": 3, "am": 4}
    assert ids_of(tags) == {"<EOS>": 0, "{*}": 1, "NNP": 2, "VBZ": 3, "NN": 4}
    encoded = voc.gather(voc.encode_tokens(rows, words, token="word"), ["line_id"], "pos", "id", "ids")
    tagged = voc.gather(voc.encode_tokens(rows, tags, unk=None, token="tag"), ["line_id"], "pos", "id", "ids")
    assert {r["line_id"]: r["ids"] for r in encoded.collect()} == {0: [3, 4, 0], 1: [3, 4, 0]}
    assert {r["line_id"]: r["ids"] for r in tagged.collect()} == {0: [2, 3, 2], 1: [2, 3, 4]}


@pytest.mark.parametrize("token", ["a_b_c", "ab"])
def test_bad_tagged_token(spark, token):
    df = lines(spark, f"I_NNP {token}")
    with pytest.raises(Exception, match="not word_tag"):
        parse_tagged(df, ["line_id"]).collect()
    rows = parse_tagged(df, ["line_id"], mode="quarantine").orderBy("pos").collect()
    assert [(r["word"], r["rejected"]) for r in rows] == [("I", None), (None, token)]


def frozen(spark, *words):
    rows = [(w, i, 1) for i, w in enumerate((*tx.TRANSLATION_MARKERS, *words))]
    return spark.createDataFrame(rows, "tok string, id int, n long")


def test_frozen_vocabulary(spark):
    df = tokenize(lines(spark, "I live in Japan"), lowercase=False)
    rows = voc.encode_lines(df, ["line_id"], frozen(spark, "I", "live", "in")).collect()
    assert [(r["line_id"], r["ids"]) for r in rows] == [(0, [3, 4, 5, 0])]


def test_ids_to_sentence(spark):
    _, fitted = language(spark, "I am Philip", "I am student")
    ids = spark.createDataFrame([(0, [5, 6, 99, 1, 5]), (1, [5, 6]), (2, [])], "line_id long, ids array<int>")
    rows = voc.decode_lines(ids, ["line_id"], fitted).orderBy("line_id").collect()
    assert [r["sentence"] for r in rows] == ["i am <UNK>", "i am", ""]


def test_vocabulary_file(spark, tmp_path):
    table = frozen(spark, "i", "am", "philip").select(
        "tok", F.when(F.col("tok") == "i", 3).when(F.col("tok") == "am", 4).otherwise(F.col("id")).alias("id")
    )
    path = str(tmp_path / "voc")
    model_dir.write_vocabulary(table, path)
    assert spark.read.text(f"{path}/header").first()[0] == "length\tint\t6"
    got = [r["value"] for r in spark.read.text(f"{path}/rows").collect()]
    assert sorted(got) == sorted(["<EOS>\t1", "<UNK>\t0", "am\t4", "i\t3", "philip\t5", "{*}\t2"])
    assert ids_of(model_dir.read_vocabulary(spark, path)) == ids_of(table)
    spark.range(1).selectExpr("'length\tint\t9' AS value").write.mode("overwrite").text(f"{path}/header")
    with pytest.raises(ValueError, match="header"):
        model_dir.read_vocabulary(spark, path)


def test_decode_of_encode_is_the_text(spark):
    texts = ["b a b", "c", "", "a c d d e"]
    df = lines(spark, *texts).withColumn("toks", tx.append_eos(tx.tokens("text")))
    fitted = fit(df, tx.TRANSLATION_MARKERS, cut=0)
    back = voc.decode_lines(voc.encode_lines(df, ["line_id"], fitted), ["line_id"], fitted)
    assert {r["line_id"]: r["sentence"] for r in back.collect()} == dict(enumerate(texts))


def test_membership(spark):
    counts = spark.createDataFrame([("i", 2), ("x", 5)], "tok string, n long")
    known = frozen(spark, "i")
    assert [r["tok"] for r in voc.out_of_vocabulary(counts, known).collect()] == ["x"]
    assert [r["tok"] for r in voc.in_vocabulary(counts, known).collect()] == ["i"]
