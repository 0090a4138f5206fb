import public_tokenizers
from tokenizers import Tokenizer

from vinculum.llm import tokens

ODD = ["", None, "  ", "a", "don't I'll\n\n x  y ", "नमस्ते दुनिया।", "<|endoftext|> ok", "🙏🏽 ok ​— x", "\tx\r\n", "0123456789" * 500, "ab" * 5000]


def expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def test_ids_equal_the_tokenizers_own_with_and_without_hot_words(spark):
    rows = [(k % 7, t, "extra") for k, t in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    want = sorted((k, i) for (k, _, _), i in zip(rows, expected([r[1] for r in rows])))
    for hot in (1, 20_000):
        got = tokens.encode_corpus(df, hot=hot)
        assert got.columns == ["doc_id", "ids"]
        assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == want


def test_documents_of_the_smallest_tables(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = df.collect()
    want = dict(zip([r.doc_id for r in rows], expected([r.text for r in rows])))
    assert {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()} == want


def test_decoding_gives_the_texts_back(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id int, text string")
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD)}


def test_empty_table_null_keys_and_unknown_ids(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert tokens.encode_corpus(empty).count() == 0
    assert tokens.decode_corpus(tokens.encode_corpus(empty)).count() == 0
    one = spark.createDataFrame([(None, "x y")], "doc_id int, text string")
    assert [r.doc_id for r in tokens.encode_corpus(one).collect()] == [None]
    odd = spark.createDataFrame([(1, [50_300]), (2, None)], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(odd).collect()} == {1: "�", 2: ""}


def test_ids_beyond_two_bytes(spark, monkeypatch):
    import numpy as np

    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    want = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    monkeypatch.setattr(tokens, "width_of", lambda path: np.dtype(np.uint32))
    for hot in (1, 20_000):
        assert {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, hot=hot).collect()} == want
