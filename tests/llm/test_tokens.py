import pytest
import regex
import tiktoken

from tidemill.llm.tokens import PATTERN, VOCABULARY, encode_corpus, encode_piece, load_ranks

TEXTS = [
    "Hello  world,\n\n it's 12345 naïve 🚀🎉 <|endoftext|> end ",
    "ฝ่ายบัญชีขอให้ตรวจงานสำรองข้อมูลก่อนเที่ยง",
    "在Tarnbridge，平台组和财务部一起检查了任务队列；结果很好。",
    "a" * 3000,
    " \t\r\n ",
    "ab" * 500 + "�",
    "",
    None,
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


def test_same_ids_as_a_public_library(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_whole_small_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_corpus(docs).collect():
        assert r.ids == (reference.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])


def test_pieces(reference):
    ranks = load_ranks(VOCABULARY)
    assert encode_piece(b"", ranks) == []
    for piece in regex.findall(PATTERN, "unbelievableness antidisestablishmentarianism" + " zq" * 7 + "zq" * 70):
        assert encode_piece(piece.encode(), ranks) == reference.encode_ordinary(piece)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x", [3])], "doc_id long, text string, ids array<int>")
    assert encode_corpus(df).columns == ["doc_id", "ids"]
    assert encode_corpus(df.where("false")).count() == 0
