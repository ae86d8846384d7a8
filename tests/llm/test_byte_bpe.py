import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from callboard.llm import byte_bpe

from frames import empty_documents, multiset, odd_documents, texts_of

RAW = byte_bpe.read_vocabulary()


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(RAW)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_against_the_library(library):
    random.seed(3)
    parts = [*"abdelmrstv'''' \n\t    !?.,é日1٣²\U0001f600́_\r\u0085\x1c\x00", "'re", "'ll", "'s", "  ", "don't", "'''", "\n\n"]
    texts = ["".join(random.choices(parts, k=random.choice([0, 1, 2, 3, 5, 30, 200]))) for _ in range(5000)]
    vocabulary = byte_bpe.Vocabulary(RAW)
    for text, packed in zip(texts, vocabulary.encode([x.encode() for x in texts]), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == library.encode_ordinary(text), text
        assert vocabulary.decode(ids, vocabulary.offsets(ids)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "abc" * 3000, " " * 4000, "'" * 999 + "s", "日本" * 2000, "\n" * 70])
def test_long_pieces(library, text):
    (packed,) = byte_bpe.Vocabulary(RAW).encode([text.encode()])
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)


def test_every_code_point_next_to_others(library):
    points = [chr(i) for i in range(0, 0x110000, 37) if not 0xD800 <= i < 0xE000]
    text = "".join(f"a{c}1{c} {c}.{c}'{c}s" for c in points)
    (packed,) = byte_bpe.Vocabulary(RAW).encode([text.encode()])
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)


def test_slices_decode_by_their_offsets():
    vocabulary = byte_bpe.Vocabulary(RAW)
    (packed,) = vocabulary.encode([b"some words that make tokens"])
    ids = np.frombuffer(packed, "<u4")
    offsets = vocabulary.offsets(ids)
    assert vocabulary.decode(ids[2:4], offsets[2:4]) == b"some words that make tokens"[offsets[2] : offsets[4]]


def test_digests(spark, library):
    df = odd_documents(spark)
    expected = []
    for doc_id, text in texts_of(df):
        ids = library.encode_ordinary(text.decode())
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert multiset(map(tuple, byte_bpe.digests(df, ["doc_id"]).collect())) == multiset(expected)


def test_empty_table_and_clashing_columns(spark):
    assert byte_bpe.digests(empty_documents(spark), ["doc_id"]).collect() == []
    df = odd_documents(spark).selectExpr("*", "1 AS Token_IDs", "'x' AS decoded")
    row = byte_bpe.decode(byte_bpe.encode(df)).where("doc_id = 1").first()
    assert bytes(row.decoded).decode() == row.text and len(row.token_ids) == len(row.token_offsets)


def test_ids_as_numbers(spark, library):
    text = "one two <|x|> three"
    df = byte_bpe.encode(spark.createDataFrame([(text,), ("",)], "text string"))
    rows = df.select("text", byte_bpe.ids_array().alias("ids")).collect()
    assert {r.text: r.ids for r in rows} == {text: library.encode_ordinary(text), "": []}
