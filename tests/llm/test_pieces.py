import random

import numpy as np
import pytest

from sievewright.llm import pieces, queries

ODD = [
    None, "", " ", " a  b", "a\nb\tc", "é", "ﬁ ½", "A b", "▁x", "  ", "<s> x", "日本語 test   end ", "\0x", "a\0b",
    "<0x0A>", "<unk>", "�", "a\r\n", "a" * 1000, "ab" * 300, " " * 77 + "x" + " " * 33, "the" * 50, "😀 ok", "0" * 40,
    "aaaa aaa aa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 31, "x" * 32, "x" * 33, "word " * 30_000,
]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = queries.vocabulary_path(queries.PIECES)
    return sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)


def both(model, texts):
    library, vocabulary = model
    ids, counts = pieces.Encoder(vocabulary).encode(texts)
    decoder = pieces.Decoder(vocabulary)
    for text, mine in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert mine.tolist() == library.encode(text or "")
        assert decoder.decode(mine.tolist()) == (text or "").replace("▁", " ")


def test_ids_equal_the_library_on_odd_texts(model):
    both(model, ODD)


def test_ids_equal_the_library_on_random_texts(model):
    rnd = random.Random(5)
    for letters in ("ab ", "thein ▁", "aeé \n.,", "01 x", "日本 aàç"):
        both(model, ["".join(rnd.choices(letters, k=rnd.randrange(90))) for _ in range(200)])


def test_ranges_find_every_occurrence(model):
    encoder = pieces.Encoder(model[1])
    text = "▁the▁then▁anthem\0▁another"
    table = encoder.edges(pieces._codes(text))
    many = {model[1].pieces[i] for i in encoder.many}
    for i in range(len(text)):
        for n in range(2, encoder.longest + 1):
            assert (table[i, n] != pieces.NONE) == (i + n <= len(text) and text[i : i + n] in many)


def test_tables_with_odd_rows(spark, model):
    rows = [(i, t, 3) for i, t in enumerate(ODD)] + [(None, "again", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = pieces.decode(pieces.encode(df, model[1]), model[1]).collect()
    assert sorted((r["text"] or "").replace("▁", " ") for r in back) == sorted(r["decoded"] for r in back)
    assert len(back) == len(rows)
    assert pieces.encode(df.filter("doc_id > 999"), model[1]).count() == 0


def test_query_against_the_library(spark, model):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries.QUERIES["op9_pieces"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = model[0].encode(texts[r["doc_id"]])
        assert r["n_pieces"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].replace("▁", " ").encode()).hexdigest()


def test_lists_are_cut_at_their_ends(model):
    import pyarrow as pa

    decoder = pieces.Decoder(model[1])
    texts = ["é 日本", "", "plain words", "\x01 odd"]
    ids, counts = pieces.Encoder(model[1]).encode(texts)
    lists = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    column = pa.array([[5, 6], *lists, None, [1]], pa.list_(pa.int32())).slice(1, 5)
    assert decoder.decode_lists(column) == [*texts, ""]
    broken = model[1].bytes_[0xE3]
    assert decoder.decode([int(broken)]) == "�"
