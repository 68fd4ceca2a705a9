"""Encoding and decoding against the library itself."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from kvlake.llm import sentence_pieces as S

BODY = S.read_model()


def unigram_body() -> bytes:
    """The public vocabulary as a unigram model; the scores of space runs are brought near the others, for the library adds in single precision."""
    m = proto.ModelProto()
    m.ParseFromString(BODY)
    m.trainer_spec.model_type = S.UNIGRAM
    for i, p in enumerate(m.pieces):
        if p.type == S.NORMAL:
            p.score = -8 - (i % 977) / 128
    return m.SerializeToString()


def texts(n: int) -> list[str]:
    r = random.Random(2)
    letters = "  \n\tabcdeéß▁✓漢字 the ing  0123 aaa   😀"
    many = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(n)]
    return many + [" " * k + "x" for k in range(40)] + ["a" + " " * k for k in range(40)] + ["", "The interesting thing is international, isn't it?"]


@pytest.mark.parametrize("body", [BODY, unigram_body()], ids=["bpe", "unigram"])
def test_equals_the_library(body):
    mine, library = S.Model(body), sentencepiece.SentencePieceProcessor(model_proto=body)
    for text in texts(1500):
        ids = library.encode(text)
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == library.decode(ids)


def test_prefixes_shared_by_many_words_give_each_word_its_own_ids():
    model, library = S.Model(BODY), sentencepiece.SentencePieceProcessor(model_proto=BODY)
    words = {"▁inter" + x for x in ("", "n", "national", "nationally", "esting", "view", "views")}
    got = model.encode_words(words)
    assert {w: np.frombuffer(x, np.int32).tolist() for w, x in got.items()} == {w: library.encode(w[1:]) for w in words}


def test_frames(spark):
    rows = [(1, "Hello  world\n", "k"), (1, "Hello  world\n", "k"), (2, None, "k"), (3, "", None), (None, "é" * 50_000, "z"), (4, "x " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_before string")
    got = S.decode(S.encode(df, BODY), BODY)
    assert got.columns == ["doc_id", "text", "decoded_before", "ids", "decoded"]
    found = got.collect()
    assert len(found) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_proto=BODY)
    for r in found:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "")
    assert S.code(df, BODY).collect() == found
    assert S.encode(df.where("false"), BODY).collect() == []
    with pytest.raises(ValueError):
        S.encode(df.withColumnRenamed("decoded_before", "ids"), BODY)


@pytest.mark.parametrize("body", [BODY, unigram_body()], ids=["bpe", "unigram"])
def test_memory_grows_in_proportion_to_an_unbroken_word(body):
    r = random.Random(4)
    word = "".join(r.choice("abcdefghijklmnop漢✓") for _ in range(12_000))
    model, library = S.Model(body), sentencepiece.SentencePieceProcessor(model_proto=body)
    model.encode(word[:2000])
    tracemalloc.start()
    ids = model.encode(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == library.encode(word)
    assert peak < 20_000_000


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "漢字仮名交文書日本語中国人民大学校長年月火水木金土"])
def test_one_word_of_200000_characters(letters):
    """Equal to the library, in memory and time that grow with the word."""
    r = random.Random(len(letters))
    word = "".join(r.choice(letters) for _ in range(200_000))
    model, library = S.Model(BODY), sentencepiece.SentencePieceProcessor(model_proto=BODY)
    model.encode(word[:5000])
    tracemalloc.start()
    ids = model.encode(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    assert ids == library.encode(word) and model.decode(ids) == word
