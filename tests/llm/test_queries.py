"""The registered queries over a small folder of tables with nulls, repeats and odd texts."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import pytest
import sentencepiece

from kvlake.llm import html_text, repetition, sentence_pieces, toxicity
from kvlake.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import connect, differences
from .test_chat_format import cost_of, least_cost
from .test_html_text import ARTICLE
from .test_repetition import brute as counts
from .test_url_filter import urls


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(120)]
    docs: list[tuple] = [(900, None, None, None, None), (901, "", "en", "src0", 0), (902, " \n", None, "src0", 2), (903, "É é É", "fr", "src1", 5), (904, "w1 " * 3000, "en", "src0", 9)]
    for i in range(220):
        if docs and r.random() < 0.4:
            w = (r.choice(docs)[1] or "x").split(" ")
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [x for _ in range(r.randrange(1, 12)) for x in (*r.choices(vocabulary, k=r.randrange(1, 9)), "\n" if r.random() < 0.5 else "z")]
        docs.append((i, " ".join(w), r.choice(("en", "de", None)), r.choice(("src0", "src0", "src3", "src8", None)), len(w)))
    pages = [(i, u, ARTICLE + f"<footer>{i}</footer>" if i % 3 else None) for i, u in enumerate(urls()[:80])]
    chats = [(c, t, r.choice(("system", "user", "assistant", None)), f"t{t}") for c in range(30) for t in range(r.randrange(1, 9))]
    labels = [(d[0], 1, int("w7" in (d[1] or "").split())) for d in docs if r.random() < 0.8]
    folder = tmp_path_factory.mktemp("tables")
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("pages", pages, "page_id long, url string, html string"),
        ("conversations", chats, "conv_id long, turn long, role string, text string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), docs, pages, chats


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_equals_sql(spark, tables, name):
    assert differences(QUERIES[name](spark, tables[0]), connect(tables[0]), ORACLE_SQL[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_sentence_pieces(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_proto=sentence_pieces.read_model())
    got = {r.doc_id: r for r in QUERIES["op2_sentence_pieces"](spark, tables[0]).collect()}
    for d, text, *_ in tables[1]:
        assert got[d].ids == library.encode(text or "") and got[d].n_tokens == len(got[d].ids) and got[d].round_trip


def test_html_text(spark, tables):
    got = {r.page_id: r for r in QUERIES["op5_html_text"](spark, tables[0]).collect()}
    for i, url, page in tables[2]:
        text = html_text.main_text(page, html_text.default_field())
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))
        assert (text == "Title\nFirst one.\nSecond & last.") == (page is not None)


def test_quality_rules(spark, tables):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_quality_rules"](spark, tables[0]).collect()}
    for d, text, *_ in tables[1]:
        if len((text or "").split()) < 200:
            assert got[d] == counts(text, repetition.Limits()), d
    assert got[904][0] == 3000 and got[904][7] and not got[904][8]


def test_the_method_refuses_rows_that_the_base_passes(spark):
    """Among the whole texts of sf0.01: those of which a tenth is passages of ten words or more that come again."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    rows = QUERIES["op6_quality_rules"](spark, str(folder)).where("not base_failed and not kept").collect()
    assert rows and all(10 * r.covered_words > r.n_words and 5 * r.n_repeat_words <= r.n_words for r in rows)


def test_chat_format(spark, tables):
    got = QUERIES["op9_chat_format"](spark, tables[0]).collect()
    assert len(got) == len(tables[3])
    for c in range(30):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
        assert cost_of(mine) == least_cost([x[2] for x in sorted(tables[3], key=lambda x: x[:2]) if x[0] == c])


def test_toxicity(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, tables[0]).collect()}
    assert len(got) == len(tables[1])
    for d, text, *_ in tables[1]:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.Settings().threshold)
    assert got[900].score == got[901].score == got[902].score
