"""SentencePiece encoding against the library; exact round trips."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from citeharbor.llm import sentencepieces as own
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=own.default_model())


@pytest.fixture(scope="module")
def encoder():
    return own.Encoder(own.Vocabulary.load(own.default_model()))


ODD = ["", " ", "   ", "a", " a", "a ", "a  b", "\n", "a\n\n b", "\t\tx", "▁", "▁▁a▁ b", "<s> </s> <unk>", "<0x0A>", "é", "é",
       "日本語テキスト", "😀😀 x", "\u0000", "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 40, "x" + " " * 33 + "y", "ſİıß", "  \xa0",
       "Don't stop!!!  ¿Qué?", "1234567890 12,345.67", "http://a.b/c?d=e&f", "thethethethe", "퟿", "\U0010ffff"]


def test_odd_texts(encoder, library):
    got = encoder.texts(pa.array(ODD + [None])).to_pylist()
    assert got == [library.encode(t) for t in ODD] + [[]]


@pytest.mark.parametrize("alphabet", ["ab ", "the in on er", "aàé▁ñ ", "0123456789 .,", "日本aあ \n", "abcdefghijklmnopqrstuvwxyz"])
def test_random_texts(encoder, library, alphabet):
    rng = random.Random(len(alphabet))
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    assert encoder.texts(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_small_blocks_give_the_same(encoder, library, monkeypatch):
    monkeypatch.setattr(own, "INDEX_CHARS", 7)
    texts = ["some words here", "and some there", "x"]
    assert encoder.texts(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_documents_match_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.ids) and r.ids == library.encode(texts[r.doc_id])


def test_edge_cases(docs, library):
    rows = edge_rows()
    got = own.decode(own.encode(docs(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert own.encode(docs([])).collect() == []


def test_decoding_matches_the_library(library):
    vocabulary = own.Vocabulary.load(own.default_model())
    for text in ODD:
        ids = library.encode(text)
        assert own.decoded(vocabulary, ids) == library.decode(ids)
    assert own.decoded(vocabulary, [3 + 0xC3]) == "�"


def test_both_ways_at_once_equal_one_after_the_other(docs):
    rows = edge_rows() + [(9, "Ünï ▁ 日本 😀 x" * 40)]
    frame = docs(rows).select("doc_id", "text")
    apart = own.decode(own.encode(frame)).select("doc_id", "ids", "decoded")
    at_once = own.round_trip(frame)
    assert sorted(map(str, at_once.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, apart.collect()))
    plan = at_once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("both(") == 1
