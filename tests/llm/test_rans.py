"""Token files: exact round trips, the tokenizer's ids, damaged files, ordering."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citeharbor.llm import rans
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(rans.default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "Don't STOP, it's 1,234!!", "a<|endoftext|>b", "A<|ENDOFTEXT|>", "x́y", "J̌ J̌.", "é.é,É!", "İıſß.K", "a.b.c''s",
       "x\u0085y z", "tab\there\x0bnow", "日本、語。", "😀!?", "l'été d'or", "'''re", "she'll've", "a\x1cb", "​q", "½²x", "a_b-c"]


def test_words_give_the_ids_of_whole_texts(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aB.,' \n'st<|é́1!") for _ in range(40)) for _ in range(500)]
    tokens = rans.Tokens(rans.default_tokenizer())
    for _ in range(2):  # the second time from the remembered words
        got = [np.frombuffer(b, "<u4").tolist() for b in tokens.batch(pa.array(texts))]
        assert got == [ids_of(library, t) for t in texts]


def test_every_character_beside_punctuation(library):
    """Characters that normalisation takes apart included."""
    chars = [chr(c) for c in range(0x21, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    tokens = rans.Tokens(rans.default_tokenizer())
    for form in ("a{}.'s", ".{}b"):
        texts = [form.format(c) for c in chars]
        got = [x for at in range(0, len(texts), 20_000) for x in tokens.batch(pa.array(texts[at:at + 20_000]))]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_another_tokenizer_is_used_as_it_is():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Don't  STOP, it's\n1,234!!", " a", "", "x. Y"]
    got = [np.frombuffer(b, "<u4").tolist() for b in rans.Tokens(path).batch(pa.array(texts))]
    assert got == [ids_of(Tokenizer.from_file(path), t) for t in texts]


@pytest.mark.parametrize("counts", [[1], [5, 0, 3], [10**9, 1, 1, 0, 7], list(range(1, 3000))])
def test_frequencies_add_up(counts):
    scaled = rans.frequencies(np.array(counts))
    assert scaled.sum() == 1 << rans.SCALE_BITS and ((scaled > 0) == (np.array(counts) > 0)).all()


def test_coder_round_trips(monkeypatch):
    monkeypatch.setattr(rans, "STEPS", 4)
    rng = np.random.default_rng(1)
    coder = rans.Coder(rans.frequencies(np.append(rng.zipf(1.4, 300).clip(1, 10**6), 0)))
    blocks = [rng.integers(0, 300, n) for n in (0, 1, 15, 16, 17, 64, 65, 5000)]
    coded = coder.encode(blocks)
    packed = [(len(b), *c) for b, c in zip(blocks, coded)]
    for got, want in zip(coder.decode(packed), blocks):
        assert got.tolist() == want.tolist()
    # Any checkpoint can be decoded alone.
    n, words, states, offsets = packed[-1]
    at = 3
    tail = coder.decode([(n - at * 4 * rans.LANES, words, states[at:], offsets[at:])])
    # The words are read from the checkpoint's own offset on.
    assert tail[0].tolist() == blocks[-1][at * 4 * rans.LANES:].tolist()
    single = rans.Coder(rans.frequencies(np.array([9])))
    assert single.decode([(100, *single.encode([np.zeros(100, int)])[0])])[0].tolist() == [0] * 100


def expected(library, rows):
    coded = [(i, ids_of(library, t) + [1]) for i, t in rows]
    return {i: (n, zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in coded for n in [len(c)]}


def test_documents(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = expected(library, rows)
    start, got = 0, {r.doc_id: r for r in QUERIES["op6_token_files"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, *want[i])
        start += want[i][0]


def test_edge_cases(docs, spark, library, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 50)
    rows = edge_rows()
    folder = rans.write_texts(docs(rows))
    got = rans.read(spark, folder).collect()
    assert sorted(((r.doc_id, len(r.ids) // 4) for r in got), key=repr) == sorted(
        ((i, len(ids_of(library, t)) + 1) for i, t in rows), key=repr)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [len(r.ids) // 4 for r in ordered])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in ordered[:2]] == [None, None]
    assert rans.read(spark, rans.write_texts(docs([]))).collect() == []


def test_damage_is_found(docs, spark, tmp_path):
    folder = rans.write_texts(docs([(1, "some words here"), (2, "and there")]), folder=str(tmp_path / "a"))
    broken = str(tmp_path / "b")
    spark.read.parquet(f"{folder}/table").write.parquet(f"{broken}/table")
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks.withColumn("checksum", blocks["checksum"] + 1).write.parquet(f"{broken}/blocks")
    with pytest.raises(Exception, match="is damaged"):
        rans.read(spark, broken).collect()
