"""Toxicity: held-out accuracy, the n-gram features, and defined results for odd input."""

import math
import zlib

import numpy as np
import pyarrow as pa

from citeharbor.llm import toxicity
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert sum(b for a, b in held if a) / sum(a for a, _ in held) > 0.7


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_only_labelled_rows_that_are_not_held_out_are_read(spark, docs):
    rows = [(i, "you vile fool" if i % 2 else "a fine day") for i in range(200)]
    frame = docs(rows)
    right = labelled(spark, [(i, 1, i % 2, None) for i, _ in rows])
    # Labels of held-out rows are turned round: they must not matter.
    turned = labelled(spark, [(i, 1, (i % 2) ^ (zlib.crc32(str(i).encode()) % 5 == 0), None) for i, _ in rows])
    a, b = (sorted(map(tuple, toxicity.toxicity(frame, x).collect())) for x in (right, turned))
    assert a == b
    assert all(p == i % 2 for i, _, _, p in a)


def test_edge_cases(docs, spark):
    rows = edge_rows()
    labels = labelled(spark, [(i, 1, i % 2, "x") for i in range(9)] + [(None, 1, 1, "x"), (4, 0, 1, "x"), (5, 1, None, "x")])
    for table in (labels, labelled(spark, []), labelled(spark, [(1, 1, 1, "x")]), labelled(spark, [(1, 1, 0, "x")])):
        got = toxicity.toxicity(docs(rows), table).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id in (2, 3) or (r.doc_id == 1)}) <= 2
    assert toxicity.toxicity(docs([]), labels).collect() == []


def test_scores_equal_a_plain_sum_over_present_grams():
    grams = ["abc", "bcd", "éé1", "abcd", "zzzzz", "日本語", "本語x"]
    keys = np.array([toxicity.key(g) for g in grams], dtype=np.uint64)
    order = np.argsort(keys)
    weights = np.array([1.0, -2.0, 0.5, 3.0, 7.0, -1.5, 2.5])
    model = toxicity.Model(keys[order], weights[order], -0.25)
    texts = ["abc", "ABCD abcd", "ab", "", None, "xéé1éé1", "c", "zzzz", "zzz zz", "d" * 5 + "zzzzzz", "é", "é1",
             "日本", "語x", "x日本語X", "𝄞日本語𝄞abc"]
    for text, got in zip(texts, model.scores(pa.array(texts))):
        raw = (text or "").translate(str.maketrans("ABCDX", "abcdx"))
        z = -0.25 + sum(w for g, w in zip(grams, weights) if g in raw)
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_counts_and_ratios_equal_a_plain_version():
    rows = [(1, "Abcab ééé"), (0, "abcab"), (1, "日本語日本語"), (0, ""), (0, "ab"), (1, "bcab")]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], ["t", "x"])
    got = {}
    for part in toxicity._text_grams([batch]):
        for gram, toxic, clean in zip(*(c.to_pylist() for c in part.columns)):
            old = got.get(gram, (0, 0))
            got[gram] = (old[0] + toxic, old[1] + clean)
    want = {}
    for toxic, text in rows:
        low = text.replace("A", "a")
        for gram in {low[i:i + n] for n in (3, 4, 5) for i in range(len(low) - n + 1)}:
            at = np.array([toxicity.key(gram)], dtype=np.uint64).view(np.int64)[0]
            old = want.get(int(at), (0, 0))
            want[int(at)] = (old[0] + toxic, old[1] + 1 - toxic)
    assert got == want


def test_a_single_bad_word_is_found_in_a_long_text(docs, spark):
    rows = [(i, f"calm words number {i} " + ("you idiot " if i % 2 else "")) for i in range(300)]
    labels = labelled(spark, [(i, 1, i % 2, None) for i in range(300)])
    frame = docs(rows + [(1000, "calm words number " * 3000 + "you idiot"), (1001, "calm words number " * 3000)])
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(frame, labels).collect()}
    assert (got[1000], got[1001]) == (1, 0)
