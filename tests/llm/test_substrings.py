"""Repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from citeharbor.llm import substrings
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


def plain(rows, window):
    pieces = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for (i, _), words in zip(rows, pieces):
        for k in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[k:k + window])
            seen[key] = min(seen.get(key, i), i)
    out = []
    for (i, _), words in zip(rows, pieces):
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if seen[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in frame.collect()), key=repr)


def test_documents_match_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = plain(rows, 50)
    assert sum(n for _, _, n, _ in want) > 0
    digests = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want]
    got = sorted(map(tuple, QUERIES["op9_substring_dedup"](spark, sf_dir).collect()), key=repr)
    assert got == sorted(digests, key=repr)


@pytest.mark.parametrize("window, gram", [(3, 2), (5, 3), (4, 4), (6, 1)])
def test_random_texts(docs, window, gram):
    rng = random.Random(window)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(14))))
            for _ in range(60)]
    rows += rows[:5]
    assert result(substrings.remove_repeated_passages(docs(rows), window, gram)) == plain(rows, window)


def test_edge_cases(docs):
    rows = edge_rows()
    assert result(substrings.remove_repeated_passages(docs(rows), 3, 2)) == plain(rows, 3)
    assert substrings.remove_repeated_passages(docs([]), 3, 2).collect() == []


def test_intervals_are_maximal(docs):
    rows = [(1, "a b c d e f g"), (2, "x a b c d y d e f g z")]
    spans = {r.doc_id: [tuple(s) for s in r.removed]
             for r in substrings.remove_repeated_passages(docs(rows), 3, 2).collect()}
    assert spans == {1: [], 2: [(1, 5), (6, 10)]}
