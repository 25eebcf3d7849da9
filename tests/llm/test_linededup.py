"""Line deduplication against brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from citeharbor.llm import linededup
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


def plain(rows):
    """(doc_id, lines with words, numbers of lines to go) of each row."""
    lines = []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = set(line.encode().split())
            if words:
                lines.append(((i, n), words, len(lines)))
    gone = set()
    for at, words, k in lines:
        for before, others, _ in lines:
            if None in (at[0], before[0]) or not before < at:
                continue
            if Fraction(len(words & others), len(words | others)) >= Fraction(4, 5):
                gone.add(k)
                break
    out, k = [], 0
    for i, text in rows:
        own = [n for n, line in enumerate((text or "").split("\n")) if line.encode().split()]
        out.append((i, len(own), [n for j, n in enumerate(own) if k + j in gone]))
        k += len(own)
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_lines, r.removed) for r in frame.collect() if r.n_removed == len(r.removed)), key=repr)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(25)}" for _ in range(rng.randrange(1, 12))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), n):
        lines = []
        for _ in range(rng.randrange(5)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(25)}"
            lines.append(rng.choice(["", " "]) + " ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed, witnesses, block", [(1, 4, 4096), (2, 1, 4096), (3, 4, 3), (4, 1, 2)])
def test_random_lines(docs, monkeypatch, seed, witnesses, block):
    monkeypatch.setattr(linededup, "WITNESSES", witnesses)
    monkeypatch.setattr(linededup, "LIST_ROWS", block)
    rows = random_rows(seed)
    want = plain(rows)
    assert sum(len(g) for _, _, g in want) > 20
    assert result(linededup.judged(docs(rows))) == want


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain(rows)
    assert result(QUERIES["op3_line_dedup"](spark, sf_dir)) == want


def test_edge_cases(docs):
    rows = edge_rows()[:4] + edge_rows()[5:]
    assert result(linededup.judged(docs(rows))) == plain(rows)
    assert linededup.judged(docs([])).collect() == []


def test_rows_that_repeat_a_doc_id(docs):
    rows = [(4, "a b c"), (4, "a b c"), (4, "x y\na b c"), (5, "a b c\nq")]
    got = result(linededup.judged(docs(rows)))
    assert got == [(4, 1, []), (4, 1, []), (4, 2, [1]), (5, 2, [0])]


def test_remove_lines(docs):
    rows = [(1, "one two\n\nthree"), (2, "two one\nfour\n"), (None, "three"), (3, None)]
    kept = linededup.remove_lines(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, "one two\n\nthree"), (2, "four\n"), (None, "three"), (3, None)], key=repr)


def test_different_sets_with_equal_half_keys_both_stay_in_a_list():
    """Two sets whose keys agree in the low 32 bits, and a copy of the second."""
    table = pa.table({
        "ids": pa.array([7 << 32 | 99] * 3, pa.int64()), "part": pa.array([0] * 3, pa.int32()),
        "doc_id": pa.array([1, 2, 3], pa.int64()), "line": pa.array([0, 0, 0], pa.int32()),
        "sizes": pa.array([10 << 32] * 3, pa.int64()), "b0": pa.array([1, 2, 2], pa.int64()),
        **{f"b{k}": pa.array([0] * 3, pa.int64()) for k in (1, 2, 3)}})
    assert linededup._List(table).doc.tolist() == [1, 2]


def test_prefix_rows_are_narrow_and_sorted_by_one_number(docs):
    """A row of a list holds the wide bitmap of long lines only, and gives back what the list takes."""
    bits = np.arange(1, 13, dtype=np.int64).reshape(3, 4)
    table = pa.table({
        "list": pa.array([-7 << 32 | 3, 7 << 32, 8 << 32, 9 << 32]), "doc_id": pa.array([1, 2, 3, 4]),
        "lines": pa.array([5 << 32 | 0xFFFFFFFF, 6 << 32 | 1, 2, 3]), "sizes": pa.array([100 << 32, 0, 96 << 32 | 1, 0]),
        "b0": pa.array([20, 21, 22, 23]), "wide": linededup._wide(bits, np.array([True, False, True, False]))})
    assert table["wide"].null_count == 2
    got = linededup._unpacked(table)
    assert got["ids"].to_pylist() == [-7 << 32 | 0xFFFFFFFF, 7 << 32 | 1, 8 << 32 | 2, 9 << 32 | 3]
    assert got["part"].to_pylist() == [3, 0, 0, 0] and got["line"].to_pylist() == [5, 6, 0, 0]
    assert [got[f"b{k}"].to_pylist() for k in range(4)] == [[20, 21, 22, 23], [1, 0, 3, 0], [5, 0, 7, 0], [9, 0, 11, 0]]
    work = linededup.LineDedup(docs([(1, "a b c d e"), (2, "a b c d e f")]))
    plan = work._pairs(4)._jdf.queryExecution().optimizedPlan().toString()
    assert [x.split("[")[1].split(" ")[0].split("#")[0] for x in plan.splitlines() if "Sort [" in x] == ["list"]


def test_no_work_array_reaches_the_size_of_huge_pages():
    assert linededup.SPAN_BYTES * 8 < 1 << 22


def test_only_keeps_the_lines_of_wanted_words():
    raw = np.frombuffer(b"a b c\nd e\n\nf a", dtype=np.uint8)
    found = linededup.Lines.of(0, 1, raw, np.array([0, len(raw)]))
    some = found.only(np.array([True, False, True]))
    assert some.number.tolist() == [0, 3] and some.size.tolist() == [3, 2] and some.starts.tolist() == [0, 3]
    assert some.words.tolist() == [*found.words[:3], *found.words[5:]]
