"""Runs of repeated words against a plain search over all periods, and the query against a plain model."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from citeharbor.llm import periods
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


def plain_runs(words):
    """Every maximal stretch of every period, then those with a smaller period removed."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(24, 3 * q):
                stretch = words[start:i]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found[start, length, q] = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    """Repeats within repeats, cut at any place, with single words changed."""
    letters = rng.randint(1, 4)
    out = [rng.randrange(letters) for _ in range(rng.randint(0, 12))]
    for _ in range(rng.randint(0, 4)):
        out = out + [rng.randrange(letters + 2) for _ in range(rng.randint(0, 6))]
        k = rng.randint(0, len(out))
        out = (out[k:] * rng.randint(1, 6))[:300] + out[:k]
        if out and rng.random() < 0.4:
            out[rng.randrange(len(out))] = 99
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_all_periods(seed):
    rng, some = random.Random(seed), 0
    for _ in range(400):
        words = random_words(rng)
        runs = periods.find_runs(words)
        assert runs == plain_runs(words), words
        some += bool(runs)
    assert some > 40


def test_long_periods_and_nested_runs():
    rng = random.Random(1)
    block = [rng.randrange(1000) for _ in range(331)]
    inner = [7] * 30 + [8]
    for words in (block * 3, block * 3 + block[:5], block + block + block[:-1], inner * 9, [1] + inner * 4 + block,
                  [5] * 23, [5] * 24, [1, 2] * 12, (block[:9] * 3)[:26], block[:8] * 3):
        assert periods.find_runs(words) == plain_runs(words)


def test_texts_of_one_word_take_little_time():
    assert periods.find_runs([3] * 200_000) == [(0, 200_000, 1)]
    assert periods.find_runs([3, 4, 5] * 60_000 + [3]) == [(0, 180_001, 3)]


def canonical(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_edge_rows_and_planted_runs(docs):
    rng = random.Random(4)
    rows = [r for r in edge_rows() if r[0] != 7] + [
        (100 + i, " \n".join(map(str, random_words(rng)))) for i in range(120)]
    got = periods.digest(periods.periodic_runs(periods.with_planted_runs(docs(rows).repartition(3))))
    assert canonical(map(tuple, got.collect())) == canonical(plain_row(*r) for r in rows)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[1])


def test_very_long_text(docs):
    row = periods.periodic_runs(docs([(7, "x y " * 30_000)])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 60_000, 2)] == [tuple(row["strongest"])]
    assert row["collapsed"] == "x y" and row["n_words"] == 60_000


def test_empty_table(docs):
    assert periods.digest(periods.periodic_runs(periods.with_planted_runs(docs([])))).count() == 0


def test_query_on_the_whole_table(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    short = {r["doc_id"] for r in documents if len((r["text"] or "").split()) <= 1500}
    assert canonical(tuple(r) for r in got if r["doc_id"] in short) == canonical(
        plain_row(*r) for r in documents if r["doc_id"] in short)
    assert len(got) == len(documents) and sum(r["n_runs"] > 0 for r in got) > 5
