"""SimHash near duplicates against brute force."""

import random
import re

import pytest
import xxhash

from citeharbor.llm import simhash
from citeharbor.operators.components import components
from tests.llm.conftest import edge_rows


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, max_bits=4):
    """Smallest position reachable for each fingerprint."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def expected(rows):
    values = [plain_fingerprint(t) for _, t in rows]
    groups = grouped(values)
    out = []
    for (i, _), v, g in zip(rows, values, groups):
        ids = [rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None]
        out.append((i, f"{v:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_documents_match_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = sorted(map(tuple, simhash.near_duplicates(table).collect()), key=repr)
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_edge_cases(docs):
    rows = edge_rows()
    got = sorted(map(tuple, simhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == expected(rows)
    assert simhash.near_duplicates(docs([])).collect() == []


@pytest.mark.parametrize("list_rows", [8, 1024])
def test_links_keep_every_near_pair_connected(spark, monkeypatch, list_rows):
    monkeypatch.setattr(simhash, "LIST_ROWS", list_rows)
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            mask = sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))
            values.add(center ^ mask)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(frame).distinct()
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(v, v) for v in values]
    assert got == [values[g] for g in grouped([v & (1 << 64) - 1 for v in values])]
    assert edges.count() < 70 * len(values)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + chain + [(5, 5), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def test_keep_one(docs):
    kept = simhash.keep_one(docs([(3, "a b c d e"), (1, "a b c d e"), (2, "other words"), (None, "a b c d e")]))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, None]
    assert "fp" in kept.columns


def test_tally_rejects_pairs_of_a_list_before_bits_are_compared(spark, monkeypatch):
    """Pairs that agree on the three positions of a list and on no other byte never reach the bit count."""
    base = 0x0123456789ABCDEF
    five = base ^ 0x0101010101  # five bytes differ, by one bit each
    four = base ^ 0x8080808000000000
    assert simhash.tally(simhash.np.array([base ^ five, base ^ four], dtype="uint64")).tolist() == [3, 4]
    assert len(simhash._masks(4)) == 56 and len(simhash._masks(7)) == 8
    verified = []

    class Counting:
        def __getattr__(self, name):
            return getattr(simhash_np, name)

        def bitwise_count(self, values):
            verified.extend(values.tolist())
            return simhash_np.bitwise_count(values)
    simhash_np = simhash.np
    monkeypatch.setattr(simhash, "np", Counting())
    left, right = simhash._forest(simhash_np.array([base, five, four], dtype=simhash_np.uint64), 4)
    assert list(zip(left, right)) == [(base, four)] and base ^ five not in verified
