"""Nearest neighbours: recall against brute force, ties, odd vectors."""

import numpy as np
import pytest

from citeharbor.llm import ann
from citeharbor.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, id long, vector string, leaf int"


def exact(vectors, query, k=20):
    """Ids and scores of the best vectors, sums from the first component to the last."""
    out = []
    for i, v in vectors.items():
        if i != query:
            total = 0.0
            for a, b in zip(vectors[query], v):
                total += float(a) * float(b)
            out.append((-total, i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def check(rows, vectors, k=20, least=0.9):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, got in found.items():
        got.sort(key=lambda r: r["rank"])
        want = exact(vectors, q, k)
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) == len(want)
        assert sorted(got, key=lambda r: (-r.score, r.vec_id)) == got
        scores = dict(exact(vectors, q, len(vectors)))
        assert all(r.score == scores[r.vec_id] for r in got)
        hits += len({r.vec_id for r in got} & {i for i, _ in want})
        total += len(want)
    assert not total or hits / total >= least
    return found


def test_embeddings(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = check(QUERIES["op10_nearest"](spark, sf_dir).collect(), vectors)
    assert set(found) == {i for i in vectors if i % 20 == 0}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS)


def test_clusters_with_many_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    points = np.concatenate([c + 0.1 * rng.normal(size=(40, 16)) for c in centres] + [np.tile(centres[0], (500, 1))])
    rows = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    table = frame(spark, rows)
    got = ann.nearest_neighbours(table, table.filter("vec_id % 50 = 0"), k=20, sample=400, part=64).collect()
    check(got, {i: np.array(v, dtype=np.float32) for i, v in rows})


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [2.0, 0.0])]
    table = frame(spark, rows)
    got = ann.nearest_neighbours(table, table.filter("vec_id = 7"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(100, 2.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]


def test_odd_vectors_take_no_part(spark):
    good = [(1, [1.0, 2.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0])]
    bad = [(4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []),
           (10, [1.0]), (None, [1.0, 1.0])]
    table = frame(spark, good + bad)
    got = ann.nearest_neighbours(table, table, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [
        (1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 1.0])], [(1, None)]])
def test_too_few_vectors(spark, rows):
    table = frame(spark, rows)
    got = ann.nearest_neighbours(table, table)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.collect() == []


def test_isolated_vectors_get_full_lists_beside_large_groups(spark):
    """Probes in large groups reach their recall in few leaves; sparse regions need more of them."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 12))
    alone = 3 * rng.normal(size=(60, 12))
    points = np.concatenate([np.repeat(centres, 1000, axis=0), alone]).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    table = frame(spark, rows)
    queries = table.filter("vec_id % 20 = 0 or vec_id >= 4000")
    got = ann.nearest_neighbours(table, queries, k=20, branch=4, leaf=2).collect()
    n = {}
    for r in got:
        n[r.query_id] = n.get(r.query_id, 0) + 1
    assert set(n.values()) == {20} and len(n) == queries.count()


def test_walk_goes_on_until_the_leaves_hold_enough():
    rng = np.random.default_rng(1)
    tree = ann.grow(rng.normal(size=(200, 4)), 6.0, branch=4, leaf=2)
    tree.held = np.ones(tree.leaves, dtype=np.int64)
    assert len(tree.best_first(np.ones(4), 8, 21)) == 21
    assert len(tree.best_first(np.ones(4), 8, 5)) == 8
    assert len(tree.best_first(np.ones(4), 8, 10 ** 6)) == tree.leaves


def test_leaves_share_shelves_and_large_leaves_take_several():
    tree = ann.Tree(np.zeros((1, 2)), [range(0)], np.array([0]), 1.0)
    tree.place(np.array([30, 40, 50, 250, 0, 10, 100]), 100)
    assert tree.shelf.tolist() == [0, 0, 1, 2, 4, 5, 6] and tree.shelves.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_shelf_leaves_out_only_copies_that_cannot_be_found():
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(6, 5)), 40, axis=0)
    ids = rng.permutation(240)
    leaves = np.sort(rng.integers(0, 3, 240))
    shelf = ann.Shelf(np.append(ids, ids[:9]), np.append(leaves, leaves[:9]), np.vstack([vectors, vectors[:9]]), 7)
    assert len(shelf.ids) < 240
    asked = ids[::11]
    at, near, scores = shelf.best(asked, vectors[::11], [np.array([0, 2]), np.array([1])] * (len(asked) // 2))
    for q, query in enumerate(asked):
        seen = np.isin(leaves, [0, 2] if q % 2 == 0 else [1])
        rows = {int(i): v for i, v, s in zip(ids, vectors, seen) if s or i == query}
        want = exact({**rows, query: vectors[::11][q]}, query, 7)
        assert list(zip(near[at == q].tolist(), scores[at == q].tolist())) == want


def test_many_queries_of_a_shelf_are_answered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(ann, "VISIT_ROWS", 8)
    rng = np.random.default_rng(8)
    rows = [(i, p.tolist()) for i, p in enumerate(rng.normal(size=(300, 6)).astype(np.float32))]
    table = frame(spark, rows)
    got = ann.nearest_neighbours(table, table, k=4, recall=1.0, branch=3, leaf=8, part=50).collect()
    assert len(check(got, {i: np.array(v, dtype=np.float32) for i, v in rows}, k=4, least=0.97)) == 300
