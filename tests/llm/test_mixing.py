"""Mixing: targets met, the classifier against a plain version, odd input."""

import math

import numpy as np
import pytest

from citeharbor.llm import mixing
from citeharbor.llm.queries import DOMAIN_WEIGHTS, QUERIES
from tests.llm.conftest import edge_rows


def test_documents(spark, sf_dir):
    rows = QUERIES["op5_mixing"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    total = sum(r.n_tokens for r in rows)
    for d, share in DOMAIN_WEIGHTS.items():
        got = sum(r[f"p_{d}"] * r.n_tokens * r.rate for r in rows) / total
        assert abs(got - share) < 0.02
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    assert all(abs(sum(r[f"p_{d}"] for d in DOMAIN_WEIGHTS) - 1) < 1e-9 for r in rows)
    used = sum(r.copies * r.n_tokens for r in rows)
    assert abs(used / total - 1) < 0.1


def parts(spark):
    rows = [(i, "plain words here " * 5, "en") for i in range(90)] + [(100 + i, "##%% 123 $$ " * 5, "de") for i in range(10)]
    docs = spark.createDataFrame([(i, t, l, "x", 1.0) for i, t, l in rows],
                                 "doc_id long, text string, lang string, domain string, rate double")
    labels = spark.createDataFrame([(i, "a") for i in range(40)] + [(100 + i, "b") for i in range(5)] + [(None, "a"), (1, None)],
                                   "doc_id long, domain string")
    return docs, labels


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 3, "b": 1}, {"a": 1}])
def test_targets_are_met(spark, weights):
    docs, labels = parts(spark)
    rows = mixing.judged(docs, labels, weights).collect()
    total = sum(r.n_tokens for r in rows)
    for d in "ab":
        got = sum(r.posterior[d] * r.n_tokens * r.rate for r in rows)
        assert abs(got - total * weights.get(d, 0) / sum(weights.values())) < 0.02 * total
    assert min(r.rate for r in rows) >= 0


@pytest.mark.parametrize("weights", [{"b": 2}, {"a": 1, "b": 9}])
def test_least_squares_as_near_as_a_long_plain_descent(spark, weights):
    """Where soft posteriors cannot meet the targets, the fit is as near as many steps in numpy get."""
    docs, labels = parts(spark)
    rows = mixing.judged(docs, labels, weights).collect()
    p = np.array([[r.posterior[d] for d in "ab"] for r in rows])
    n = np.array([float(r.n_tokens) for r in rows])
    base = n @ p
    target = n.sum() * np.array([weights.get(d, 0) for d in "ab"]) / sum(weights.values())

    def residual(rate):
        return float((((rate * n) @ p - target) ** 2 / base).sum())

    rate = np.ones(len(n))
    for _ in range(20_000):
        rate = np.maximum(rate - p @ (((rate * n) @ p - target) / base), 0)
    assert residual(np.array([r.rate for r in rows])) <= 1.02 * residual(rate) + 1e-3 * n.sum()


def test_keep_all_drops_nothing(spark):
    docs, labels = parts(spark)
    rows = mixing.repeated(docs, labels, {"a": 1, "b": 1}).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert set(rows[0].asDict()) == set(docs.columns)
    assert sum(r.doc_id >= 100 for r in rows) > 30


def test_edge_cases(docs, spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (4, "a"), (4, "b"), (8, "b")], "doc_id long, domain string")
    rows = edge_rows()
    got = mixing.judged(docs(rows), labels, {"a": 1, "b": 1}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    assert all(r.n_tokens == len((dict(rows)[r.doc_id] or "").encode().split()) for r in got if r.doc_id not in (None, 4))
    nothing = spark.createDataFrame([], "doc_id long, domain string")
    assert {(r.rate, r.copies) for r in mixing.judged(docs(rows), nothing, {"a": 1}).collect()} == {(1.0, 1)}
    assert mixing.judged(docs([]), labels, {"a": 1}).collect() == []


def test_whole_query_runs_no_python(spark, sf_dir):
    plan = QUERIES["op5_mixing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_three_domains_that_overlap_meet_their_targets(spark):
    """Weakly separated posteriors with a rare domain: plain gradient steps need thousands."""
    rng = np.random.default_rng(4)
    share = np.array([0.60, 0.38, 0.02])
    kind = rng.choice(3, 2000, p=share)
    seen = np.array([[0.0, 0.0], [0.8, 0.0], [0.4, 0.8]])[kind] + rng.normal(size=(2000, 2))
    far = ((seen[:, None, :] - np.array([[0.0, 0.0], [0.8, 0.0], [0.4, 0.8]])) ** 2).sum(axis=2)
    p = share * np.exp(-far / 2)
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(50, 500, 2000).astype(float)
    soft = spark.createDataFrame([(x.tolist(), t) for x, t in zip(p, n.tolist())], "posterior array<double>, tokens double")
    target = n.sum() * np.array([0.80, 0.15, 0.05])
    rows = soft.withColumn("rate", mixing.fit_rates(soft, target.tolist())).collect()
    rate = np.array([r.rate for r in rows])
    got = np.array([r.rate * r.tokens * np.array(r.posterior) for r in rows]).sum(axis=0)
    assert rate.min() >= 0 and np.abs(got - target).max() < 0.001 * n.sum()
    base, plain = n @ p, np.ones(len(n))
    for _ in range(30):
        plain = np.maximum(plain - p @ (((plain * n) @ p - target) / base), 0)
    assert np.abs((plain * n) @ p - target).max() > 0.01 * n.sum()


def test_a_fit_that_does_not_settle_is_an_error(spark):
    soft = spark.createDataFrame([([0.9, 0.1], 100.0), ([0.2, 0.8], 50.0)], "posterior array<double>, tokens double")
    with pytest.raises(RuntimeError, match="settle"):
        mixing.fit_rates(soft, [10.0, 140.0], steps=0)


@pytest.mark.parametrize("floor,share", [(0.0, [0.8, 0.15, 0.05]), (1.0, [0.8, 0.15, 0.05]), (0.0, [0.1, 0.1, 0.8])])
def test_no_rate_can_be_moved_to_come_nearer(spark, floor, share):
    """Plain gradient of the squares at the fitted rates: zero where a rate is free, upwards at the floor."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([3.0, 2.0, 0.3], 500)
    n = rng.integers(1, 400, 500).astype(float)
    soft = spark.createDataFrame([(x.tolist(), t) for x, t in zip(p, n.tolist())], "posterior array<double>, tokens double")
    target = n.sum() * np.array(share)
    rows = soft.repartition(3).withColumn("rate", mixing.fit_rates(soft, target.tolist(), floor)).collect()
    rate, q, m = (np.array([r[c] for r in rows]) for c in ("rate", "posterior", "tokens"))
    slope = q @ (((rate * m) @ q - target) / (m @ q))
    assert rate.min() >= floor and np.abs(slope[rate > floor]).max() < 1e-3 and slope[rate <= floor].min(initial=0) > -1e-3


def test_effective_share(spark):
    assert mixing.effective_share(spark.createDataFrame([(10, 2.0)] * 4, "n_tokens long, rate double")) == pytest.approx(1)
    one = spark.createDataFrame([(10, 4.0)] + [(10, 0.0)] * 3, "n_tokens long, rate double")
    assert mixing.effective_share(one) == pytest.approx(0.25)


def test_labels_are_no_broadcast_however_few(spark, docs, monkeypatch):
    """They grow with the documents, and so must what is shuffled for them, from the start."""
    plans, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), cut(df))[1])
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")
    mixing.learn(mixing.properties(docs([(1, "x y"), (2, "z")])), labels)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
