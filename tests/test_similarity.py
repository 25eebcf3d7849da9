import math
import random
import re
from collections import Counter

from citeharbor.operators import similarity


def brute_force(texts, threshold):
    names = {}
    for study, value in sorted(texts.items()):
        names.setdefault(value, study)
    bags = {s: Counter(re.findall(r"[a-z0-9]+", t.lower())) for t, s in names.items()}
    df = Counter(w for bag in bags.values() for w in bag)
    units = {}
    for study, bag in bags.items():
        raw = {w: n * (math.log((len(bags) + 1) / (df[w] + 1)) + 1) for w, n in bag.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        units[study] = {w: x / length for w, x in raw.items()}
    found = {}
    for a in units:
        for b in units:
            if a < b:
                value = round(sum(x * units[b].get(w, 0) for w, x in units[a].items()), 6)
                if value >= threshold:
                    found[a, b] = value
    return found


def frame(spark, texts):
    return spark.createDataFrame(
        [(s, t, None) for s, t in texts.items()],
        "icpsr_study_number string, title string, snippet string")


def test_pairs_equal_brute_force(spark):
    rng = random.Random(11)
    common = ["survey", "of", "the", "data"]
    texts = {}
    for i in range(60):
        words = common + [f"w{min(int(rng.expovariate(0.25)), 20)}" for _ in range(5)]
        texts[f"{i:03d}"] = " ".join(words)
    texts["100"] = texts["101"] = texts["000"]
    for threshold in (0.3, 0.7, 0.95):
        rows = similarity.similar_groups(frame(spark, texts), threshold).collect()
        got = {(r["study_a"], r["study_b"]): r["similarity"] for r in rows}
        assert got == brute_force(texts, threshold)
        assert got or threshold > 0.9


def test_copies_form_one_group(spark):
    texts = {"3": "same text", "1": "same text", "2": "other words here"}
    rows = {tuple(r) for r in similarity.text_groups(frame(spark, texts)).collect()}
    assert rows == {("1", "1", 2), ("3", "1", 2), ("2", "2", 1)}


def test_clusters_do_not_depend_on_partitioning(spark):
    texts = {str(i): ("alpha beta " if i % 2 else "gamma delta ") + "x" * (i % 3)
             for i in range(20)}
    runs = []
    for parts in (1, 7):
        rows = similarity.cluster_datasets(frame(spark, texts).repartition(parts)).collect()
        runs.append({r["icpsr_study_number"]: r["cluster"] for r in rows})
    assert runs[0] == runs[1] and set(runs[0]) == set(texts)
    assert all(runs[0][a] != runs[0][b] for a in texts for b in texts if int(a) % 2 != int(b) % 2)


def test_clusters_follow_chains_of_links(spark):
    one = similarity.cluster_datasets(frame(spark, {"1": "a"})).collect()
    assert [(r["icpsr_study_number"], r["cluster"]) for r in one] == [("1", "1")]
    chain = similarity.cluster_datasets(frame(spark, {
        "1": "a b c d", "2": "c d e f", "3": "e f g h", "4": "p q"}), threshold=0.3)
    assert {r["icpsr_study_number"]: r["cluster"] for r in chain.collect()} == {
        "1": "1", "2": "1", "3": "1", "4": "4"}


def random_texts(seed, n, common):
    rng = random.Random(seed)
    return {f"{i:03d}": " ".join(common + [f"w{min(int(rng.expovariate(0.25)), 20)}" for _ in range(5)])
            for i in range(n)}


def test_lists_in_blocks_lose_no_pair(spark):
    texts = random_texts(3, 90, ["hot"])
    for threshold in (0.2, 0.5, 0.8):
        want = brute_force(texts, threshold)
        for list_rows in (1, 5, 40):
            rows = similarity.similar_groups(frame(spark, texts), threshold, list_rows=list_rows).collect()
            assert {(r["study_a"], r["study_b"]): r["similarity"] for r in rows} == want


def test_a_hot_term_is_spread_over_many_small_groups(spark):
    """A list of 20,000 texts comes out in groups of at most two blocks, and in not too many copies."""
    n, list_rows = 20_000, 500
    prefix = spark.range(n).selectExpr(
        "CAST(id AS string) group_study", "'hot' term", "0.4 + 0.5 * id / 20000 weight", "0.1D rest")
    rows = similarity.dealt(prefix.withColumn("weight", prefix["weight"].cast("double")), 0.5, list_rows)
    groups = rows.groupBy("low", "high").count().collect()
    assert max(g["count"] for g in groups) <= 3 * list_rows and len(groups) > 50
    assert {int(r[0]) for r in rows.select("group_study").distinct().collect()} == set(range(n))


def plain_complete(links, nodes):
    """One best pair at a time."""
    sim = {**links, **{(b, a): s for (a, b), s in links.items()}}
    parts = {n: [n] for n in nodes}
    while True:
        best = None
        for a in parts:
            for b in parts:
                far = [sim.get((x, y)) for x in parts[a] for y in parts[b]]
                if a < b and None not in far:
                    best = min(best or (1, "", ""), (-min(far), a, b))
        if best is None:
            return {x: n for n, xs in parts.items() for x in xs}
        parts[best[1]] += parts.pop(best[2])


def test_complete_clusters_equal_merging_one_pair_at_a_time(spark):
    rng = random.Random(5)
    nodes = [f"{i:02d}" for i in range(30)]
    for share in (0.15, 0.5, 0.95):
        levels = rng.sample(range(1, 10_000), 435)
        links = {(a, b): levels.pop() / 10_000 for a in nodes for b in nodes if a < b and rng.random() < share}
        given = spark.createDataFrame([(a, b, s) for (a, b), s in links.items()],
                                      "study_a string, study_b string, similarity double")
        for parts in (1, 5):
            got = {r["node"]: r["root"] for r in similarity.complete_clusters(given.repartition(parts)).collect()}
            assert {n: got.get(n, n) for n in nodes} == plain_complete(links, nodes)


def test_complete_clusters_with_ties_meet_the_bound(spark):
    links = {(f"{i:02d}", f"{i + 1:02d}"): 0.5 for i in range(20)}
    given = spark.createDataFrame([(a, b, s) for (a, b), s in links.items()],
                                  "study_a string, study_b string, similarity double")
    got = {r["node"]: r["root"] for r in similarity.complete_clusters(given).collect()}
    assert all(n == root or (root, n) in links for n, root in got.items()) and got["01"] == "00"
    assert similarity.complete_clusters(given.limit(0)).collect() == []


def test_complete_linkage_breaks_chains_and_returns_its_matrix(spark):
    texts = random_texts(8, 50, ["survey", "data"])
    texts["900"] = texts["901"] = texts["000"]
    rows, matrix = similarity.clusters_and_matrix(frame(spark, texts), 0.5, "complete")
    cluster = {r["icpsr_study_number"]: r["cluster"] for r in rows.collect()}
    got = {(r["study_a"], r["study_b"]): r["similarity"] for r in matrix.collect()}
    want = brute_force(texts, 0.5)
    first = {t: s for s, t in sorted(texts.items(), reverse=True)}
    whole = {**want, **{(b, a): s for (a, b), s in want.items()}, **{(s, s): 1.0 for s in first.values()}}
    assert got == whole and set(cluster) == set(texts)
    assert all((first[texts[a]], first[texts[b]]) in whole for a in texts for b in texts if cluster[a] == cluster[b])
    chain = similarity.cluster_datasets(frame(spark, {
        "1": "a b c d", "2": "c d e f", "3": "e f g h", "4": "p q"}), 0.3, "complete")
    assert {r["icpsr_study_number"]: r["cluster"] for r in chain.collect()} == {"1": "1", "2": "1", "3": "3", "4": "4"}
