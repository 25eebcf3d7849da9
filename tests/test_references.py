import json
import random

from citeharbor.operators import linkmap, references
from citeharbor.operators.detect import with_detection

from conftest import plan_text

MAP = "seq bigint, openalex_work_id string, icpsr_doi string, icpsr_study_number bigint"


def test_last_non_null_attribute_wins(spark):
    rows = [(1, "a", "d1", 1), (2, "a", None, 2), (3, "a", "d3", None), (4, None, "x", 9),
            (5, "b", "", 0), (6, "c", "late", 7), (7, "c", "", None)]
    works = {r["work_id"]: (r["doi"], r["study"])
             for r in references.mapped_works(spark.createDataFrame(rows, MAP)).collect()}
    assert works == {"a": ("d3", "2"), "b": (None, None), "c": (None, "7")}


def test_hits_against_brute_force(spark):
    rng = random.Random(7)
    ids = [f"w{i}" for i in range(30)]
    mapped = {w: (rng.choice(["dA", "dB", None]), rng.choice([11, 2, None]))
              for w in rng.sample(ids, 10)}
    cells = [[rng.choice(ids) for _ in range(rng.randrange(8))] for _ in range(200)]
    articles = spark.createDataFrame(
        [(i, json.dumps(c)) for i, c in enumerate(cells)], "seq bigint, referenced_works string")
    work_map = spark.createDataFrame(
        [(i, w, d, s) for i, (w, (d, s)) in enumerate(mapped.items())], MAP)
    got = {r["seq"]: tuple(r)[2:] for r in
           references.with_references(articles, work_map).collect()}
    for i, cell in enumerate(cells):
        found = [w for w in cell if w in mapped]
        expected = (bool(found), ";".join(found),
                    ";".join(sorted({mapped[w][0] for w in found} - {None})),
                    ";".join(sorted({str(mapped[w][1]) for w in found} - {"None"})))
        assert got[i] == expected


def test_reference_arrays(spark):
    rows = [(1, ["w1", None, "None"]), (2, []), (3, None)]
    articles = spark.createDataFrame(rows, "seq bigint, referenced_works array<string>")
    edges = references.citation_edges(articles)
    assert [tuple(r) for r in edges.collect()] == [(1, 0, "w1"), (1, 1, "None"), (1, 2, "None")]


def test_no_map_or_no_references(spark):
    articles = spark.createDataFrame([(1, "x")], "seq bigint, title string")
    empty = spark.createDataFrame([], MAP)
    for frame, work_map in ((articles, empty), (articles, None)):
        row = references.with_references(frame, work_map).first()
        assert tuple(row)[2:] == (False, "", "", "")


def test_small_map_is_broadcast_by_its_size(spark, tmp_path):
    spark.createDataFrame([(1, "w1", "d", 1)], MAP).write.parquet(str(tmp_path / "m"))
    articles = spark.range(10).selectExpr("id seq", "'[\"w1\"]' referenced_works")
    articles.write.parquet(str(tmp_path / "a"))
    stored_map = spark.read.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert "BroadcastHashJoin" in plan_text(references.with_references(stored, stored_map))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, -1)
    try:
        plan = plan_text(references.with_references(stored, stored_map))
    finally:
        spark.conf.unset(limit)
    assert "Broadcast" not in plan


def test_reference_branch_has_no_detection(spark):
    articles = spark.createDataFrame(
        [(1, "t", "[]", None, None)],
        "seq bigint, fulltext string, referenced_works string, doi string, host_venue string")
    full = references.with_evidence(articles, spark.createDataFrame([], MAP))
    assert plan_text(full).count("Generate inline") == 1
    assert set(with_detection(articles).columns) < set(full.columns)


def test_pairs_are_counted(spark):
    edges = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "z")], "work bigint, work_id string")
    works = spark.createDataFrame([("a", "d", "1"), ("b", None, "2")],
                                  "work_id string, doi string, study string")
    rows = sorted(tuple(r) for r in references.matched_pairs(edges, works, "work").collect())
    assert rows == [(1, "a", "d", "1", 2), (1, "b", None, "2", 1), (2, "a", "d", "1", 1)]


def test_build_map(spark):
    datasets = spark.createDataFrame(
        [(" 1 ", "https://doi.org/10.1/A", "t1"), ("2", None, "t2"), ("3", "", "t3"),
         ("4", "10.9/none", "t4")], "icpsr_study_number string, doi string, title string")
    works = spark.createDataFrame(
        [(2, "w2", "10.1/a"), (1, "w1", "HTTP://dx.doi.org/10.1/a"), (0, "w0", None)],
        "seq bigint, id string, doi string")
    rows = sorted(tuple(r) for r in linkmap.build_work_map(datasets, works).collect())
    assert rows == [("1", "10.1/A", "t1", "w1"), ("4", "10.9/none", "t4", None)]


def test_build_map_needs_its_columns(spark):
    import pytest
    bare = spark.createDataFrame([("1",)], "icpsr_study_number string")
    with pytest.raises(ValueError, match="doi"):
        linkmap.build_work_map(bare, bare)


def test_bitmap_spares_edges_and_changes_no_result(spark):
    rows = [(i, [f"w{(i * 7 + k) % 5000}" for k in range(20)] + [None, "w1"]) for i in range(400)] + [(400, None), (401, [])]
    articles = spark.createDataFrame(rows, "seq bigint, referenced_works array<string>")
    work_map = spark.createDataFrame(
        [(f"w{i}", str(i), f"10/{i}", i) for i in range(0, 300, 3)] + [(None, "9", "10/9", 900), ("w1", None, None, 901)],
        "openalex_work_id string, icpsr_study_number string, icpsr_doi string, seq bigint")
    plain = references.with_references(articles, work_map).drop("referenced_works")
    spared = references.with_references(articles, work_map, prefilter=True).drop("referenced_works")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spared.collect()))
    works = references.mapped_works(work_map)
    every, few = references.citation_edges(articles), references.citation_edges(articles, among=works)
    real = references.matched_edges(every, works)
    assert real.count() <= few.count() <= real.count() + 5 < every.count() / 5
    assert sorted(map(tuple, few.join(works, "work_id", "left_semi").select("seq", "pos").collect())) == sorted(
        map(tuple, real.select("seq", "pos").collect()))
    full = references.citation_edges(articles, among=works, bits=6)  # nearly all bits set: lets all pass
    assert real.count() <= full.count() <= every.count()


def test_bitmap_filter_comes_before_the_rows(spark):
    articles = spark.createDataFrame([(1, ["w1"])], "seq bigint, referenced_works array<string>")
    works = spark.createDataFrame([("w1",)], "work_id string")
    plan = plan_text(references.citation_edges(articles, among=works))
    assert plan.index("inline") < plan.index("getbit") and "Join" not in plan and "Python" not in plan
