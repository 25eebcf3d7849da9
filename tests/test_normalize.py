import pytest
from pyspark.sql import functions as F

from citeharbor import schemas
from citeharbor.operators import normalize

from conftest import plan_text


def work(**fields):
    base = dict.fromkeys(schemas.WORKS.names)
    base.update(fields)
    return tuple(base[n] for n in schemas.WORKS.names)


def test_flatten_full_and_empty_work(spark):
    full = work(
        id="W1", title="T", doi="10.1/x", publication_year=2001, referenced_works=["W2", "Wé"],
        abstract_inverted_index={"b": [1], "a": [0]}, open_access=(True, "gold", "http://oa"),
        ids=("https://doi.org/10.1/x", "http://alex/W1"),
        primary_location=("http://landing", "http://pdf", ("Venue",)))
    rows = normalize.flatten_works(
        spark.createDataFrame([full, work(id="W3")], schemas.WORKS)).collect()
    assert rows[0].asDict() == {
        "id": "W1", "title": "T", "doi": "10.1/x", "publication_year": 2001, "is_oa": True,
        "host_venue": "Venue", "abstract_text": "a b", "fulltext_url": "http://pdf",
        "record_url": "https://doi.org/10.1/x", "referenced_works": '["W2","Wé"]'}
    assert rows[1]["record_url"] == "W3" and rows[1]["referenced_works"] == "[]"
    assert rows[1]["fulltext_url"] is None and rows[1]["abstract_text"] is None


@pytest.mark.parametrize("status, oa_url, landing, pdf, expected", [
    ("gold", "oa", "land", "pdf", "pdf"), ("gold", "oa", "land", "", "land"),
    ("gold", "oa", None, None, "oa"), ("", "oa", "", None, None), (None, "oa", None, None, None)])
def test_fulltext_url(spark, status, oa_url, landing, pdf, expected):
    frame = spark.createDataFrame(
        [work(open_access=(True, status, oa_url), primary_location=(landing, pdf, None))],
        schemas.WORKS)
    assert normalize.flatten_works(frame).first()["fulltext_url"] == expected


@pytest.mark.parametrize("doi, landing, openalex, expected", [
    ("d", "l", "o", "d"), (None, "l", "o", "l"), ("", "", "o", "o"), (None, None, None, "W")])
def test_record_url(spark, doi, landing, openalex, expected):
    frame = spark.createDataFrame(
        [work(id="W", ids=(doi, openalex), primary_location=(landing, None, None))],
        schemas.WORKS)
    assert normalize.flatten_works(frame).first()["record_url"] == expected


def test_dedupe(spark):
    frame = spark.createDataFrame(
        list(enumerate([None, "a", None, "a", "b"])), "seq bigint, doi string")
    kept = {k: sorted(r["seq"] for r in normalize.dedupe_by_doi(frame, null_key=k).collect())
            for k in ("keep", "collapse")}
    assert kept == {"keep": [0, 1, 2, 4], "collapse": [0, 1, 4]}
    with pytest.raises(ValueError):
        normalize.dedupe_by_doi(frame, null_key="drop")


def test_dedupe_limits_each_task_before_the_shuffle(spark):
    frame = spark.range(10).select(F.col("id").alias("seq"), F.hex("id").alias("doi"))
    plan = plan_text(normalize.dedupe_by_doi(frame))
    assert plan.count("WindowGroupLimit") == 2


def test_union_keeps_request_order(spark):
    first = spark.createDataFrame([(5, "a")], "seq bigint, doi string")
    second = spark.createDataFrame([("a", 1), ("b", 2)], "doi string, seq bigint")
    union = normalize.union_results([first, second])
    assert union.count() == 3
    kept = normalize.dedupe_by_doi(union, ("query_ord", "seq")).collect()
    assert sorted((r["query_ord"], r["seq"]) for r in kept) == [(0, 5), (1, 7)]


def test_source_filter_reaches_the_reader(spark, tmp_path):
    rows = [(True, 2000, "About ICPSR", None), (False, 2001, "ICPSR", None),
            (True, 1999, "ICPSR", None), (True, 2024, None, "x inter-university consortium for "
            "political and social research"), (True, 2010, "other", "none")]
    spark.createDataFrame(rows, "is_oa boolean, publication_year int, title string, "
                          "abstract_text string").write.parquet(str(tmp_path / "w"))
    kept = normalize.source_filter(spark.read.parquet(str(tmp_path / "w")))
    assert sorted(r["publication_year"] for r in kept.collect()) == [2000, 2024]
    plan = plan_text(kept)
    assert "EqualTo(is_oa,true)" in plan and "GreaterThanOrEqual(publication_year,2000)" in plan
