import pytest
from pyspark.sql import functions as F

from citeharbor.operators import stats, views
from citeharbor.operators.rows import with_row_id
from citeharbor.operators.summary import dataset_summary

from conftest import plan_text

RESEARCH, DOC = "research_article_using_icpsr", "icpsr_data_doc"
COLUMNS = ("seq bigint, title string, doi string, publication_year int, host_venue string, "
           "has_icpsr boolean, icpsr_study_number string, detection_score int, "
           "signal_type string, snippet string, icpsr_work_category string")
ROWS = [
    (0, "Alpha", "10.1/a", 2001, "J1", True, "08079", 3, "study_pattern", "s0", RESEARCH),
    (1, "Beta", None, 2005, "J1", True, "8079", 9, "doi_pattern", "s1", RESEARCH),
    (2, None, "http://x", None, "J2", True, "8079", 9, "doi_pattern", "s2", RESEARCH),
    (3, "Gamma", " ", 2010, None, True, "12", 6, "study_pattern", "s3", RESEARCH),
    (4, "Doc", "10.3886/e1", 2011, "ICPSR", True, "12", 3, "study_pattern", "s4", DOC),
    (5, "Verb", "10.1/v", 2012, "J1", True, None, 3, "verb_context", "s5", RESEARCH),
    (6, "Ref", "10.1/r", 2013, "J3", False, None, None, None, None, RESEARCH),
]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def articles(stored):
    return views.prepare_articles(stored.filter("has_icpsr"))


@pytest.fixture(scope="module")
def datasets(stored):
    return dataset_summary(stored)


def test_summary_and_representative(datasets, stored):
    rows = {r["icpsr_study_number"]: tuple(r)[1:] for r in datasets.collect()}
    assert rows == {
        "08079": (8079, 1, 3, 3.0, "Alpha", "10.1/a", "s0"),
        "8079": (8079, 2, 9, 9.0, "Beta", None, "s1"),
        "12": (12, 2, 6, 4.5, "Gamma", " ", "s3")}
    merged = {r["icpsr_study_number"]: tuple(r)[1:]
              for r in dataset_summary(stored, merge_numbers=True).collect()}
    assert merged == {"8079": (8079, 3, 9, 7.0, "Beta", None, "s1"),
                      "12": (12, 2, 6, 4.5, "Gamma", " ", "s3")}


def test_representative_keeps_first_of_equal_scores(spark):
    rows = [(i, s, "1", True) for i, s in enumerate([3, 9, 9, 3])]
    frame = spark.createDataFrame(
        rows, "seq bigint, detection_score int, icpsr_study_number string, has_icpsr boolean")
    picked = dataset_summary(frame.withColumn("title", F.col("seq").cast("string")))
    assert picked.first()["title"] == "1"


def test_summary_without_columns_is_empty_and_typed(spark):
    empty = dataset_summary(spark.createDataFrame([(1,)], "seq bigint"))
    assert empty.isEmpty() and "n_articles" in empty.columns


def test_overview(articles):
    row = views.overview(articles).first().asDict()
    assert row == {
        "n_identified": 5, "n_research_identified": 4, "n_docs_identified": 1,
        "n_research_linked": 4, "n_journals_linked": 2, "n_datasets_linked": 2,
        "year_min": 2001, "year_max": 2010, "year_range": "2001–2010"}
    nothing = views.overview(articles.filter("false")).first()
    assert nothing["n_identified"] == 0 and nothing["year_range"] == "n/a"


@pytest.mark.parametrize("filters, expected", [
    ({}, [0, 1, 2, 3, 4, 5]),
    ({"only_linked": True}, [0, 1, 2, 3, 4]),
    ({"article_type": "research"}, [0, 1, 2, 3, 5]),
    ({"article_type": "data_doc"}, [4]),
    ({"article_type": "anything else"}, [0, 1, 2, 3, 4, 5]),
    ({"query": "ALPHA|^beta"}, [0, 1]),
    ({"query": "a|b", "mode": "literal"}, []),
    ({"query": "10.1/", "mode": "literal"}, [0, 5]),
    ({"query": "8079", "columns": ("icpsr_study_number",)}, [0, 1, 2]),
    ({"query": "x", "columns": ("absent",)}, [0, 1, 2, 3, 4, 5]),
    ({"year_min": 1900, "year_max": 2030}, [0, 1, 3, 4, 5]),
    ({"year_min": 2005, "year_max": 2010}, [1, 3]),
])
def test_filters(articles, filters, expected):
    rows = views.filter_articles(articles, **filters).collect()
    assert sorted(r["seq"] for r in rows) == expected


def test_filters_reach_the_reader(stored, spark, tmp_path):
    stored.write.parquet(str(tmp_path / "a"))
    table = views.prepare_articles(spark.read.parquet(str(tmp_path / "a")))
    plan = plan_text(views.filter_articles(
        table, only_hits=True, only_linked=True, article_type="research", year_min=2000))
    for pushed in ("EqualTo(has_icpsr,true)", "IsNotNull(icpsr_study_number)",
                   "EqualTo(icpsr_work_category,research_article_using_icpsr)",
                   "GreaterThanOrEqual(publication_year,2000)"):
        assert pushed in plan
    narrow = plan_text(views.overview(table)).split("ReadSchema: ")[1]
    assert "title" not in narrow and "snippet" not in narrow


def test_years_written_as_text(articles):
    text = articles.withColumn("year", F.concat(F.col("year").cast("string"), F.lit(".0")))
    rows = views.filter_articles(text, year_min=2005, year_max=2010).collect()
    assert sorted(r["seq"] for r in rows) == [1, 3]
    assert views.overview(text).first()["year_range"] == "2001–2010"


def test_filter_counts_match_filtering(articles):
    filters = {"query": "j1", "only_linked": True, "year_min": 2000, "year_max": 2030}
    row = views.filter_counts(articles, **filters).first()
    chosen = views.filter_articles(articles, **filters)
    assert row["total_articles"] == 6 and row["total_linked"] == 5 and row["total_data_docs"] == 1
    assert row["filtered_articles"] == chosen.count() == 2
    assert row["filtered_research"] == 2 and row["filtered_data_docs"] == 0


def test_article_table_and_detail(articles):
    table = views.article_table(articles, article_type="research")
    assert [(r["row_id"], r["seq"]) for r in table.orderBy("row_id").collect()] == [
        (0, 0), (1, 1), (2, 2), (3, 3), (4, 5)]
    card = views.article_detail(table, 2).first()
    assert (card["label"], card["title"], card["doi_url"]) == ("[2] ", "", "http://x")
    assert views.article_detail(table, 0).first()["doi_url"] == "https://doi.org/10.1/a"
    assert views.article_detail(table).count() == 5


def test_dataset_views(datasets, articles):
    ranking = views.dataset_ranking(datasets, articles, top_n=5).collect()
    assert [(r["icpsr_study_number"], r["n_articles_using_dataset"], r["n_articles"])
            for r in ranking] == [("08079", 3, 3), ("12", 1, 2)]
    assert ranking[0]["label"] == "08079 · Alpha (n=3)"
    assert ranking[1]["icpsr_link"].endswith("/studies/12")
    assert len(views.dataset_ranking(datasets, articles, top_n=1).collect()) == 1
    assert tuple(views.dataset_totals(datasets, articles).first()) == (2, 2)
    assert sorted(r["seq"] for r in views.dataset_articles(articles, 8079).collect()) == [0, 1, 2]
    assert views.dataset_detail(datasets, 8079).first()["icpsr_study_number"] == "08079"


def test_unused_datasets_drop_out(datasets, articles):
    only_docs = articles.filter(F.col("icpsr_work_category") == DOC)
    assert views.dataset_ranking(datasets, only_docs).isEmpty()


def test_journal_views(datasets, articles):
    ranking = [tuple(r) for r in views.journal_ranking(articles).collect()]
    assert ranking == [("J1", 2, 1, 2001, 2005, "2001–2005"), ("J2", 1, 1, None, None, "n/a")]
    assert len(views.journal_ranking(articles, top_n=1).collect()) == 1
    found = [tuple(r)[:5] for r in
             views.journal_datasets(articles, datasets, "J1").collect()]
    assert found == [("J1", 1, "08079", "Alpha", 2)]
    unknown = views.journal_datasets(articles, datasets.filter("false"), "J1").first()
    assert unknown["icpsr_study_number"] == "8079" and unknown["title"] is None
    assert unknown["icpsr_link"].endswith("/studies/8079")
    assert tuple(views.journal_profile(articles, "J1").first()) == ("J1", 2, 2001, 2005)
    assert [r[0] for r in views.journals(articles).collect()] == ["J1", "J2"]
    assert views.journal_rows(articles, "J1").count() == 2


def test_tables_without_optional_columns(spark):
    bare = views.prepare_articles(spark.createDataFrame([(1, "t")], "seq bigint, title string"))
    assert not bare.first()["has_dataset_link"]
    assert views.research_articles(bare).count() == 1
    assert views.data_documents(bare).count() == 0
    assert views.filter_articles(bare, only_hits=True, year_min=1, query="T").count() == 1
    assert views.overview(bare).first()["n_identified"] == 0
    assert views.filter_counts(bare, query="x").first().asDict() == {
        "total_articles": 1, "total_linked": 0, "filtered_articles": 0, "filtered_linked": 0}
    assert views.journal_ranking(bare).isEmpty() and views.journal_profile(bare).isEmpty()
    assert views.article_detail(views.article_table(bare)).first()["label"] == "[0] t"
    uncategorised = views.prepare_articles(spark.createDataFrame(
        [(1, "5", "J")], "seq bigint, icpsr_study_number string, journal string"))
    row = views.overview(uncategorised).first()
    assert (row["n_research_identified"], row["n_research_linked"], row["n_journals_linked"],
            row["n_datasets_linked"]) == (0, 1, 1, 1)


def test_row_ids_over_many_buckets(spark):
    ids = list(range(0, 3_000_000, 7_919)) + [2**40, 2**40 + 1, 2**53 + 1, 2**53 + 2]
    frame = spark.createDataFrame([(i,) for i in reversed(ids)], "seq bigint")
    rows = with_row_id(frame).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == list(enumerate(ids))


def test_funnel(stored):
    rows = {(r["stage"], r["metric"]): r["value"] for r in stats.funnel_stats(stored).collect()}
    assert rows == {
        ("collected", "total_articles"): 7, ("detection", "rows"): 7,
        ("detection", "with_signal"): 6, ("related", "total"): 6, ("related", "research"): 5,
        ("related", "data_docs"): 1, ("related", "other"): 0, ("related", "with_study_number"): 5,
        ("related", "research_linked"): 4, ("datasets", "distinct"): 3}
    assert rows["related", "research"] + rows["related", "data_docs"] + rows[
        "related", "other"] == rows["related", "total"]


def test_funnel_with_other_columns(stored, spark):
    renamed = stored.withColumn("work_type", F.lit(DOC))
    rows = {r["metric"]: r["value"] for r in stats.funnel_stats(renamed, spark.range(9)).collect()}
    assert rows["data_docs"] == 6 and rows["research"] == 0 and rows["total_articles"] == 9
    bare = stored.drop("icpsr_work_category", "icpsr_study_number")
    metrics = {r["metric"] for r in stats.funnel_stats(bare).collect()}
    assert metrics == {"total_articles", "rows", "with_signal", "total"}
