"""Views from the rollup equal those from the articles, also after merging batches."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from citeharbor.operators import rollup, views

RESEARCH, DOC = "research_article_using_icpsr", "icpsr_data_doc"


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(8)
    numbers = [None, "08079", "8079", "12", "0", "-5", "32768", "32769", "65536", "not one", "99999999"]
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice([None, 1999, 2005, 2020]), rng.choice([RESEARCH, RESEARCH, DOC, None]),
             rng.random() < 0.7, rng.choice(numbers)) for i in range(900)]
    frame = spark.createDataFrame(rows, "seq long, journal string, year int, icpsr_work_category string, has_icpsr boolean, "
                                        "icpsr_study_number string")
    return views.prepare_articles(frame)


@pytest.fixture(scope="module")
def table(articles):
    batches = [rollup.rollup(articles.filter(F.col("seq") % 3 == k)) for k in range(3)]
    return reduce(rollup.merged, batches).cache()


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(map(str, r)) for r in frame.select(*names).collect())


def test_views_equal_those_of_the_articles(articles, table):
    assert rows(rollup.overview(table)) == rows(views.overview(articles))
    for top in (None, 2):
        assert rows(rollup.journal_ranking(table, top)) == rows(views.journal_ranking(articles, top))
    assert rows(rollup.journal_profile(table)) == rows(views.journal_profile(articles))
    assert rows(rollup.journal_profile(table, "B")) == rows(views.journal_profile(articles, "B"))


@pytest.mark.parametrize("filters", [
    {}, {"only_hits": True}, {"only_linked": True, "year_min": 2000}, {"article_type": "research", "year_max": 2005},
    {"article_type": "data_doc", "only_hits": True, "only_linked": True, "year_min": 1999, "year_max": 2019}, {"article_type": "?"}])
def test_counts_equal_those_of_the_articles(articles, table, filters):
    assert rows(rollup.filter_counts(table, **filters)) == rows(views.filter_counts(articles, **filters))


def test_bitmaps_are_bounded_and_the_table_is_small(articles, table):
    sizes = table.agg(F.max(F.octet_length("datasets")), F.sum("n"), F.count("*")).first()
    assert sizes[0] <= 4096 and sizes[1] == 900 and sizes[2] < 500
    assert rows(table.select(*rollup.KEYS, rollup.RANGE, "n")) == rows(rollup.rollup(articles).select(*rollup.KEYS, rollup.RANGE, "n"))


def test_empty_and_incomplete_tables(spark, articles):
    empty = rollup.rollup(articles.limit(0))
    assert rows(rollup.overview(empty)) == rows(views.overview(articles.limit(0)))
    assert rollup.journal_ranking(empty).count() == 0 and rollup.filter_counts(empty).first()["total_articles"] == 0
    with pytest.raises(ValueError, match="icpsr_work_category"):
        rollup.rollup(articles.drop("icpsr_work_category"))
