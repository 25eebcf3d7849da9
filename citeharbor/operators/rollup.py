"""Counts by journal, year, category and flags, from which the report views are answered without articles.

A row counts the works of one combination whose dataset numbers lie in one range of 32,768, and has those
numbers as a bitmap; works without a number have no range. Counts add up and bitmaps unite, so distinct
numbers stay exact over any choice of rows, and the table of a new batch is merged into the stored one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.identifiers import DATA_DOCUMENT, RESEARCH
from citeharbor.functions.labels import year_range
from citeharbor.operators.views import ARTICLE_TYPES
from citeharbor.schemas import require_columns

KEYS = ["journal", "year", "icpsr_work_category", "has_icpsr", "has_dataset_link"]
RANGE = "study_range"


def rollup(articles: DataFrame) -> DataFrame:
    """The table of prepared articles; ``year`` must be a number."""
    rows = require_columns(articles, [*KEYS, "study_norm"])
    place = F.bitmap_bit_position("study_norm")
    return rows.groupBy(*KEYS, F.bitmap_bucket_number("study_norm").alias(RANGE)).agg(
        F.count(F.lit(1)).alias("n"),
        F.bitmap_construct_agg(F.coalesce(place, F.lit(0))).alias("datasets")).withColumn(
        "datasets", F.when(F.col(RANGE).isNotNull(), F.col("datasets")))


def merged(table: DataFrame, more: DataFrame) -> DataFrame:
    """The table of both batches of works."""
    return table.unionByName(more).groupBy(*KEYS, RANGE).agg(
        F.sum("n").alias("n"), F.bitmap_or_agg("datasets").alias("datasets")).withColumn(
        "datasets", F.when(F.col(RANGE).isNotNull(), F.col("datasets")))


def distinct_datasets(rows: DataFrame, *by: str) -> DataFrame:
    """``n_datasets`` by the given columns: bitmaps are united range by range, then counted."""
    ranges = rows.filter(F.col(RANGE).isNotNull()).groupBy(*by, RANGE).agg(
        F.bitmap_count(F.bitmap_or_agg("datasets")).alias("n"))
    return ranges.groupBy(*by).agg(F.sum("n").alias("n_datasets"))


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def _linked_research(table: DataFrame) -> DataFrame:
    return table.filter(F.col("has_dataset_link") & (F.col("icpsr_work_category") == RESEARCH))


def _whole(value: Column) -> Column:
    return value.try_cast("int")


def overview(table: DataFrame) -> DataFrame:
    """The headline numbers of :func:`views.overview`."""
    linked = table.filter("has_dataset_link")
    research = F.col("icpsr_work_category") == RESEARCH
    counts = linked.agg(
        _total(F.lit(True)).alias("n_identified"), _total(research).alias("n_research_identified"),
        _total(F.col("icpsr_work_category") == DATA_DOCUMENT).alias("n_docs_identified"),
        _total(research).alias("n_research_linked"),
        F.count_distinct(F.when(research, F.col("journal"))).alias("n_journals_linked"),
        _whole(F.min(F.when(research, F.col("year")))).alias("year_min"),
        _whole(F.max(F.when(research, F.col("year")))).alias("year_max"))
    datasets = distinct_datasets(_linked_research(table)).select(
        F.coalesce("n_datasets", F.lit(0)).alias("n_datasets_linked"))
    both = counts.crossJoin(datasets)  # one row each
    return both.select(
        "n_identified", "n_research_identified", "n_docs_identified", "n_research_linked", "n_journals_linked",
        "n_datasets_linked", "year_min", "year_max", year_range("year_min", "year_max").alias("year_range"))


def filter_counts(table: DataFrame, only_hits: bool = False, only_linked: bool = False, year_min: int | None = None,
                  year_max: int | None = None, article_type: str = "all") -> DataFrame:
    """The counts of :func:`views.filter_counts` for every filter but text search, which needs the texts."""
    chosen = F.lit(True)
    if only_hits:
        chosen = chosen & F.col("has_icpsr")
    if only_linked:
        chosen = chosen & F.col("has_dataset_link")
    if article_type in ARTICLE_TYPES:
        chosen = chosen & (F.col("icpsr_work_category") == ARTICLE_TYPES[article_type])
    if year_min is not None:
        chosen = chosen & (F.col("year") >= year_min)
    if year_max is not None:
        chosen = chosen & (F.col("year") <= year_max)
    category = F.col("icpsr_work_category")
    flags = {"articles": F.lit(True), "hits": F.col("has_icpsr"), "linked": F.col("has_dataset_link"),
             "research": category == RESEARCH, "data_docs": category == DATA_DOCUMENT}
    return table.agg(*[_total(flag).alias(f"total_{name}") for name, flag in flags.items()],
                     *[_total(chosen & flag).alias(f"filtered_{name}") for name, flag in flags.items()])


def journal_ranking(table: DataFrame, top_n: int | None = 20) -> DataFrame:
    """The journals of :func:`views.journal_ranking`."""
    rows = _linked_research(table).filter(F.col("journal").isNotNull())
    counts = rows.groupBy("journal").agg(
        F.sum("n").alias("n_articles"), _whole(F.min("year")).alias("year_min"), _whole(F.max("year")).alias("year_max"))
    ranked = counts.join(distinct_datasets(rows, "journal"), "journal", "left").select(
        "journal", "n_articles", F.coalesce("n_datasets", F.lit(0)).alias("n_datasets"), "year_min", "year_max",
        year_range("year_min", "year_max").alias("year_range"))
    return ranked if top_n is None else ranked.orderBy(F.desc("n_articles"), "journal").limit(top_n)


def journal_profile(table: DataFrame, journal: str | None = None) -> DataFrame:
    """The spans of :func:`views.journal_profile`."""
    rows = _linked_research(table).filter(F.col("journal").isNotNull() & F.col(RANGE).isNotNull())
    if journal is not None:
        rows = rows.filter(F.col("journal") == journal)
    return rows.groupBy("journal").agg(
        F.sum("n").alias("n_articles"), _whole(F.min("year")).alias("year_min"),
        _whole(F.max("year")).alias("year_max")).orderBy("journal")
