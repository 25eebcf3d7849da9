"""Report views over the stored detection tables.

Each view is a function of its tables and the values a reader would choose.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeharbor.functions.core import unicode_regex
from citeharbor.functions.identifiers import (
    DATA_DOCUMENT, RESEARCH, STUDY_PAGE, doi_link, study_key, study_link, to_number)
from citeharbor.functions.labels import dataset_label, row_label, year_range
from citeharbor.operators.rows import with_row_id
from citeharbor.schemas import DATASETS, VIEW_COLUMNS, pick_columns, with_optional

SEARCH_COLUMNS = ("title", "doi", "authors", "journal")
ARTICLE_TYPES = {"research": RESEARCH, "data_doc": DATA_DOCUMENT}
# Columns of the report tables in display order.
RANKING_COLUMNS = ("icpsr_study_number", "title", "n_articles_using_dataset", "n_articles",
                   "max_detection_score", "mean_detection_score", "icpsr_link")
DATASET_ARTICLE_COLUMNS = ("title", "year", "journal", "doi", "detection_score", "signal_type")


def _whole(value: Column) -> Column:
    return value.try_cast("int")


def _year(articles: DataFrame) -> Column:
    """The year as a number; a numeric column is used as it is, so tests on it push down."""
    numeric = isinstance(articles.schema["year"].dataType, T.NumericType)
    return F.col("year") if numeric else to_number("year")


# --- preparation ----------------------------------------------------------------

def prepare_articles(articles: DataFrame) -> DataFrame:
    """Add ``year``, ``journal``, ``has_dataset_link`` and the numeric dataset key."""
    added = {}
    for source, target in (("publication_year", "year"), ("host_venue", "journal")):
        if source in articles.columns and target not in articles.columns:
            added[target] = F.col(source)
    linked = "icpsr_study_number" in articles.columns
    added["has_dataset_link"] = (
        F.col("icpsr_study_number").isNotNull() if linked else F.lit(False))
    if linked:
        added["study_norm"] = study_key("icpsr_study_number")
    return articles.withColumns(added)


def prepare_datasets(datasets: DataFrame) -> DataFrame:
    """Add the numeric dataset key and the landing-page link."""
    return datasets.withColumns({
        "study_norm": study_key("icpsr_study_number"),
        "icpsr_link": study_link("icpsr_study_number")})


def research_articles(articles: DataFrame) -> DataFrame:
    """Research works; every work when the table carries no category."""
    if "icpsr_work_category" not in articles.columns:
        return articles
    return articles.filter(F.col("icpsr_work_category") == RESEARCH)


def data_documents(articles: DataFrame) -> DataFrame:
    if "icpsr_work_category" not in articles.columns:
        return articles.filter(F.lit(False))
    return articles.filter(F.col("icpsr_work_category") == DATA_DOCUMENT)


def linked_research(articles: DataFrame) -> DataFrame:
    """Research works with an identified dataset."""
    return research_articles(articles).filter("has_dataset_link")


# --- overview -------------------------------------------------------------------

def overview(articles: DataFrame) -> DataFrame:
    """One row of headline numbers over works with an identified dataset.

    Rows are first reduced to (journal, dataset, category) groups, on which the
    two distinct counts are cheap. A table without categories counts every work
    as research in the second part and none in the first.
    """
    known = "icpsr_work_category" in articles.columns
    linked = with_optional(articles.filter("has_dataset_link"), VIEW_COLUMNS)
    groups = linked.groupBy("journal", "study_norm", "icpsr_work_category").agg(
        F.count("*").alias("n"),
        F.min(_year(linked)).alias("first"), F.max(_year(linked)).alias("last"))
    category = F.col("icpsr_work_category")
    labelled = category == RESEARCH
    research = labelled if known else F.lit(True)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    return groups.agg(
        total(F.lit(True)).alias("n_identified"),
        total(labelled).alias("n_research_identified"),
        total(category == DATA_DOCUMENT).alias("n_docs_identified"),
        total(research).alias("n_research_linked"),
        F.count_distinct(F.when(research, F.col("journal"))).alias("n_journals_linked"),
        F.count_distinct(F.when(research, F.col("study_norm"))).alias("n_datasets_linked"),
        _whole(F.min(F.when(research, F.col("first")))).alias("year_min"),
        _whole(F.max(F.when(research, F.col("last")))).alias("year_max"),
    ).withColumn("year_range", year_range("year_min", "year_max"))


# --- article search -------------------------------------------------------------

def text_condition(query: str, available: Sequence[str], columns: Sequence[str] = SEARCH_COLUMNS,
                   mode: str = "regex") -> Column | None:
    """Case-blind search over the columns that exist; None when there is nothing to test."""
    if mode not in ("regex", "literal"):
        raise ValueError("mode must be 'regex' or 'literal'")
    names = [c for c in columns if c in available]
    if not query or not names:
        return None
    query = query.lower()
    tests = []
    for name in names:
        text = F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
        tests.append(text.rlike(unicode_regex(query, ignore_case=False))
                     if mode == "regex" else text.contains(query))
    return reduce(lambda a, b: a | b, tests)


def article_condition(articles: DataFrame, query: str = "", only_hits: bool = False,
                      only_linked: bool = False, year_min: int | None = None,
                      year_max: int | None = None, article_type: str = "all",
                      mode: str = "regex",
                      columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    """All chosen filters as one predicate; a filter whose column is absent is off.

    Any year bound drops works without a usable year.
    """
    available = articles.columns
    tests: list[Column] = []
    if only_hits and "has_icpsr" in available:
        tests.append(F.col("has_icpsr"))
    if only_linked and "has_dataset_link" in available:
        tests.append(F.col("has_dataset_link"))
    if article_type in ARTICLE_TYPES and "icpsr_work_category" in available:
        tests.append(F.col("icpsr_work_category") == ARTICLE_TYPES[article_type])
    if "year" in available:
        year = _year(articles)
        tests += [] if year_min is None else [year >= year_min]
        tests += [] if year_max is None else [year <= year_max]
    search = text_condition(query, available, columns, mode)
    if search is not None:
        tests.append(search)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_articles(articles: DataFrame, **filters) -> DataFrame:
    return articles.filter(article_condition(articles, **filters))


def article_table(articles: DataFrame, order: str = "seq", **filters) -> DataFrame:
    """Filtered works numbered from 0 in arrival order."""
    return with_row_id(filter_articles(articles, **filters), order)


def filter_counts(articles: DataFrame, **filters) -> DataFrame:
    """The same counts for all works and for the filtered ones, in one scan.

    A count whose column is absent is left out.
    """
    chosen = article_condition(articles, **filters)
    category = F.col("icpsr_work_category")
    flags = {
        "articles": (None, F.lit(True)),
        "hits": ("has_icpsr", F.col("has_icpsr")),
        "linked": ("has_dataset_link", F.col("has_dataset_link")),
        "research": ("icpsr_work_category", category == RESEARCH),
        "data_docs": ("icpsr_work_category", category == DATA_DOCUMENT),
    }
    flags = {name: flag for name, (column, flag) in flags.items()
             if column is None or column in articles.columns}
    return articles.withColumn("_chosen", chosen).agg(
        *[F.count_if(flag).alias(f"total_{name}") for name, flag in flags.items()],
        *[F.count_if(F.col("_chosen") & flag).alias(f"filtered_{name}")
          for name, flag in flags.items()])


def article_detail(table: DataFrame, row_id: int | None = None) -> DataFrame:
    """Detail card of one numbered work, or of every work."""
    rows = table if row_id is None else table.filter(F.col("row_id") == row_id).limit(1)
    return with_optional(rows, VIEW_COLUMNS).select(
        "row_id", row_label("row_id", "title").alias("label"),
        F.coalesce("title", F.lit("")).alias("title"),
        doi_link("doi").alias("doi_url"), "journal", "icpsr_study_number",
        "detection_score", "signal_type", "snippet")


# --- datasets -------------------------------------------------------------------

def dataset_usage(articles: DataFrame) -> DataFrame:
    """Number of linked research works per dataset."""
    return (linked_research(articles).filter(F.col("study_norm").isNotNull())
            .groupBy("study_norm").agg(F.count("*").alias("n_articles_using_dataset")))


def used_datasets(datasets: DataFrame, articles: DataFrame) -> DataFrame:
    """Datasets used by at least one linked research work, with that count; one row each."""
    return merged_datasets(datasets).join(dataset_usage(articles), "study_norm")


def merged_datasets(datasets: DataFrame) -> DataFrame:
    """One row per dataset, whatever spellings of its number the summary has.

    Works add up; number, title and link are those of the smallest spelling.
    """
    rows = with_optional(prepare_datasets(datasets), DATASETS).filter(F.col("study_norm").isNotNull())
    return rows.groupBy("study_norm").agg(
        F.min_by(F.struct("icpsr_study_number", "title", "doi", "snippet", "icpsr_link"),
                 "icpsr_study_number").alias("m"),
        F.sum("n_articles").alias("n_articles"), F.max("max_detection_score").alias("max_detection_score"),
        (F.sum(F.col("mean_detection_score") * F.col("n_articles")) / F.sum(F.when(
            F.col("mean_detection_score").isNotNull(), F.col("n_articles")))).alias("mean_detection_score"),
    ).select("m.*", "study_norm", "n_articles", "max_detection_score", "mean_detection_score")


def dataset_totals(datasets: DataFrame, articles: DataFrame) -> DataFrame:
    """Datasets of the usage table, and those among them that some work uses.

    The table holds used datasets only, one row each, so both numbers are equal.
    """
    return used_datasets(datasets, articles).agg(
        F.count("*").alias("n_distinct_datasets"),
        F.count_if(F.col("n_articles_using_dataset") > 0).alias("n_reused_datasets"))


def dataset_ranking(datasets: DataFrame, articles: DataFrame, top_n: int = 20) -> DataFrame:
    """The ``top_n`` most used datasets with their option label."""
    top = (used_datasets(datasets, articles)
           .orderBy(F.desc("n_articles_using_dataset"), "study_norm", "icpsr_study_number")
           .limit(top_n))
    return pick_columns(top, RANKING_COLUMNS).withColumn(
        "label", dataset_label("icpsr_study_number", "title", "n_articles_using_dataset"))


def dataset_detail(datasets: DataFrame, dataset: int) -> DataFrame:
    """The summary row of one dataset, by number."""
    return (prepare_datasets(datasets).filter(F.col("study_norm") == dataset)
            .orderBy("icpsr_study_number").limit(1))


def dataset_articles(articles: DataFrame, dataset: int | None = None,
                     keep: Sequence[str] = ("study_norm", "seq")) -> DataFrame:
    """Linked research works of one dataset, or of each dataset."""
    works = linked_research(articles).filter(F.col("study_norm").isNotNull())
    if dataset is not None:
        works = works.filter(F.col("study_norm") == dataset)
    return pick_columns(works, (*keep, *DATASET_ARTICLE_COLUMNS))


# --- journals -------------------------------------------------------------------

def journal_ranking(articles: DataFrame, top_n: int | None = 20) -> DataFrame:
    """Journals by linked research works; ``top_n=None`` keeps all of them.

    Counted per (journal, dataset) first, so the distinct count of datasets is a
    count of groups and a dominant journal is spread over its datasets.
    """
    works = with_optional(linked_research(articles), VIEW_COLUMNS).filter(
        F.col("journal").isNotNull())
    per_dataset = works.groupBy("journal", "study_norm").agg(
        F.count("*").alias("n"),
        F.min(_year(works)).alias("first"), F.max(_year(works)).alias("last"))
    ranked = per_dataset.groupBy("journal").agg(
        F.sum("n").alias("n_articles"),
        F.count("study_norm").alias("n_datasets"),
        _whole(F.min("first")).alias("year_min"), _whole(F.max("last")).alias("year_max"),
    ).withColumn("year_range", year_range("year_min", "year_max"))
    if top_n is None:
        return ranked
    return ranked.orderBy(F.desc("n_articles"), "journal").limit(top_n)


def _placed_usage(articles: DataFrame) -> DataFrame:
    return with_optional(linked_research(articles), VIEW_COLUMNS).filter(
        F.col("study_norm").isNotNull() & F.col("journal").isNotNull())


def journal_datasets(articles: DataFrame, datasets: DataFrame, journal: str | None = None,
                     top_n: int = 15) -> DataFrame:
    """Most used datasets of one journal, or of every journal, with their metadata.

    Datasets absent from the summary keep their number and get a built link.
    """
    usage = _placed_usage(articles)
    if journal is not None:
        usage = usage.filter(F.col("journal") == journal)
    counts = usage.groupBy("journal", "study_norm").agg(F.count("*").alias("n_articles"))
    rank = F.row_number().over(
        Window.partitionBy("journal").orderBy(F.desc("n_articles"), "study_norm"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= top_n)
    metadata = (
        prepare_datasets(datasets).filter(F.col("study_norm").isNotNull())
        .groupBy("study_norm").agg(F.min_by(
            F.struct("icpsr_study_number", "title", "icpsr_link"), "icpsr_study_number"
        ).alias("m")).select("study_norm", "m.*"))
    number = F.col("study_norm").cast("string")
    joined = top.join(metadata, "study_norm", "left").withColumns({
        "icpsr_study_number": F.coalesce("icpsr_study_number", number),
        "icpsr_link": F.when(F.coalesce("icpsr_link", F.lit("")) != "", F.col("icpsr_link"))
                       .otherwise(F.concat(F.lit(STUDY_PAGE), number))})
    return joined.select(
        "journal", "rank", "icpsr_study_number", "title", "n_articles", "icpsr_link",
        dataset_label("icpsr_study_number", "title", "n_articles").alias("label"))


def journal_profile(articles: DataFrame, journal: str | None = None) -> DataFrame:
    """Linked works and year span of one journal, or of each, sorted by name."""
    usage = _placed_usage(articles)
    if journal is not None:
        usage = usage.filter(F.col("journal") == journal)
    return usage.groupBy("journal").agg(
        F.count("*").alias("n_articles"),
        _whole(F.min(_year(usage))).alias("year_min"),
        _whole(F.max(_year(usage))).alias("year_max")).orderBy("journal")


def journal_rows(articles: DataFrame, journal: str) -> DataFrame:
    return _placed_usage(articles).filter(F.col("journal") == journal)


def journals(articles: DataFrame) -> DataFrame:
    """Sorted distinct journal names with linked research works."""
    return _placed_usage(articles).select("journal").distinct().orderBy("journal")


