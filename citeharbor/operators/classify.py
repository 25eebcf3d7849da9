"""Work categories and the tables split by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.identifiers import work_category


def with_category(articles: DataFrame, strict_prefix: bool = False,
                  docs_first: bool = False) -> DataFrame:
    return articles.withColumn("icpsr_work_category", work_category(
        "has_icpsr", "ref_has_icpsr", "doi", "host_venue", strict_prefix, docs_first))


def detected_subset(articles: DataFrame, include_ref_hits: bool = False) -> DataFrame:
    """Works with a text hit; reference-only hits are left out unless asked for."""
    hit = F.col("has_icpsr")
    return articles.filter(hit | F.col("ref_has_icpsr") if include_ref_hits else hit)


def category_counts(articles: DataFrame) -> DataFrame:
    """Works per category with their text and reference hits."""
    return articles.groupBy("icpsr_work_category").agg(
        F.count("*").alias("n_works"),
        F.count_if("has_icpsr").alias("n_text_hits"),
        F.count_if("ref_has_icpsr").alias("n_reference_hits"))
