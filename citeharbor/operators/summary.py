"""Reuse per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.identifiers import study_key
from citeharbor.schemas import DATASETS, missing_columns

EXAMPLE_COLUMNS = ("title", "doi", "snippet")


def dataset_summary(articles: DataFrame, order: str = "seq", merge_numbers: bool = False,
                    include_ref_hits: bool = False) -> DataFrame:
    """One row per dataset: article count, score statistics, representative article.

    The representative has the highest score, the earliest of those on ties.
    ``merge_numbers`` groups by the numeric value of the dataset number (as a
    re-run from stored tables does); otherwise 08079 and 8079 stay apart. One
    aggregation with partial results, so a dataset with very many articles is
    reduced before the shuffle.
    """
    if missing_columns(articles, ("has_icpsr", "icpsr_study_number")):
        return articles.sparkSession.createDataFrame([], DATASETS)
    hit = F.col("has_icpsr")
    if include_ref_hits and "ref_has_icpsr" in articles.columns:
        hit = hit | F.col("ref_has_icpsr")
    linked = (articles.filter(hit & F.col("icpsr_study_number").isNotNull())
              .withColumn("study_norm", study_key("icpsr_study_number")))
    examples = [c for c in EXAMPLE_COLUMNS if c in articles.columns]
    best = F.min_by(F.struct(*examples), F.struct(-F.col("detection_score"), F.col(order)))
    statistics = [
        F.count("*").alias("n_articles"),
        F.max("detection_score").alias("max_detection_score"),
        F.avg("detection_score").alias("mean_detection_score"),
        *([best.alias("_best")] if examples else []),
    ]
    if merge_numbers:
        grouped = linked.groupBy("study_norm").agg(*statistics).withColumn(
            "icpsr_study_number", F.col("study_norm").cast("string"))
    else:
        grouped = linked.groupBy("icpsr_study_number", "study_norm").agg(*statistics)
    return grouped.select(
        "icpsr_study_number", "study_norm", "n_articles", "max_detection_score",
        "mean_detection_score", *[f"_best.{c}" for c in examples])
