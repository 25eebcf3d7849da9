"""Counts along the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.identifiers import DATA_DOCUMENT, RESEARCH

LABEL_COLUMNS = ("icpsr_work_category", "work_type")


def label_column(df: DataFrame) -> str | None:
    """Category column of a table; the later name wins when both exist."""
    present = [c for c in LABEL_COLUMNS if c in df.columns]
    return present[-1] if present else None


def funnel_stats(articles: DataFrame, collected: DataFrame | None = None,
                 rejected: DataFrame | None = None) -> DataFrame:
    """``stage, metric, value`` rows from one aggregation over the detection table.

    ``collected`` is the table before detection; without it the detection table
    stands for it. ``rejected`` holds the records that could not be read. Metrics whose columns or
    tables are absent are left out.
    """
    label = label_column(articles)
    hit = F.col("has_icpsr")
    studied = "icpsr_study_number" in articles.columns
    study = F.col("icpsr_study_number") if studied else None

    metrics = [
        ("collected", "total_articles", F.count("*")),
        ("detection", "rows", F.count("*")),
        ("detection", "with_signal", F.count_if(hit)),
        ("related", "total", F.count_if(hit)),
    ]
    if label is not None:
        research = F.coalesce(F.col(label) == RESEARCH, F.lit(False))
        document = F.coalesce(F.col(label) == DATA_DOCUMENT, F.lit(False))
        metrics += [
            ("related", "research", F.count_if(hit & research)),
            ("related", "data_docs", F.count_if(hit & document)),
            ("related", "other", F.count_if(hit & ~research & ~document)),
        ]
    if studied:
        metrics.append(("related", "with_study_number", F.count(study)))
        if label is not None:
            metrics.append(("related", "research_linked",
                            F.count_if(hit & research & study.isNotNull())))
        metrics.append(("datasets", "distinct", F.count_distinct(F.when(hit, study))))

    def rows(frame: DataFrame, chosen) -> DataFrame:
        counted = frame.agg(*[m.alias(f"m{i}") for i, (_, _, m) in enumerate(chosen)])
        return counted.select(F.inline(F.array(*[
            F.struct(F.lit(stage).alias("stage"), F.lit(metric).alias("metric"),
                     F.col(f"m{i}").cast("bigint").alias("value"))
            for i, (stage, metric, _) in enumerate(chosen)])))

    if collected is None:
        counts = rows(articles, metrics)
    else:
        counts = rows(collected, metrics[:1]).unionByName(rows(articles, metrics[1:]))
    if rejected is not None:
        counts = counts.unionByName(rows(rejected, [("collected", "rejected_records", F.count("*"))]))
    return counts


def run_summary(articles: DataFrame) -> DataFrame:
    """Number of text and reference hits of a run."""
    return articles.agg(F.count_if("has_icpsr").alias("n_text_hits"),
                        F.count_if("ref_has_icpsr").alias("n_reference_hits"))
