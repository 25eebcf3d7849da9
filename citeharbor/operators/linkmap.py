"""Dataset-to-work map: which catalogued work stands for which dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.core import non_empty, strip
from citeharbor.functions.identifiers import clean_doi
from citeharbor.schemas import require_columns


def build_work_map(datasets: DataFrame, works: DataFrame, doi: str = "doi",
                   order: str = "seq") -> DataFrame:
    """Resolve each dataset's DOI to the first work that carries it.

    Datasets without a DOI are left out; those without a matching work keep a
    NULL work id. Works are narrowed to the wanted DOIs and reduced to one per
    DOI before the final join.
    """
    require_columns(datasets, ("icpsr_study_number", doi))
    wanted = datasets.select(
        strip(F.col("icpsr_study_number").cast("string")).alias("icpsr_study_number"),
        non_empty(clean_doi(doi)).alias("icpsr_doi"),
        F.col("title") if "title" in datasets.columns else F.lit(None).cast("string").alias("title"),
    ).filter(F.col("icpsr_doi").isNotNull()).withColumn("_key", F.lower("icpsr_doi"))
    catalogue = works.select(F.lower(clean_doi("doi")).alias("_key"), "id", order)
    resolved = (catalogue.join(wanted.select("_key").distinct(), "_key", "left_semi")
                .groupBy("_key").agg(F.min_by("id", order).alias("openalex_work_id")))
    return wanted.join(resolved, "_key", "left").select(
        "icpsr_study_number", "icpsr_doi", "title", "openalex_work_id")
