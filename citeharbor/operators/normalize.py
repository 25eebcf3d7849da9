"""Raw nested works to one flat, deduplicated article table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeharbor.functions.core import first_non_empty
from citeharbor.functions.text import decode_inverted_index

# The terms and the publication years of a source request.
SEARCH_TERMS = ("ICPSR", "Inter-university Consortium for Political and Social Research")
FIRST_YEAR, LAST_YEAR = 2000, 2024


def source_filter(works: DataFrame, terms: Sequence[str] = SEARCH_TERMS,
                  first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR,
                  text_columns: Sequence[str] = ("title", "abstract_text")) -> DataFrame:
    """Open-access works of the given years that mention one of the terms.

    Every predicate is a plain column test, so the flag and year tests reach
    the Parquet reader. All such works are kept.
    """
    kept = works.filter(
        F.col("is_oa") & F.col("publication_year").between(first_year, last_year))
    if terms:
        hit = F.lit(False)
        for name in text_columns:
            text = F.lower(F.coalesce(F.col(name), F.lit("")))
            for term in terms:
                hit = hit | text.contains(term.lower())
        kept = kept.filter(hit)
    return kept


def fulltext_url(pdf: Column, landing: Column, oa_status: Column, oa_url: Column) -> Column:
    """PDF, then landing page, then the open-access URL if a status is known."""
    return first_non_empty(pdf, landing, F.when(oa_status != "", oa_url))


def record_url(doi_url: Column, landing: Column, openalex: Column, work_id: Column) -> Column:
    return first_non_empty(doi_url, landing, openalex, work_id)


def flatten_works(works: DataFrame, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Nested works to the ten article columns, plus the ``keep`` columns that exist."""
    place = "primary_location"
    return works.select(
        *[c for c in keep if c in works.columns],
        "id", "title", "doi", "publication_year",
        F.col("open_access.is_oa").alias("is_oa"),
        F.col(f"{place}.source.display_name").alias("host_venue"),
        decode_inverted_index("abstract_inverted_index").alias("abstract_text"),
        fulltext_url(F.col(f"{place}.pdf_url"), F.col(f"{place}.landing_page_url"),
                     F.col("open_access.oa_status"), F.col("open_access.oa_url"),
                     ).alias("fulltext_url"),
        record_url(F.col("ids.doi"), F.col(f"{place}.landing_page_url"),
                   F.col("ids.openalex"), F.col("id")).alias("record_url"),
        F.to_json(F.coalesce(F.col("referenced_works"), F.array().cast("array<string>")),
                  {"ignoreNullFields": "false"}).alias("referenced_works"))


def union_results(results: Sequence[DataFrame], tag: str = "query_ord",
                  key: str = "seq") -> DataFrame:
    """Bag union of the results of several requests; ``tag`` keeps the request order.

    ``key`` is numbered anew so that it stays unique: each request follows on the largest number of
    the one before, which keeps the order by request and arrival. ``source_<key>`` has the old
    number. One pass over that column finds the bounds.
    """
    tagged, begin = [], None
    for i, df in enumerate(results):
        df = df.withColumn(tag, F.lit(i))
        if key in df.columns:
            low, high = df.agg(F.min(key), F.max(key)).first()
            begin = (low or 0) if begin is None else begin
            shift = begin - (low or 0)
            df = df.withColumn(f"source_{key}", F.col(key)).withColumn(key, F.col(key) + F.lit(shift))
            begin += 0 if high is None else high - low + 1
        tagged.append(df)
    return reduce(lambda a, b: a.unionByName(b), tagged)


def dedupe_by_doi(works: DataFrame, order: Sequence[str] = ("seq",),
                  null_key: str = "keep") -> DataFrame:
    """First work per DOI in arrival order.

    ``null_key="keep"`` leaves works without a DOI alone; ``"collapse"`` treats
    the missing DOI as one key. The rank limit is applied before the shuffle, so
    a DOI shared by very many rows sends one row per task. Works without a DOI
    are spread by their arrival order, never gathered under one key.
    """
    if null_key not in ("keep", "collapse"):
        raise ValueError("null_key must be 'keep' or 'collapse'")
    key: list[Column] = [F.col("doi")]
    if null_key == "keep":
        key.append(F.when(F.col("doi").isNull(), F.struct(*order)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return works.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
