"""Explicit schemas of the stored tables and helpers for optional columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
BOOLEAN, DOUBLE = T.BooleanType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


WORKS = _schema(
    id=STRING, title=STRING, doi=STRING, publication_year=INT,
    referenced_works=T.ArrayType(STRING),
    abstract_inverted_index=T.MapType(STRING, T.ArrayType(INT)),
    open_access=_schema(is_oa=BOOLEAN, oa_status=STRING, oa_url=STRING),
    ids=_schema(doi=STRING, openalex=STRING),
    primary_location=_schema(
        landing_page_url=STRING, pdf_url=STRING, source=_schema(display_name=STRING)))

ARTICLES = _schema(
    seq=LONG, id=STRING, title=STRING, doi=STRING, publication_year=INT, is_oa=BOOLEAN,
    host_venue=STRING, abstract_text=STRING, fulltext_url=STRING, record_url=STRING,
    referenced_works=STRING)

TEXT_RESULT = _schema(
    has_icpsr=BOOLEAN, icpsr_doi=STRING, icpsr_study_number=STRING, detection_score=INT,
    max_signal_score=INT, signal_type=STRING, snippet=STRING)

REFERENCE_RESULT = _schema(
    ref_has_icpsr=BOOLEAN, ref_icpsr_work_ids=STRING, ref_icpsr_dois=STRING,
    ref_icpsr_study_numbers=STRING)

DETECTION = T.StructType(
    ARTICLES.fields + _schema(fulltext=STRING).fields + TEXT_RESULT.fields
    + REFERENCE_RESULT.fields + _schema(icpsr_work_category=STRING).fields)

DATASETS = _schema(
    icpsr_study_number=STRING, study_norm=LONG, n_articles=LONG, max_detection_score=INT,
    mean_detection_score=DOUBLE, title=STRING, doi=STRING, snippet=STRING)

WORK_MAP = _schema(
    seq=LONG, icpsr_study_number=STRING, icpsr_doi=STRING, title=STRING,
    openalex_work_id=STRING)

STUDY_METADATA = _schema(
    icpsr_id=STRING, icpsr_url=STRING, title=STRING, creators=STRING, subjects=STRING,
    description=STRING, doi=STRING)

SIGNALS = _schema(
    seq=LONG, sentence_no=INT, signal_no=INT, signal_type=STRING, doi=STRING,
    study_number=STRING, score=INT, snippet=STRING)

# What the report views read; absent columns count as NULL there.
VIEW_COLUMNS = _schema(
    title=STRING, doi=STRING, year=INT, journal=STRING, icpsr_study_number=STRING,
    study_norm=LONG, detection_score=INT, signal_type=STRING, snippet=STRING,
    icpsr_work_category=STRING)

NESTED_PAGE_FIELDS = _schema(
    subjects=T.ArrayType(STRING), description=STRING, creators=T.ArrayType(STRING))


def missing_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame itself; raises when a needed column is absent."""
    missing = missing_columns(df, names)
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the absent columns of ``schema`` as typed NULLs."""
    return df.withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def pick_columns(df: DataFrame, preferred: Iterable[str]) -> DataFrame:
    """The preferred columns that exist, in that order; all columns when none does."""
    return df.select(*([c for c in preferred if c in df.columns] or df.columns))
