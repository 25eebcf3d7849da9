"""Whole runs from stored tables to stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeharbor import schemas
from citeharbor.functions.patterns import ARCHIVE, PatternSet
from citeharbor.operators.classify import detected_subset
from citeharbor.operators.fulltext import attach_fulltext
from citeharbor.operators.linkmap import build_work_map
from citeharbor.operators.normalize import dedupe_by_doi, flatten_works
from citeharbor.operators.references import with_evidence
from citeharbor.operators.rollup import rollup
from citeharbor.operators.similarity import clusters_and_matrix
from citeharbor.operators.stats import funnel_stats
from citeharbor.operators.summary import dataset_summary
from citeharbor.operators.views import prepare_articles, prepare_datasets
from citeharbor.sources import readers, writers
from citeharbor.sources.stages import (
    committed, forget, load_or_build, manifest, reads_from, remember, unchanged, usable_stage)


@dataclass(frozen=True)
class Layout:
    """Where a run keeps its tables, under one folder of shared storage."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def works(self) -> str:
        return self.path("raw_works")

    @property
    def rejected(self) -> str:
        return self.path("rejected_works")

    @property
    def articles(self) -> str:
        return self.path("articles")

    @property
    def texts(self) -> str:
        return self.path("texts")

    @property
    def detection(self) -> str:
        return self.path("detection")

    @property
    def detected(self) -> str:
        return self.path("detected_articles")

    @property
    def datasets(self) -> str:
        return self.path("detected_datasets")

    @property
    def work_map(self) -> str:
        return self.path("dataset_work_map")

    @property
    def clusters(self) -> str:
        return self.path("clusters")

    @property
    def similarities(self) -> str:
        return self.path("dataset_similarities")

    @property
    def rollup(self) -> str:
        return self.path("view_counts")

    @property
    def stats(self) -> str:
        return self.path("run_counts")


def take_works(spark: SparkSession, layout: Layout, path: str, one_array: bool = False) -> DataFrame:
    """Works from JSON files, in arrival order; records that cannot be read go to a table of their own.

    Both are counted on the way, and a run whose counts do not add up to the records read is an error.
    Files that have not changed since the last run are not read again.
    """
    made_of = manifest(spark, [spark.read.text(path)], f"one_array={one_array}")
    if unchanged(spark, layout.works, made_of) and committed(spark, layout.works):
        return stored_works(spark, layout)
    forget(spark, layout.works)
    seen, kept, out = Observation(), Observation(), Observation()
    records = readers.read_work_records(spark, path, one_array).observe(seen, F.count(F.lit(1)).alias("n"))
    rejected = records.filter("work IS NULL").drop("work").observe(out, F.count(F.lit(1)).alias("n"))
    writers.write_table(rejected, layout.rejected)
    works = readers.read_works(spark, path, one_array).observe(kept, F.count(F.lit(1)).alias("n"))
    writers.write_json(works, layout.works)
    if seen.get["n"] != kept.get["n"] + out.get["n"]:
        raise RuntimeError(f"{seen.get['n']} records gave {kept.get['n']} works and {out.get['n']} rejected ones")
    remember(spark, layout.works, made_of)
    return stored_works(spark, layout)


def stored_works(spark: SparkSession, layout: Layout) -> DataFrame:
    """The raw works of an earlier :func:`take_works`, with their arrival numbers."""
    kind = T.StructType([*schemas.WORKS.fields, T.StructField("seq", schemas.LONG)])
    return spark.read.schema(kind).json(layout.works)


def build_articles(spark: SparkSession, layout: Layout, works: DataFrame | None = None,
                   null_key: str = "keep", with_csv: bool = False,
                   articles: DataFrame | None = None, reuse: bool = False) -> DataFrame:
    """Raw works, or ready-made ``articles``, to the stored article table.

    What is given replaces a stored table, unless it was made of the same files or ``reuse`` asks for
    that one; it is also used when nothing is given.
    """
    given = [df for df in (articles, works) if df is not None and not reuse][:1]

    def build() -> DataFrame:
        if articles is not None:
            return articles
        if not reads_from(works, layout.works):
            forget(spark, layout.works)
            writers.write_json(works, layout.works)
        return dedupe_by_doi(flatten_works(works), null_key=null_key)

    stored = load_or_build(spark, layout.articles, build, required="id", rebuild=bool(given), inputs=given,
                           version=f"null_key={null_key}")
    if with_csv:
        writers.write_csv(stored, f"{layout.articles}_csv")
    return stored


def article_texts(spark: SparkSession, layout: Layout, works: DataFrame | None = None,
                  pages: DataFrame | None = None, with_csv: bool = False,
                  articles: DataFrame | None = None, null_key: str = "keep",
                  reuse: bool = False) -> DataFrame:
    """Articles with their text, as a stored stage.

    Works, articles or pages that are given are processed and replace the stored text, unless that was
    made of the same files or ``reuse`` asks for it. Without any, the stored text is used, or that of a
    stored detection table.
    """
    if not reuse and not (works is None and articles is None and pages is None):
        stored = build_articles(spark, layout, works, null_key, with_csv, articles)
        return load_or_build(spark, layout.texts, lambda: attach_fulltext(stored, pages), required="fulltext",
                             rebuild=True, inputs=[stored] if pages is None else [stored, pages])

    def build() -> DataFrame:
        earlier = usable_stage(spark, layout.detection, "fulltext")
        if earlier is not None:
            return earlier.drop(*schemas.TEXT_RESULT.names, *schemas.REFERENCE_RESULT.names,
                                "icpsr_work_category")
        stored = build_articles(spark, layout, works, null_key, with_csv, articles, reuse)
        return attach_fulltext(stored, pages)

    return load_or_build(spark, layout.texts, build, required="fulltext")


def run_detection(spark: SparkSession, layout: Layout, works: DataFrame | None = None,
                  pages: DataFrame | None = None, patterns: PatternSet = ARCHIVE,
                  with_csv: bool = False, with_text: bool = False,
                  articles: DataFrame | None = None, reuse: bool = False, null_key: str = "keep",
                  include_ref_hits: bool = False, **category_options) -> DataFrame:
    """Works (or ready-made ``articles``) and pages to all stored results; returns the detection table.

    Stored text is used when no input is given, or with ``reuse``; detection itself always runs
    again. The text stays in its own stage and enters no shuffle, unless ``with_text`` asks for it in
    the detection table. Later results are derived from the stored table.
    ``null_key``, ``include_ref_hits``, ``strict_prefix`` and ``docs_first`` decide the open points.
    """
    texts = article_texts(spark, layout, works, pages, with_csv, articles, null_key, reuse)
    work_map = readers.read_work_map(spark, layout.work_map)
    found = with_evidence(texts, work_map, patterns=patterns, keep_text=with_text, **category_options)
    writers.write_table(found, layout.detection, with_csv)
    table = spark.read.parquet(layout.detection)
    writers.write_table(detected_subset(table, include_ref_hits), layout.detected, with_csv)
    write_rollup(spark, layout)
    summarize(spark, layout, with_csv)
    return table


def import_detection(spark: SparkSession, layout: Layout, csv: str) -> DataFrame:
    """Take over a detection table kept as CSV; every other step can follow."""
    writers.write_table(readers.read_detection_csv(spark, csv), layout.detection)
    table = spark.read.parquet(layout.detection)
    writers.write_table(detected_subset(table), layout.detected)
    return table


def summarize(spark: SparkSession, layout: Layout, with_csv: bool = False,
              merge_numbers: bool = False, linkage: str = "single") -> bool:
    """Dataset summary, optional clusters and their similarities from the stored detection table.

    False when no dataset was found; then none is written.
    """
    table = spark.read.parquet(layout.detection)
    summary = dataset_summary(table, merge_numbers=merge_numbers).orderBy("icpsr_study_number")
    if not writers.write_if_any(summary, layout.datasets, with_csv):
        return False
    datasets = readers.read_datasets(spark, layout.datasets)
    similarities = []

    def clusters():
        rows, matrix = clusters_and_matrix(datasets, linkage=linkage)
        similarities.append(matrix)
        return rows

    if writers.write_optional(clusters, layout.clusters):
        writers.write_optional(similarities.pop, layout.similarities)
    return True


def write_rollup(spark: SparkSession, layout: Layout) -> DataFrame:
    """Counts over the detected articles, from which ``operators.rollup`` answers the report views."""
    articles = schemas.with_optional(prepare_articles(spark.read.parquet(layout.detected)), schemas.VIEW_COLUMNS)
    writers.write_table(rollup(articles), layout.rollup)
    return spark.read.parquet(layout.rollup)


def build_map(spark: SparkSession, layout: Layout, doi: str = "doi") -> DataFrame:
    """Dataset-to-work map from the stored summary and articles; the next run uses it."""
    datasets = readers.read_datasets(spark, layout.datasets)
    found = build_work_map(datasets, spark.read.parquet(layout.articles), doi)
    writers.write_table(found, layout.work_map)
    return spark.read.parquet(layout.work_map)


def write_stats(spark: SparkSession, layout: Layout) -> DataFrame:
    """Counts along the run, returned and written as text."""
    rejected = spark.read.parquet(layout.rejected) if committed(spark, layout.rejected) else None
    stats = funnel_stats(spark.read.parquet(layout.detection),
                         spark.read.parquet(layout.articles), rejected)
    return writers.write_report(stats, layout.stats)


def load_views(spark: SparkSession, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """Detected articles and datasets as the report views read them, kept in memory.

    Without a summary the dataset table is empty.
    """
    stored = spark.read.parquet(layout.detected)
    articles = prepare_articles(stored.drop("fulltext", "abstract_text", "referenced_works")).persist()
    datasets = prepare_datasets(schemas.with_optional(
        readers.read_datasets(spark, layout.datasets), schemas.DATASETS)).persist()
    return articles, datasets
