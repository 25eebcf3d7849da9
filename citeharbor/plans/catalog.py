"""Registered queries: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeharbor import schemas
from citeharbor.functions import identifiers, nested, text
from citeharbor.functions.detection import negative_context
from citeharbor.functions.patterns import PatternSet, SignalRule
from citeharbor.operators import (
    classify, detect, fulltext, linkmap, normalize, pages, references, rollup, similarity, stats,
    summary, textindex, views)
from citeharbor.plans import fixtures
from citeharbor.sources.readers import (
    read_articles_csv, read_csv, read_table, read_work_map, read_works, rejected_works, spread)
from citeharbor.sources.refresh import refresh
from citeharbor.sources.stages import cut, remove, shared_folder
from citeharbor.sources.writers import write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SOURCE_TERMS = ("tion", "sch ")
SEARCH_TEXT = "journal of src1[0-4]?$"

# Another use of the detector: licences and contact data instead of dataset names.
LICENCE = r"(?:Released under the|Licensed under the) [A-Z][A-Za-z0-9]+ License"
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}"
PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"
TOKEN = r'token = "([0-9a-f]{40})"'
# Starts only where a run of address characters starts and never re-reads that run.
MAIL = r"(?<![A-Za-z0-9_.])[A-Za-z0-9_.]++@[A-Za-z0-9_.]+\.com"
NATURAL = PatternSet(
    rules=(
        SignalRule("licence", (LICENCE,), 2, every_match=False),
        SignalRule("address", (ADDRESS,), 3, fills="doi"),
        SignalRule("contact", (PHONE, MAIL), 1, fills="doi"),
        SignalRule("token", (TOKEN,), 3, fills="study_number", group=1),
    ),
    threshold=2,
    gate="|".join((LICENCE, ADDRESS, PHONE, TOKEN, MAIL)),
)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- scalar functions and row-local steps -----------------------------------------

@query
def q_source_filter(spark, sf_dir):
    kept = normalize.source_filter(fixtures.articles(spark, sf_dir), SOURCE_TERMS)
    return kept.select("seq", "title", "publication_year")


@query
def q_works_normalize(spark, sf_dir):
    return normalize.flatten_works(fixtures.nested_works(spark, sf_dir))


@query
def q_url_priority(spark, sf_dir):
    flat = normalize.flatten_works(fixtures.nested_works(spark, sf_dir, with_abstract=False))
    return flat.select("seq", "fulltext_url", "record_url")


@query
def q_inverted_index(spark, sf_dir):
    index = fixtures.word_index(fixtures.texts(spark, sf_dir), "doc_id", "text")
    return index.select("doc_id", text.decode_inverted_index("word_index").alias("decoded"))


@query
def q_norm_text(spark, sf_dir):
    documents = fixtures.texts(spark, sf_dir)
    return documents.select("doc_id", text.norm_text("text").alias("normed"))


@query
def q_clean_doi(spark, sf_dir):
    articles = fixtures.articles(spark, sf_dir)
    return articles.select(
        "seq", identifiers.clean_doi("doi").alias("clean_doi"),
        identifiers.clean_doi(F.concat(F.lit("  "), "doi", F.lit(" "))).alias("clean_padded"))


@query
def q_json_path(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return events.select(
        "event_id", nested.json_path("props", "k").try_cast("bigint").alias("k"),
        nested.json_path("props", "k", "deep", default="none").alias("deep"))


@query
def q_study_key(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    n = F.col("o_orderkey").cast("string")
    raw = (F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("0"), n))
           .when(F.col("o_orderkey") % 6 == 1, F.concat(n, F.lit(".0")))
           .when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit(" "), n, F.lit(" ")))
           .when(F.col("o_orderkey") % 6 == 3, F.concat(n, F.lit("x")))
           .when(F.col("o_orderkey") % 6 == 4, F.concat(n, F.lit(".5")))
           .otherwise(n))
    keyed = orders.select("o_orderkey", raw.alias("raw"))
    return keyed.select("o_orderkey", identifiers.study_key("raw").alias("study_norm"),
                        identifiers.study_link("raw").alias("icpsr_link"))


@query
def q_parse_refs(spark, sf_dir):
    parsed = fixtures.reference_cells(spark, sf_dir).select(
        "seq", nested.parse_references("referenced_works").alias("refs"))
    return parsed.select("seq", F.size("refs").cast("bigint").alias("n_refs"),
                         F.array_join("refs", "|").alias("refs"))


@query
def q_sentences(spark, sf_dir):
    documents = fixtures.texts(spark, sf_dir)
    return documents.select(
        "doc_id", F.posexplode(text.sentences("text")).alias("sentence_no", "sentence"))


@query
def q_negative_context(spark, sf_dir):
    split = fixtures.spread_articles(spark, sf_dir).select(
        "seq", F.posexplode(text.sentences("fulltext")).alias("sentence_no", "sentence"))
    return split.filter(negative_context("sentence"))


@query
def q_html_text(spark, sf_dir):
    source = spread(read_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.with_page_text(source, name="page_text")


@query
def q_page_metadata(spark, sf_dir):
    return pages.page_metadata(fixtures.study_pages(spark, sf_dir))


# --- acquisition --------------------------------------------------------------------

def _two_requests(spark, sf_dir):
    articles = fixtures.articles(spark, sf_dir).drop("fulltext")
    return normalize.union_results([articles.filter(~F.col("is_oa")), articles])


@query
def q_dedup_doi(spark, sf_dir):
    kept = normalize.dedupe_by_doi(_two_requests(spark, sf_dir), ("query_ord", "seq"))
    return kept.select("query_ord", F.col("source_seq").alias("seq"), "id", "doi")


@query
def q_dedup_doi_collapse(spark, sf_dir):
    kept = normalize.dedupe_by_doi(
        _two_requests(spark, sf_dir), ("query_ord", "seq"), null_key="collapse")
    return kept.select("query_ord", F.col("source_seq").alias("seq"), "id", "doi")


@query
def q_fulltext_fallback(spark, sf_dir):
    attached = fulltext.attach_fulltext(
        fixtures.articles_with_urls(spark, sf_dir).select(
            "seq", "abstract_text", "fulltext_url", "record_url"),
        read_table(spark, sf_dir, "pages"))
    return attached.select("seq", "fulltext")


@query
def q_csv_roundtrip(spark, sf_dir):
    table = fixtures.articles(spark, sf_dir)
    path = f"{shared_folder(spark)}/citeharbor/csv-{uuid.uuid4().hex}"
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


def _file_folder(spark):
    return f"{shared_folder(spark)}/citeharbor/files-{uuid.uuid4().hex}"


def _works_file(spark, sf_dir):
    """Works as JSON Lines in files of unequal size, in the order of ``seq``; some lines are broken."""
    line = F.to_json(F.struct("*"))
    works = fixtures.nested_works(spark, sf_dir, with_abstract=False)
    lines = works.select("seq", F.when(F.col("seq") % 10 == 3, line.substr(F.lit(1), F.length(line) - 1)).when(
        F.col("seq") % 50 == 7, "null").otherwise(line).alias("value"))
    path = _file_folder(spark)
    for name, part, files in (("a", "seq < 50", 1), ("b", "seq >= 50", 4)):
        ordered = lines.filter(part).repartitionByRange(files, "seq").sortWithinPartitions("seq")
        ordered.select("value").write.text(f"{path}/{name}")
    return f"{path}/*"


@query
def q_works_json(spark, sf_dir):
    """Works read from files: numbered as they stand there, without the broken records."""
    flat = normalize.flatten_works(read_works(spark, _works_file(spark, sf_dir)))
    return flat.select("seq", "id", "doi", "publication_year", "is_oa", "host_venue")


@query
def q_works_rejected(spark, sf_dir):
    rejected = rejected_works(spark, _works_file(spark, sf_dir))
    return rejected.select("seq", (F.col("record") == "null").alias("is_null"))


@query
def q_works_first(spark, sf_dir):
    """The first work of each DOI in the order of the files."""
    flat = normalize.flatten_works(read_works(spark, _works_file(spark, sf_dir)))
    return normalize.dedupe_by_doi(flat).select("seq", "id", "doi")


@query
def q_csv_arrival(spark, sf_dir):
    """Articles without numbers of their own, in several CSV files with line breaks in fields."""
    table = fixtures.articles(spark, sf_dir).select("seq", "id", "title", "publication_year")
    path = _file_folder(spark)
    for name, part, files in (("a", "seq < 50", 1), ("b", "seq >= 50", 3)):
        ordered = table.filter(part).repartitionByRange(files, "seq").sortWithinPartitions("seq")
        write_csv(ordered.drop("seq"), f"{path}/{name}")
    back = read_articles_csv(spark, f"{path}/*")
    return back.select("seq", "id", "title", "publication_year")


@query
def q_map_file(spark, sf_dir):
    """References against a map kept as CSV, in whose order the last row of a work counts."""
    path = _file_folder(spark)
    table = fixtures.work_map(spark, sf_dir).repartitionByRange(4, "seq").sortWithinPartitions("seq")
    write_csv(table.drop("seq"), path)
    found = references.with_references(fixtures.articles(spark, sf_dir), read_work_map(spark, path, "csv"))
    return found.select("seq", "ref_has_icpsr", "ref_icpsr_work_ids", "ref_icpsr_dois", "ref_icpsr_study_numbers")


@query
def q_detection_csv(spark, sf_dir):
    """A detection table kept as CSV files with two column orders, one with a column more."""
    table = fixtures.detected(spark, sf_dir).select(
        "seq", "id", "title", "doi", "publication_year", "has_icpsr", "icpsr_study_number", "detection_score")
    path = f"{shared_folder(spark)}/citeharbor/csv-{uuid.uuid4().hex}"
    write_csv(table.filter("seq % 2 = 0").withColumn("work_type", F.concat(F.lit("type "), F.col("seq") % 5)),
              f"{path}/part=0")
    write_csv(table.filter("seq % 2 = 1").select(*reversed(table.columns)), f"{path}/part=1")
    back = read_csv(spark, f"{path}/part=*", schemas.DETECTION, keep_extra=True)
    return back.select(*table.columns, "work_type")


@query
def q_union_references(spark, sf_dir):
    """Two requests with the same arrival numbers, united, then matched with the map."""
    union = _two_requests(spark, sf_dir).select("query_ord", "source_seq", "seq", "referenced_works")
    found = references.with_references(union, fixtures.work_map(spark, sf_dir))
    return found.select("query_ord", "source_seq", "ref_has_icpsr", "ref_icpsr_work_ids")


# --- detection ------------------------------------------------------------------------

@query
def q_signals(spark, sf_dir):
    return detect.signal_table(fixtures.spread_articles(spark, sf_dir))


@query
def q_detect_documents(spark, sf_dir):
    articles = fixtures.spread_articles(spark, sf_dir).select("seq", "fulltext")
    return detect.with_detection(articles).drop("fulltext")


@query
def q_detect_natural(spark, sf_dir):
    documents = fixtures.texts(spark, sf_dir).select("doc_id", "text")
    return detect.with_detection(documents, "text", NATURAL).drop("text")


@query
def q_ref_detect(spark, sf_dir):
    articles = fixtures.articles(spark, sf_dir).select("seq", "referenced_works")
    return references.with_references(articles, fixtures.work_map(spark, sf_dir)).drop(
        "referenced_works")


@query
def q_ref_detect_prefiltered(spark, sf_dir):
    articles = fixtures.articles(spark, sf_dir).select("seq", "referenced_works")
    return references.with_references(articles, fixtures.work_map(spark, sf_dir), prefilter=True).drop(
        "referenced_works")


@query
def q_ref_detect_graph(spark, sf_dir):
    edges = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("work_id"))
    works = read_table(spark, sf_dir, "part").filter(F.col("p_size") <= 10).select(
        F.col("p_partkey").alias("work_id"),
        F.concat(F.lit("10.5555/"), "p_brand").alias("doi"),
        F.col("p_partkey").cast("string").alias("study"))
    citing = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work"))
    pairs = references.matched_pairs(edges, works, "work")
    return pairs.join(citing, "work", "left_semi")


@query
def q_detection_table(spark, sf_dir):
    return fixtures.detected(spark, sf_dir).select(
        "seq", *schemas.TEXT_RESULT.names, *schemas.REFERENCE_RESULT.names,
        "icpsr_work_category")


@query
def q_detection_refresh(spark, sf_dir):
    """Detection over a folder of files that change: some replaced, one removed, one added, the rest kept."""
    folder, stage = _file_folder(spark), _file_folder(spark)
    documents = read_table(spark, sf_dir, "documents")

    def write(name, rows):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")

    def build(rows):
        found = detect.with_detection(fixtures.articles_of(rows))
        return found.select("_source", "seq", "has_icpsr", "icpsr_study_number", "detection_score")

    for part in range(4):
        old = documents.filter(F.col("doc_id") % 5 == part)
        write(f"part{part}", old.withColumn("text", F.lit("We used ICPSR 1.")) if part == 1 else old)
    refresh(spark, stage, folder, build).count()
    write("part1", documents.filter("doc_id % 5 = 1"))
    remove(spark, f"{folder}/part2")
    write("part4", documents.filter("doc_id % 5 = 4"))
    return refresh(spark, stage, folder, build)


@query
def q_classify(spark, sf_dir):
    return fixtures.detected_stage(spark, sf_dir).select(
        "seq", "has_icpsr", "ref_has_icpsr", "icpsr_work_category")


@query
def q_detected_subset(spark, sf_dir):
    return classify.detected_subset(fixtures.detected_stage(spark, sf_dir)).select(
        "seq", "id", "title", "icpsr_study_number", "detection_score", "icpsr_work_category")


@query
def q_category_counts(spark, sf_dir):
    return classify.category_counts(fixtures.detected_stage(spark, sf_dir))


@query
def q_run_summary(spark, sf_dir):
    return stats.run_summary(fixtures.detected_stage(spark, sf_dir))


@query
def q_funnel_stats(spark, sf_dir):
    return stats.funnel_stats(
        fixtures.detected_stage(spark, sf_dir), collected=read_table(spark, sf_dir, "documents"))


# --- datasets ---------------------------------------------------------------------------

def _text_detected(spark, sf_dir):
    return detect.with_detection(fixtures.spread_articles(spark, sf_dir))


@query
def q_dataset_summary(spark, sf_dir):
    return summary.dataset_summary(_text_detected(spark, sf_dir)).orderBy("icpsr_study_number")


@query
def q_dataset_summary_merged(spark, sf_dir):
    merged = summary.dataset_summary(_text_detected(spark, sf_dir), merge_numbers=True)
    return merged.orderBy("study_norm")


@query
def q_build_map(spark, sf_dir):
    datasets = summary.dataset_summary(_text_detected(spark, sf_dir))
    return linkmap.build_work_map(datasets, fixtures.articles(spark, sf_dir))


@query
def q_dataset_similarity(spark, sf_dir):
    datasets = summary.dataset_summary(fixtures.detected_stage(spark, sf_dir))
    return similarity.similar_groups(datasets)


@query
def q_dataset_text_groups(spark, sf_dir):
    datasets = summary.dataset_summary(fixtures.detected_stage(spark, sf_dir))
    return similarity.text_groups(datasets)


@query
def q_cluster_datasets(spark, sf_dir):
    datasets = summary.dataset_summary(fixtures.detected_stage(spark, sf_dir))
    return similarity.cluster_datasets(datasets).select("icpsr_study_number", "cluster")


@query
def q_cluster_complete(spark, sf_dir):
    datasets = summary.dataset_summary(fixtures.detected_stage(spark, sf_dir))
    return similarity.cluster_datasets(datasets, linkage="complete").select("icpsr_study_number", "cluster")


@query
def q_similarity_matrix(spark, sf_dir):
    datasets = summary.dataset_summary(fixtures.detected_stage(spark, sf_dir))
    return similarity.clusters_and_matrix(datasets)[1]


# --- report views ---------------------------------------------------------------------

def _view(spark, sf_dir):
    """Works with a text hit, as the reports read them."""
    stored = fixtures.detected_stage(spark, sf_dir)
    return views.prepare_articles(classify.detected_subset(stored))


def _summary(spark, sf_dir):
    return summary.dataset_summary(fixtures.detected_stage(spark, sf_dir))


@query
def q_overview(spark, sf_dir):
    return views.overview(_view(spark, sf_dir))


@query
def q_filter_counts(spark, sf_dir):
    return views.filter_counts(
        _view(spark, sf_dir), query=SEARCH_TEXT, only_hits=True, only_linked=True,
        year_min=2000, year_max=2020, article_type="research")


def _rollup(spark, sf_dir):
    """The counts of two batches of works, merged and stored."""
    articles = _view(spark, sf_dir)
    batches = [rollup.rollup(articles.filter(F.col("seq") % 2 == k)) for k in range(2)]
    return cut(rollup.merged(*batches))


@query
def q_rollup_overview(spark, sf_dir):
    return rollup.overview(_rollup(spark, sf_dir))


@query
def q_rollup_counts(spark, sf_dir):
    return rollup.filter_counts(_rollup(spark, sf_dir), only_hits=True, year_min=2000, year_max=2020, article_type="research")


@query
def q_rollup_journals(spark, sf_dir):
    return rollup.journal_ranking(_rollup(spark, sf_dir))


@query
def q_rollup_profile(spark, sf_dir):
    return rollup.journal_profile(_rollup(spark, sf_dir))


def _search(spark, sf_dir):
    return views.article_table(
        _view(spark, sf_dir), query=SEARCH_TEXT, only_hits=True, year_min=1999, year_max=2022,
        article_type="research")


@query
def q_article_search(spark, sf_dir):
    return _search(spark, sf_dir).select(
        "row_id", "seq", "title", "journal", "year", "has_dataset_link")


INDEXED_PATTERNS = ("title 1[0-9]{2} ", "dup1[0-4]$|icpsr010(05|07)", "src1[0-4]?$", "[a-z]*")


@query
def q_indexed_search(spark, sf_dir):
    """Several searches of one index over the articles; the last pattern can only be answered by a scan."""
    index = textindex.build_index(_view(spark, sf_dir), f"{_file_folder(spark)}/index")
    found = [index.search(pattern).select(F.lit(i).alias("pattern"), "seq") for i, pattern in enumerate(INDEXED_PATTERNS)]
    return reduce(lambda a, b: a.unionByName(b), found)


@query
def q_article_detail(spark, sf_dir):
    return views.article_detail(_search(spark, sf_dir))


@query
def q_dataset_ranking(spark, sf_dir):
    return views.dataset_ranking(_summary(spark, sf_dir), _view(spark, sf_dir))


@query
def q_dataset_totals(spark, sf_dir):
    return views.dataset_totals(_summary(spark, sf_dir), _view(spark, sf_dir))


@query
def q_dataset_articles(spark, sf_dir):
    return views.dataset_articles(_view(spark, sf_dir))


@query
def q_journal_ranking(spark, sf_dir):
    return views.journal_ranking(_view(spark, sf_dir))


@query
def q_journal_datasets(spark, sf_dir):
    return views.journal_datasets(_view(spark, sf_dir), _summary(spark, sf_dir))


@query
def q_article_lookup(spark, sf_dir):
    """The card of the article with the highest score."""
    numbered = _search(spark, sf_dir)
    best = numbered.orderBy(F.desc("detection_score"), "seq").first()
    return views.article_detail(numbered, best["row_id"] if best else -1)


@query
def q_dataset_lookup(spark, sf_dir):
    """The summary row of the most used dataset."""
    datasets = _summary(spark, sf_dir)
    best = views.dataset_ranking(datasets, _view(spark, sf_dir), 1).select("icpsr_study_number")
    number = identifiers.study_key("icpsr_study_number")
    return views.prepare_datasets(datasets).join(
        best.select(number.alias("study_norm")), "study_norm", "left_semi").orderBy("icpsr_study_number").limit(1)


@query
def q_journal_rows(spark, sf_dir):
    """Works of the first journal by name."""
    view = _view(spark, sf_dir)
    first = views.journals(view).agg(F.min("journal").alias("journal"))
    return views.dataset_articles(view.join(first, "journal", "left_semi"))


@query
def q_journal_profile(spark, sf_dir):
    return views.journal_profile(_view(spark, sf_dir))


@query
def q_journals(spark, sf_dir):
    return views.journals(_view(spark, sf_dir))
