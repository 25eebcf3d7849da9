"""Article, map and page views derived from the given tables, the same text in both engines."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeharbor.functions.core import as_column, let
from citeharbor.functions.patterns import ARCHIVE
from citeharbor.operators.references import with_evidence
from citeharbor.sources.readers import read_table, spread
from citeharbor.sources.stages import load_or_build, shared_folder

WORK_URL = "https://openalex.org/W"

ARTICLES_SQL = r"""
SELECT doc_id AS seq,
 concat('https://openalex.org/W', doc_id) AS id,
 concat('Title ', doc_id, ' ', CASE WHEN doc_id % 3 = 0 THEN text ELSE split_part(text, '.', 1) END) AS title,
 CASE WHEN doc_id % 11 = 0 THEN NULL
      WHEN doc_id % 13 = 1 THEN concat('https://doi.org/10.5555/dup', doc_id % 40)
      WHEN doc_id % 17 = 2 THEN concat('https://doi.org/10.3886/icpsr', lpad(CAST(1000 + doc_id % 37 AS STRING), 5, '0'))
      WHEN doc_id % 17 = 3 THEN concat('10.3886/E', 100000 + doc_id)
      ELSE concat('HTTPS://dx.doi.org/10.1000/J.', doc_id) END AS doi,
 CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(1998 + doc_id % 27 AS INT) END AS publication_year,
 doc_id % 8 <> 0 AS is_oa,
 CASE WHEN doc_id % 10 = 1 THEN 'ICPSR Data Holdings' WHEN doc_id % 23 = 2 THEN 'OpenICPSR'
      WHEN doc_id % 29 = 3 THEN NULL ELSE concat('Journal of ', source) END AS host_venue,
 CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS abstract_text,
 CASE doc_id % 9 WHEN 0 THEN '[]'
   WHEN 1 THEN concat('["https://openalex.org/W', doc_id + 15, '","https://openalex.org/W', doc_id - doc_id % 16, '","https://openalex.org/W', doc_id - doc_id % 16, '"]')
   WHEN 2 THEN concat('https://openalex.org/W', doc_id - doc_id % 16, '; https://openalex.org/W', doc_id, ' ;')
   WHEN 3 THEN concat('https://openalex.org/W', doc_id - doc_id % 16)
   WHEN 4 THEN '{"x":"a;b"}'
   WHEN 5 THEN NULL
   WHEN 6 THEN concat('["https://openalex.org/W', doc_id - doc_id % 16, '",null]')
   ELSE concat('["https://openalex.org/W', doc_id * 7 % 200, '","https://openalex.org/W', doc_id * 3 % 200, '"]') END AS referenced_works,
 concat(text, '. ', CASE doc_id % 24
   WHEN 0 THEN concat('See 10.3886/ICPSR0', 1000 + doc_id % 37, '.v1 now.')
   WHEN 1 THEN concat('See 10.3886/icpsr0', 1000 + doc_id % 37, ' now.')
   WHEN 2 THEN concat('We use ICPSR ', 1000 + doc_id % 37, ' here.')
   WHEN 3 THEN concat('Based on ICPSR Study No. ', 1000 + doc_id % 37, ' data.')
   WHEN 4 THEN concat('Based on ICPSR Study No.', 1000 + doc_id % 37, ' data.')
   WHEN 5 THEN concat('Files of ICPSR #', doc_id % 37, ' were read.')
   WHEN 6 THEN 'The data obtained from ICPSR were cleaned.'
   WHEN 7 THEN concat('Data downloaded from ICPSR ', 1000 + doc_id % 37, ' and ICPSR 123456789.')
   WHEN 8 THEN 'ICPSR is one archive.'
   WHEN 9 THEN 'ICPSR. The ICPSR! Why icpsr?'
   WHEN 10 THEN concat('Repositories such as ICPSR ', 1000 + doc_id % 37, ' exist.')
   WHEN 11 THEN concat('For example, ICPSR. We accessed ICPSR ', 1000 + doc_id % 37, '.')
   WHEN 12 THEN concat('A 10.3886/ICPSR', 1000 + doc_id % 37, ' and 10.3886/ICPSR2222.v2.')
   WHEN 13 THEN 'See ICPSR 12 and ICPSR 34.'
   WHEN 14 THEN 'See 10.3886/E123456V1 today.'
   WHEN 15 THEN concat('Datasets  provided by ICPSR; icpsr', 1000 + doc_id % 37, '.')
   ELSE 'Nothing to report.' END) AS fulltext
FROM documents
"""

# One mapped work per block of 16 documents, a second row for every fourth of them.
MAP_SQL = r"""
SELECT block AS seq, concat('https://openalex.org/W', block) AS openalex_work_id,
 CASE WHEN block % 48 = 0 THEN NULL ELSE concat('10.3886/icpsr0', 1000 + block % 37) END AS icpsr_doi,
 CASE WHEN block % 80 = 0 THEN NULL ELSE CAST(1000 + block % 37 AS BIGINT) END AS icpsr_study_number
FROM (SELECT doc_id - doc_id % 16 AS block FROM documents GROUP BY doc_id - doc_id % 16) blocks
UNION ALL
SELECT 1000000000 + block, concat('https://openalex.org/W', block), concat('10.3886/icpsr9', block % 37), NULL
FROM (SELECT doc_id - doc_id % 64 AS block FROM documents GROUP BY doc_id - doc_id % 64) blocks
"""

URLS_SQL = r"""
SELECT w.*,
 CASE w.seq % 4 WHEN 0 THEN p.url WHEN 1 THEN concat('http://missing.example/', w.seq) ELSE NULL END AS fulltext_url,
 CASE w.seq % 3 WHEN 0 THEN p.url ELSE NULL END AS record_url
FROM articles w LEFT JOIN pages p ON p.page_id = w.seq
"""


# Reference cells as they are, with text after them, as a part of a list, and with single quotes.
REFERENCE_CELLS_SQL = r"""
SELECT seq, CASE seq % 4 WHEN 0 THEN referenced_works WHEN 1 THEN referenced_works || ' x'
 WHEN 2 THEN referenced_works || ' ; c' ELSE replace(referenced_works, '"', chr(39)) END AS referenced_works
FROM articles
"""

# Landing pages with every field: title, badges, a subject list, descriptions, creators and a DOI.
STUDY_PAGES_SQL = r"""
SELECT page_id, concat('<html><head><title>x</title></head><body><h1>Study <b>', page_id, '</b> &amp; more</h1>',
 CASE WHEN page_id % 3 = 0 THEN concat('<a class="x badge">Topic ', page_id % 7, '</a><a class="badge">Topic <i>b</i></a>') ELSE '' END,
 CASE WHEN page_id % 4 = 1 THEN concat('<ul class="subject-list"><li><a href="/s">Item ', page_id % 5, '</a></li></ul>') ELSE '' END,
 CASE page_id % 5 WHEN 0 THEN concat('<div class="abstract"><p>About ', page_id, '</p><p>end</p></div>')
   WHEN 1 THEN concat('<div class="abstract">late</div><section id="description">First ', page_id, '</section>')
   WHEN 2 THEN concat('<p class="description">Text &lt;', page_id, '&gt;</p>') ELSE '' END,
 CASE WHEN page_id % 6 = 2 THEN concat('<span>Principal Investigator: Dr ', page_id, '</span>') ELSE '' END,
 CASE WHEN page_id % 12 = 2 THEN '<a href="/i">Co-Investigator B</a>' ELSE '' END,
 CASE WHEN page_id % 8 = 4 THEN concat('<p>See https://doi.org/10.3886/ICPSR0', 1000 + page_id, '.v1 now</p>') ELSE '' END,
 '<p>', url, '</p></body></html>') AS html
FROM pages
"""


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL whose table names stand for the given frames."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
    return spark.sql(sql, **tables)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with injected evidence, one per document."""
    return _run(spark, ARTICLES_SQL, documents=read_table(spark, sf_dir, "documents"))


def reference_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference cells, three in four of them no longer JSON."""
    return _run(spark, REFERENCE_CELLS_SQL, articles=articles(spark, sf_dir))


def study_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing pages that hold every field, one per page."""
    return _run(spark, STUDY_PAGES_SQL, pages=read_table(spark, sf_dir, "pages"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores for per-row text work."""
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def spread_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles, spread over the cores for per-row text work."""
    return _run(spark, ARTICLES_SQL, documents=texts(spark, sf_dir))


def work_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, MAP_SQL, documents=read_table(spark, sf_dir, "documents"))


def articles_with_urls(spark: SparkSession, sf_dir: str,
                       source: DataFrame | None = None) -> DataFrame:
    """Articles with candidate page URLs in place of their text."""
    source = articles(spark, sf_dir) if source is None else source
    return _run(spark, URLS_SQL, articles=source,
                pages=read_table(spark, sf_dir, "pages")).drop("fulltext")


def gathered(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, texts``: the texts of each key, which is one unless keys repeat; NULLs are left out."""
    return texts.filter(F.col(text).isNotNull()).groupBy(key).agg(F.collect_list(text).alias("texts"))


def word_positions(texts: Column | str) -> Column:
    """A list of texts as one map from word to its positions; NULL stays NULL.

    The words are sorted inside the row and cut where another word begins; nothing is shuffled.
    """
    texts = as_column(texts)
    tokens = F.flatten(F.transform(texts, lambda t: F.transform(
        F.split(t, " "), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))))

    def entries(tokens: Column) -> Column:
        begins = F.array_compact(F.transform(tokens, lambda x, i: F.when(
            ~x["word"].eqNullSafe(F.get(tokens, i - 1)["word"]), i)))
        places = F.transform(tokens, lambda x: x["pos"])
        return let(places, lambda places: let(begins, lambda begins: F.transform(begins, lambda i, k: F.struct(
            F.get(tokens, i)["word"], F.slice(places, i + 1, F.coalesce(F.get(begins, k + 1), F.size(tokens)) - i)))))

    return F.when(texts.isNotNull(), F.map_from_entries(let(F.sort_array(tokens), entries)))


def word_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word_index``: each text as a map from word to its positions."""
    return gathered(texts, key, text).select(key, word_positions("texts").alias("word_index"))


def nested_works(spark: SparkSession, sf_dir: str, with_abstract: bool = True) -> DataFrame:
    """Works in the nested source layout."""
    if with_abstract:
        source = spread_articles(spark, sf_dir)
        abstracts = gathered(source.filter(F.trim("abstract_text") != ""), "seq", "abstract_text")
        # The map is several times as large as the text and is made behind the join.
        base = articles_with_urls(spark, sf_dir, source).join(abstracts, "seq", "left").withColumn(
            "word_index", word_positions("texts"))
    else:
        base = articles_with_urls(spark, sf_dir).withColumn(
            "word_index", F.lit(None).cast("map<string,array<int>>"))
    seq = F.col("seq")
    return base.select(
        "seq", "id", "title", "doi", "publication_year",
        F.from_json(F.when((seq % 9).isin(0, 1, 6, 7, 8), F.col("referenced_works")),
                    "array<string>").alias("referenced_works"),
        F.col("word_index").alias("abstract_inverted_index"),
        F.struct(
            "is_oa",
            F.when(seq % 3 == 0, None).when(seq % 3 == 1, "").otherwise("gold").alias("oa_status"),
            F.concat(F.lit("http://oa.example/"), seq).alias("oa_url")).alias("open_access"),
        F.struct(
            "doi",
            F.when(seq % 5 != 0, F.concat(F.lit("https://openalex.org/W"), seq))
            .alias("openalex")).alias("ids"),
        F.when(seq % 31 != 0, F.struct(
            F.col("record_url").alias("landing_page_url"),
            F.when(seq % 7 == 0, "").otherwise(F.col("fulltext_url")).alias("pdf_url"),
            F.struct(F.col("host_venue").alias("display_name")).alias("source"),
        )).alias("primary_location"))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with text and reference evidence and a category, without their text."""
    return with_evidence(
        spread_articles(spark, sf_dir), work_map(spark, sf_dir), keep_text=False)


def detected_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection table as a stored stage of this application; views read it.

    It is built again when files of the documents or the rules have changed.
    """
    tag = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:12]
    path = (f"{shared_folder(spark)}/citeharbor/{spark.sparkContext.applicationId}"
            f"/{tag}/detection")
    rules = hashlib.md5(repr((ARCHIVE, ARTICLES_SQL, MAP_SQL)).encode()).hexdigest()
    return load_or_build(spark, path, lambda: detected(spark, sf_dir), required="has_icpsr",
                         inputs=[read_table(spark, sf_dir, "documents")], version=rules)


def articles_of(documents: DataFrame) -> DataFrame:
    """Articles of some documents; columns of documents beside theirs are kept."""
    more = [c for c in documents.columns if c.startswith("_")]
    source = documents.sparkSession
    sql = ARTICLES_SQL.replace("SELECT doc_id AS seq", "SELECT " + "".join(f"{c}, " for c in more) + "doc_id AS seq", 1)
    return _run(source, sql, documents=documents)
