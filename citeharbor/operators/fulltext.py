"""Text of each article: its page, else its abstract, else nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.core import non_empty, strip
from citeharbor.operators.pages import with_page_text
from citeharbor.sources.stages import cut


def first_copies(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """``url, page_id`` of the first copy of each page; only these two columns move."""
    return pages.groupBy("url").agg(F.min(page_id).alias(page_id))


def page_texts(pages: DataFrame, wanted: DataFrame, page_id: str = "page_id") -> DataFrame:
    """``page_id, text`` of the wanted pages that hold text, parsed once each."""
    chosen = pages.join(wanted.select(page_id).distinct(), page_id, "left_semi")
    return with_page_text(chosen.select(page_id, "html")).filter(F.col("text").isNotNull())


def attach_fulltext(articles: DataFrame, pages: DataFrame | None, key: str = "seq",
                    page_id: str = "page_id") -> DataFrame:
    """Add ``fulltext``: page of ``fulltext_url``, page of ``record_url``, abstract, ``""``.

    Without pages, or without URL columns, the abstract is all there is.

    Candidate URLs are resolved to page ids on narrow tables first; missing URLs
    are gone by then and copies of a page are reduced to their smallest id
    before any shuffle. The HTML itself moves once, by its unique id, and only
    for pages that some article points to. Which of an article's pages counts is
    decided on ids; its text is then joined once.
    """
    abstract = (F.when(strip("abstract_text") != "", F.col("abstract_text"))
                if "abstract_text" in articles.columns else F.lit(None).cast("string"))
    slots = [c for c in ("fulltext_url", "record_url") if c in articles.columns]
    if pages is None or not slots:
        return articles.withColumn("fulltext", F.coalesce(abstract, F.lit("")))
    candidates = (
        articles.select(key, F.explode(F.array(*[
            F.struct(F.lit(i).alias("slot"), non_empty(c).alias("url"))
            for i, c in enumerate(slots)])).alias("c"))
        .select(key, "c.slot", "c.url").filter(F.col("url").isNotNull()))
    resolved = candidates.join(first_copies(pages, page_id), "url").select(key, "slot", page_id)
    texts = cut(page_texts(pages, resolved, page_id))  # parsed once, read twice
    readable = texts.select(page_id)
    # Smallest slot first: slot and page id as one ordered value of numbers.
    chosen = (resolved.join(readable, page_id).groupBy(key)
              .agg(F.min(F.struct("slot", page_id)).alias("_first"))
              .select(key, F.col(f"_first.{page_id}").alias(page_id)))
    found = chosen.join(texts.withColumnRenamed("text", "_page_text"), page_id).drop(page_id)
    return (articles.join(found, key, "left")
            .withColumn("fulltext", F.coalesce("_page_text", abstract, F.lit("")))
            .drop("_page_text"))
