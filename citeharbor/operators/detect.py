"""Text detection over a table of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.detection import RESULT_FIELDS, detect, document_signals
from citeharbor.functions.patterns import ARCHIVE, PatternSet
from citeharbor.operators.binding import bind


def with_detection(articles: DataFrame, text: str = "fulltext",
                   patterns: PatternSet = ARCHIVE) -> DataFrame:
    """Add the seven text-detection columns.

    The patterns run once per document, whatever is filtered later. Row-local.
    """
    kept = [c for c in articles.columns if c not in RESULT_FIELDS]
    return bind(articles, detect(text, patterns), kept)


def signal_table(articles: DataFrame, text: str = "fulltext", key: str = "seq",
                 patterns: PatternSet = ARCHIVE) -> DataFrame:
    """One row per signal, in reading order within a document."""
    return articles.select(key, F.inline(document_signals(text, patterns)))
