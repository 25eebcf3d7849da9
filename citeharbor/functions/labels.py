"""Display text used by the report views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeharbor.functions.core import as_column


def shorten(value: Column | str, width: int) -> Column:
    """At most ``width`` characters followed by an ellipsis; NULL gives the empty string."""
    text = F.coalesce(as_column(value).cast("string"), F.lit(""))
    return F.when(F.length(text) > width,
                  F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def row_label(row_id: Column | str, title: Column | str, width: int = 90) -> Column:
    return F.concat(F.lit("["), as_column(row_id).cast("string"), F.lit("] "),
                    shorten(title, width))


def dataset_label(dataset: Column | str, title: Column | str, count: Column | str,
                  width: int = 80) -> Column:
    return F.concat(as_column(dataset).cast("string"), F.lit(" · "), shorten(title, width),
                    F.lit(" (n="), F.coalesce(as_column(count), F.lit(0)).cast("string"),
                    F.lit(")"))


def year_range(first: Column | str, last: Column | str) -> Column:
    first, last = as_column(first), as_column(last)
    return F.when(
        first.isNotNull() & last.isNotNull(),
        F.concat(first.try_cast("int").cast("string"), F.lit("–"), last.try_cast("int").cast("string")),
    ).otherwise("n/a")
