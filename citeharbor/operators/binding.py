"""Evaluate costly columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, value: Column, keep: list[str] | None = None) -> DataFrame:
    """Unpack a struct column beside the ``keep`` columns (default: all).

    The struct goes through a one-row generator. A projection would be copied
    into every later filter on its fields; filters stay above a generator, so
    the expression is computed once per row. Nothing is shuffled.
    """
    return df.select(*(df.columns if keep is None else keep), F.inline_outer(F.array(value)))
