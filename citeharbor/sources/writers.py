"""Sinks of a run."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.sources.readers import CSV_OPTIONS
from citeharbor.sources.stages import cut


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines, non-ASCII text as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes; an empty string is read back as NULL."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).csv(path)


def write_table(df: DataFrame, path: str, with_csv: bool = False) -> None:
    """Parquet, and on request a CSV copy beside it (``path + '_csv'``)."""
    df.write.mode("overwrite").parquet(path)
    if with_csv:
        write_csv(df.sparkSession.read.parquet(path), f"{path}_csv")


def write_if_any(df: DataFrame, path: str, with_csv: bool = False) -> bool:
    """Write unless the table is empty; tells whether it was written.

    Meant for small results: the rows are computed once and kept for both steps.
    """
    df = cut(df)
    if df.isEmpty():
        return False
    write_table(df, path, with_csv)
    return True


def write_report(stats: DataFrame, path: str) -> DataFrame:
    """Metrics as ``stage.metric: value`` lines of text; returns the counts, computed once."""
    stats = cut(stats)
    line = F.concat("stage", F.lit("."), "metric", F.lit(": "), F.col("value").cast("string"))
    stats.select(line.alias("value")).write.mode("overwrite").text(path)
    return stats


def write_optional(build, path: str) -> bool:
    """Write what ``build()`` returns; a failure of this optional stage is a warning."""
    try:
        return write_if_any(build(), path)
    except Exception as error:  # noqa: BLE001 - any failure leaves the run intact
        warnings.warn(f"optional stage for {path} failed: {error}", stacklevel=2)
        return False
