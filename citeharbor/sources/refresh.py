"""Stored results of row-local work over a folder of files, of which only what changed is done again.

Each refresh that finds work writes one generation, ``rows-N``, with the results of the files that are
new or changed, and then ``manifest-N``: every current file with its length, time, rule version and the
generation that holds its rows. The manifest is the commit: rows count only if the last complete
manifest names their file in their generation, so rows of changed or removed files are never read, and
a refresh that was broken off leaves no trace. After ``MOST_GENERATIONS`` the rows are written together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeharbor.sources.stages import committed, cut, listing, remove

SOURCE = "_source"
MOST_GENERATIONS = 16
KEY = ["file", "length", "changed", "version"]


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    numbers = sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))
    return [n for n in numbers if committed(spark, f"{path}/manifest-{n}")]


def _source(file) -> F.Column:
    return F.xxhash64(file)


def _rows(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The rows that a manifest names."""
    parts = []
    for generation in sorted(r[0] for r in manifest.select("generation").distinct().collect()):
        valid = manifest.filter(F.col("generation") == generation).select(_source(F.col("file")).alias(SOURCE))
        parts.append(spark.read.parquet(f"{path}/rows-{generation}").join(valid, SOURCE, "left_semi"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def refresh(spark: SparkSession, path: str, folder: str, build: Callable[[DataFrame], DataFrame],
            version: str = "") -> DataFrame:
    """``build`` over the Parquet files of ``folder``, stored under ``path``; unchanged files are not read.

    ``build`` works on each row alone and keeps the column ``_source``. Another ``version`` of its rules
    makes all files count as changed. Lists of files are as long as those that Spark makes itself.
    """
    files = cut(listing(spark, folder).withColumn("version", F.lit(version)))
    numbers = _generations(spark, path)
    last = numbers[-1] if numbers else 0
    known = spark.read.parquet(f"{path}/manifest-{last}") if last else None
    keep = known.join(files, KEY, "left_semi") if last else None
    todo = files.join(known, KEY, "left_anti") if last else files
    paths = sorted(r["file"] for r in todo.select("file").collect())
    if last and not paths and keep.count() == known.count():
        return _rows(spark, path, known).drop(SOURCE)
    number = last + 1
    remove(spark, f"{path}/rows-{number}")
    # Encoded as in the scan's own file paths; a plus sign is no space there.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    reader = spark.read.option("recursiveFileLookup", True)
    read = reader.parquet(*paths) if paths else reader.parquet(folder).filter(F.lit(False))
    rows = build(read.withColumn(SOURCE, _source(name)))
    manifest = todo.select(*KEY).withColumn("generation", F.lit(number))
    if last:
        manifest = manifest.unionByName(keep.select(*manifest.columns))
    manifest = cut(manifest)
    if last and manifest.select("generation").distinct().count() > MOST_GENERATIONS:
        rows = rows.unionByName(_rows(spark, path, keep))
        manifest = manifest.withColumn("generation", F.lit(number))
    rows.write.mode("overwrite").parquet(f"{path}/rows-{number}")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest-{number}")
    return _rows(spark, path, spark.read.parquet(f"{path}/manifest-{number}")).drop(SOURCE)


def tidy(spark: SparkSession, path: str) -> list[int]:
    """Delete the generations that the last manifest no longer names; call it when nobody reads them."""
    numbers = _generations(spark, path)
    if not numbers:
        return []
    named = {r[0] for r in spark.read.parquet(f"{path}/manifest-{numbers[-1]}").select("generation").distinct().collect()}
    gone = [n for n in range(1, numbers[-1]) if n not in named]
    for number in gone:
        remove(spark, f"{path}/rows-{number}")
    for number in numbers[:-1]:
        remove(spark, f"{path}/manifest-{number}")
    return gone
