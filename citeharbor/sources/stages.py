"""Stored stages: written once to shared storage, then read back."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Without one, a session on a single machine gets a temporary folder; on a cluster that would lose
    rows, so it is an error there.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="citeharbor-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def committed(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` ran to its end (it then leaves a marker file)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    marker = hadoop.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def usable_stage(spark: SparkSession, path: str, required: str) -> DataFrame | None:
    """The stored table if it is complete and some row has a non-empty ``required``."""
    if not committed(spark, path):
        return None
    stored = spark.read.parquet(path)
    if required not in stored.columns:
        return None
    return None if stored.filter(F.col(required).cast("string") != "").isEmpty() else stored


def listing(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, length, changed`` of the files of a table, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def manifest(spark: SparkSession, inputs: Sequence[DataFrame], version: str) -> DataFrame | None:
    """What a stage was made of: the files of its inputs and the version of its rules.

    None if an input does not come from files alone; then nothing can tell whether it has changed.
    """
    if not inputs or any(not df.inputFiles() or _in_memory(df) for df in inputs):
        return None
    files = sorted({unquote(f) for df in inputs for f in df.inputFiles()})
    return cut(listing(spark, files).withColumn("version", F.lit(version)))


def _in_memory(df: DataFrame) -> bool:
    """True when some leaf of the plan is no file scan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return any("LogicalRelation" not in leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size()))


def unchanged(spark: SparkSession, path: str, made_of: DataFrame | None) -> bool:
    """True when the stage at ``path`` was made of just this."""
    if made_of is None or not committed(spark, f"{path}_manifest"):
        return False
    before = spark.read.parquet(f"{path}_manifest")
    return made_of.exceptAll(before).isEmpty() and before.exceptAll(made_of).isEmpty()


def forget(spark: SparkSession, path: str) -> None:
    """Drop the manifest of a stage that is about to be written."""
    remove(spark, f"{path}_manifest")


def remember(spark: SparkSession, path: str, made_of: DataFrame | None) -> None:
    if made_of is not None:
        made_of.write.parquet(f"{path}_manifest")


def reads_from(df: DataFrame, path: str) -> bool:
    """True when a table is read from files in the folder ``path``, which it then cannot replace."""
    def full(name: str) -> str:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()

    spark = df.sparkSession
    return any(full(unquote(f)).startswith(full(path) + "/") for f in df.inputFiles()[:1])


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  required: str = "fulltext", rebuild: bool = False,
                  inputs: Sequence[DataFrame] = (), version: str = "") -> DataFrame:
    """Read a stored stage, or build, write and read it.

    ``rebuild`` replaces a stored one, unless all ``inputs`` are read from files and neither those nor
    the ``version`` of the rules have changed since it was built: a manifest beside the stage tells. It is
    removed before the stage is written, so an interrupted run leaves none. Without ``rebuild`` and with
    ``inputs``, a stage that was made of something else is replaced as well.
    """
    made_of = manifest(spark, inputs, version)
    usable = unchanged(spark, path, made_of) if inputs else not rebuild
    stored = usable_stage(spark, path, required) if usable else None
    if stored is not None:
        return stored
    forget(spark, path)
    build().write.mode("overwrite").parquet(path)
    remember(spark, path, made_of)
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The frame read from a checkpoint in the shared folder: computed once, reused often."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
