"""Table readers with explicit schemas."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeharbor import schemas
from citeharbor.functions.identifiers import study_key
from citeharbor.operators.binding import bind
from citeharbor.sources.arrival import numbered, placed
from citeharbor.sources.csv_records import read_records

# Quotes are doubled inside quoted fields and text may hold line breaks.
CSV_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
BROKEN = "_broken"


def _parsed(record: Column) -> Column:
    """A work from its JSON text; ``work`` is NULL if the text is no JSON object.

    A value that does not fit its field is NULL and leaves the rest of the work alone.
    """
    broken = T.StructField(BROKEN, T.StringType())
    options = {"columnNameOfCorruptRecord": BROKEN}
    full = F.from_json(record, T.StructType([*schemas.WORKS.fields, broken]), options)
    # With text fields only, nothing but broken JSON can fail; tested for records that did fail.
    syntax = F.from_json(record, T.StructType([T.StructField("id", T.StringType()), broken]), options)

    def judged(work: Column) -> Column:
        fails = work.isNull() | (work[BROKEN].isNotNull() & (syntax.isNull() | syntax[BROKEN].isNotNull()))
        return F.struct(F.when(~fails, work.dropFields(BROKEN)).alias("work"))

    return F.get(F.transform(F.array(full), judged), F.lit(0))


def read_work_records(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """``seq, file, place, record, work`` of each record in JSON files, in arrival order.

    JSON Lines by default, which Spark splits; ``one_array`` reads files that hold one JSON array each,
    of at most 2 GB. ``place`` is the line or element of the record in its file, from 0. ``work`` is NULL
    for a record that is no JSON object, and for a file that is no array, which is a single record.
    Blank lines are no records.
    """
    scan = placed(spark.read.text(path, wholetext=one_array, **({} if one_array else {"lineSep": "\n"})))
    if one_array:
        elements = F.from_json("value", "array<string>")
        scan = scan.withColumn("parts", F.when(elements.isNull(), F.array("value")).otherwise(elements))
        rows = numbered(scan, "first", F.size("parts")).select(
            "_file", "first", F.posexplode("parts").alias("place", "record"))
        rows = rows.withColumn("seq", F.col("first") + F.col("place"))
    else:
        rows = numbered(scan).select("_file", "seq", F.col("_place").alias("place"), F.col("value").alias("record"))
        rows = rows.filter(F.trim("record", F.lit(" \t\r")) != "")
    return bind(rows, _parsed(F.col("record")), ["seq", "_file", "place", "record"]).select(
        "seq", F.col("_file").alias("file"), F.col("place").cast("long").alias("place"), "record", "work")


def read_works(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Nested works in arrival order (``seq``); records that cannot be read are left out.

    :func:`rejected_works` has those.
    """
    kept = read_work_records(spark, path, one_array).filter(F.col("work").isNotNull())
    return kept.select("work.*", "seq")


def rejected_works(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """``seq, file, place, record`` of the records that :func:`read_works` leaves out."""
    return read_work_records(spark, path, one_array).filter(F.col("work").isNull()).drop("work")


def _typed(name: str, kind: T.DataType) -> Column:
    """A CSV field as its column type; whole numbers may be written as ``2001.0``."""
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return study_key(name).try_cast(kind).alias(name)
    return F.col(name).try_cast(kind).alias(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """CSV by column name: columns may come in any order, in each file its own; absent ones are NULL.

    A field that does not fit its type is NULL and leaves the rest of its row alone. Without a ``seq``
    column the position in the files is the arrival number. ``keep_extra`` adds the columns outside the
    schema as text. Large files are read by many tasks, also where fields hold line breaks. Of columns
    with one name in a file the first counts.
    """
    records, headers = read_records(spark, path)
    width = max((len(h) for h in headers), default=0)
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "encoding")}
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(width, 1))])
    rows = bind(records, F.from_csv("value", F.lit(fields.simpleString()[7:-1].replace(":", " ")), options),
                ["seq", "header"]).withColumnRenamed("seq", "_seq")

    def column(name: str) -> Column:
        """The field of that name, which may stand elsewhere in files with other headers."""
        at: dict[int, list[int]] = {}
        for number, header in enumerate(headers):
            if name in header:
                at.setdefault(header.index(name), []).append(number)
        if len(at) == 1 and sum(map(len, at.values())) == len(headers):
            return F.col(f"c{next(iter(at))}")
        value = F.lit(None).cast("string")
        for place, numbers in at.items():
            value = F.when(F.col("header").isin(numbers), F.col(f"c{place}")).otherwise(value)
        return value

    extra = list(dict.fromkeys(c for h in sorted(headers) for c in h if c not in schema.names)) if keep_extra else []
    known = [f for f in schema.fields if any(f.name in h for h in headers)]
    taken = rows.select("_seq", *[column(c).alias(c) for c in [*(f.name for f in known), *extra]])
    present = taken.select("_seq", *[_typed(f.name, f.dataType) for f in known], *[quoted(c) for c in extra])
    if "seq" in schema.names and "seq" not in present.columns:
        present = present.withColumn("seq", F.col("_seq"))
    return schemas.with_optional(present, schema).select(*schema.names, *[quoted(c) for c in extra])


def quoted(name: str) -> Column:
    """A column by its name as it is, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_articles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat articles; columns such as authors or work type are kept."""
    return read_csv(spark, path, schemas.ARTICLES, keep_extra=True)


def read_detection_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stored detection table; further columns are kept for search and counts."""
    return read_csv(spark, path, schemas.DETECTION, keep_extra=True)


def read_optional(spark: SparkSession, path: str, schema: T.StructType,
                  kind: str = "parquet") -> DataFrame:
    """A table that may not exist yet: then an empty typed one, with a warning."""
    try:
        if kind == "csv":
            return read_csv(spark, path, schema)
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        warnings.warn(f"no table at {path}; continuing without it", stacklevel=2)
        return spark.createDataFrame([], schema)


def read_datasets(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read_optional(spark, path, schemas.DATASETS, kind)


def read_work_map(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Dataset-to-work map; rows without a work id are dropped.

    Rows without a ``seq`` of their own are numbered as they stand in the files.
    """
    table = read_optional(spark, path, schemas.WORK_MAP, kind)
    if kind != "csv" and table.inputFiles():
        table = numbered(placed(table), "_arrival").withColumn("seq", F.coalesce("seq", "_arrival"))
    return table.select(*schemas.WORK_MAP.names).filter(F.col("openalex_work_id").isNotNull())


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(table: DataFrame, key: str, tasks_per_core: int = 2) -> DataFrame:
    """Even out a scan that comes in fewer pieces than the cluster has cores.

    Meant for a plain scan of wide text before per-row work; a scan with enough
    pieces, the normal case at scale, is returned as it is and not shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(tasks_per_core * cores, key)
