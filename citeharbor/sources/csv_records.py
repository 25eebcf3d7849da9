"""Records of CSV files whose quoted fields hold line breaks, read by many tasks a file.

A line break ends a record unless it stands inside quotes, which depends on everything before it in
the file. Per line, two bits say how it ends if it begins outside quotes, and if it begins inside.
Such functions of one bit compose, so every block is summed up by one of them and by the records that
begin in it in either case. The composition over the blocks of a file, in order, tells how each block
begins and the number of its first record; then each task joins the lines of its blocks to records.
Records that reach over the end of a block are put together from their pieces.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeharbor.sources.arrival import placed

SAME = 2  # a line that ends as it begins: bit 0 from outside, bit 1 from inside
FRESH, OUTSIDE, QUOTED, CLOSED = range(4)


def line_code(line: Column) -> Column:
    """How a line ends when it begins outside quotes (bit 0) and inside (bit 1); 1 is inside.

    A quote opens a field only at its beginning; a doubled quote stays inside; any other quote outside
    quotes is an ordinary character. The line is cut at its quotes; a fold over the pieces follows them.
    """
    def after(state: Column, piece: Column) -> Column:
        opens = F.when(piece.endswith(","), QUOTED).otherwise(OUTSIDE)
        return (F.when(state == QUOTED, CLOSED).when((piece == "") & (state != OUTSIDE), QUOTED).otherwise(opens))

    def inside(pieces: Column, begin: int) -> Column:
        before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return (F.aggregate(before, F.lit(begin), after) == QUOTED).cast("int")

    folded = F.transform(F.array(F.split(line, '"')), lambda p: inside(p, FRESH) + 2 * inside(p, QUOTED))
    return F.when(F.instr(line, '"') == 0, F.lit(SAME)).otherwise(F.get(folded, F.lit(0)))


def begins(codes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """For lines in order, the state each begins in, and that after the last one."""
    turns = np.cumsum(codes == 1)
    fixed = np.maximum.accumulate(np.where((codes == 0) | (codes == 3), np.arange(len(codes)), -1))
    base = np.where(fixed < 0, state, codes[fixed] == 3)
    ends = base ^ ((turns - np.where(fixed < 0, 0, turns[fixed])) & 1)
    return np.append(state, ends[:-1]), int(ends[-1])


def _runs(batch: pa.RecordBatch):
    """(file, block, slice) of the blocks in a batch; the rows of a block lie together."""
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    names = files.indices.to_numpy()
    edges = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield files.dictionary[int(names[a])].as_py(), int(blocks[a]), slice(a, b)


def _summaries(batches):
    """One row for each block: end and number of records begun, for both ways to begin."""
    here, ends, counts, rows = None, [0, 1], [0, 0], []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(2).to_numpy()
        for file, block, part in _runs(batch):
            if (file, block) != here:
                rows += [(*here, *ends, *counts)] if here else []
                here, ends, counts = (file, block), [0, 1], [0, 0]
            for way in (0, 1):
                first, ends[way] = begins(codes[part], ends[way])
                counts[way] += int((first == 0).sum())
    rows += [(*here, *ends, *counts)] if here else []
    names = ["file", "block", "end0", "end1", "n0", "n1"]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)


def _records(known, only_pieces: bool):
    """Records of a partition, joined from their lines; ``piece`` is the block of an incomplete one."""
    def out(rows):
        number, header, piece, value = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array(header, pa.int32()), pa.array(piece, pa.int64()),
             pa.array(value, pa.string())], ["seq", "header", "piece", "value"])

    def run(batches):
        plan, here, state, number, held, cut_off, rows = known.value, None, 0, 0, [], False, []

        def close(ends_open: bool):
            """Give out the held lines as a record, unless it is the header."""
            entry = plan[here]
            if not held or number == entry["header_at"]:
                return
            incomplete = cut_off or ends_open
            if incomplete or not only_pieces:
                rows.append((number - entry["headers"], entry["header"], here[1] if incomplete else None, "\n".join(held)))

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(2).to_numpy()
            for file, block, part in _runs(batch):
                if (file, block) != here:
                    if here:
                        close(state == 1)
                    here = (file, block)
                    state, number = plan[here]["begins"], plan[here]["first"] - 1
                    held, cut_off = [], state == 1
                first, state = begins(codes[part], state)
                lines = batch.column(3).slice(part.start, part.stop - part.start).to_pylist()
                for inside, line in zip(first.tolist(), lines):
                    if not inside:
                        close(False)
                        held, number, cut_off = [], number + 1, False
                    held.append(line)
            if len(rows) > 2000:
                yield out(rows)
                rows = []
        if here:
            close(state == 1)
        if rows:
            yield out(rows)

    return run


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of one file; reads no more than its first lines, through Spark's file systems."""
    hadoop, java = spark._jvm.org.apache.hadoop, spark._jvm.java.io
    place = hadoop.fs.Path(spark._jvm.java.net.URI(path))
    conf = spark._jsc.hadoopConfiguration()
    stream = place.getFileSystem(conf).open(place)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    reader = java.BufferedReader(java.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        text = reader.readLine() or ""
        while text.count('"') % 2 and (more := reader.readLine()) is not None:
            text += "\n" + more
    finally:
        reader.close()
    return tuple(next(csv.reader(io.StringIO(text.removeprefix("\ufeff"))), []))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """``seq, header, value``: the records of a CSV file or folder but for headers and empty lines.

    ``seq`` numbers records in file order, whatever the size of the blocks; ``header`` is the place of
    the file's column names in the list that is returned besides. Two passes: the first counts, and a
    record's text goes through the second only. If quotes reach over a block, one more pass collects
    the pieces of such records.
    """
    lines = placed(spark.read.text(path, lineSep="\n"))
    coded = lines.select("_file", "_block", line_code(F.col("value")).cast("int").alias("code"), "value")
    found = coded.drop("value").mapInArrow(
        _summaries, "file string, block long, end0 long, end1 long, n0 long, n1 long").collect()  # one row a block
    headers: dict[tuple[str, ...], int] = {}
    plan, file, state, total, files = {}, None, 0, 0, 0
    for row in sorted(found, key=lambda r: (r["file"], r["block"])):
        if row["file"] != file:
            file, state, header_at, files = row["file"], 0, total, files + 1
            header = headers.setdefault(header_of(spark, file), len(headers))
        plan[row["file"], row["block"]] = {
            "begins": state, "first": total, "header_at": header_at, "header": header, "headers": files}
        total += row[f"n{state}"]
        state = row[f"end{state}"]
    known = spark.sparkContext.broadcast(plan)
    kind = "seq long, header int, piece long, value string"
    records = coded.mapInArrow(_records(known, False), kind).filter("piece IS NULL").drop("piece")
    if any(entry["begins"] for entry in plan.values()):
        pieces = coded.mapInArrow(_records(known, True), kind).groupBy("seq", "header").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda p: p["value"]),
                         "\n").alias("value"))
        records = records.unionByName(pieces)
    # The first half of a CR LF line end is no part of the last field.
    return records.withColumn("value", F.regexp_replace("value", "\r$", "")).filter("value != ''"), list(headers)
