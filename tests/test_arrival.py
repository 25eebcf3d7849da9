"""Rows keep the order of their files whatever the splits; CSV records and broken JSON by plain models."""

import csv
import io
import json
import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeharbor import schemas
from citeharbor.operators.normalize import dedupe_by_doi, flatten_works
from citeharbor.sources import csv_records, readers

PLAIN = schemas._schema(seq=schemas.LONG, id=schemas.STRING, title=schemas.STRING)


@contextmanager
def split_size(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def lines_file(path, ids):
    path.write_text("".join(json.dumps({"id": f"W{i}", "doi": f"d{i % 7}", "title": "t" * (i % 50)}) + "\n" for i in ids))


def test_json_lines_keep_file_order_for_any_split_size(spark, tmp_path):
    lines_file(tmp_path / "part-0.json", range(5))
    lines_file(tmp_path / "part-1.json", range(5, 900))  # the largest file comes first in Spark's own order
    lines_file(tmp_path / "part-2.json", range(900, 1000))
    want = [(i, f"W{i}") for i in range(1000)]
    for size in ("128m", "4k", "513"):
        with split_size(spark, size):
            works = readers.read_works(spark, str(tmp_path))
            assert sorted((r["seq"], r["id"]) for r in works.select("seq", "id").collect()) == want
            first = dedupe_by_doi(flatten_works(works))
            assert sorted(r["id"] for r in first.collect()) == sorted(f"W{i}" for i in range(7))


def test_broken_records_stand_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id":"W1","publication_year":"abc"}\n\n{"id":"W2"\n[{"id":"W3"}]\nnull\n12\n'
        '{"id":"W4","ids":{"doi":5},"open_access":[1]}\n"x"\r\n  {"id":"W6"}  \r\n{}\n')
    (tmp_path / "b.json").write_text('{"id":"W7"}\n}{\n')
    for size in ("128m", "40"):
        with split_size(spark, size):
            kept = readers.read_works(spark, str(tmp_path)).orderBy("seq").collect()
            out = readers.rejected_works(spark, str(tmp_path)).orderBy("seq").collect()
            assert [(r["seq"], r["id"]) for r in kept] == [(0, "W1"), (6, "W4"), (8, "W6"), (9, None), (10, "W7")]
            assert kept[0]["publication_year"] is None and kept[1]["ids"]["doi"] == "5"
            assert [(r["seq"], r["file"][-6:], r["place"], r["record"].strip()) for r in out] == [
                (2, "a.json", 2, '{"id":"W2"'), (3, "a.json", 3, '[{"id":"W3"}]'), (4, "a.json", 4, "null"),
                (5, "a.json", 5, "12"), (7, "a.json", 7, '"x"'), (11, "b.json", 1, "}{")]
            assert readers.read_work_records(spark, str(tmp_path)).count() == len(kept) + len(out)


def test_arrays_of_works(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"W1","publication_year":"abc"},{"id":"W2"}, 5, null, {"id":"W3","open_access":[1]}]')
    (tmp_path / "b.json").write_text('[{"id":"W4"},{"id"')
    (tmp_path / "c.json").write_text(json.dumps([{"id": "W5", "title": 'é "q" \n'}, {"id": "W6"}], indent=2))
    (tmp_path / "d.json").write_text("[]")
    kept = readers.read_works(spark, str(tmp_path), one_array=True).orderBy("seq").collect()
    assert [(r["seq"], r["id"]) for r in kept] == [(0, "W1"), (1, "W2"), (4, "W3"), (6, "W5"), (7, "W6")]
    assert kept[3]["title"] == 'é "q" \n'
    out = readers.rejected_works(spark, str(tmp_path), one_array=True).orderBy("seq").collect()
    assert [(r["seq"], r["place"], r["record"]) for r in out] == [(2, 2, "5"), (3, 3, None), (5, 0, '[{"id":"W4"},{"id"')]


def state_after(line, inside):
    """How a line ends, letter by letter."""
    fresh, closed = not inside, False
    for i, c in enumerate(line):
        if inside:
            if c == '"':
                inside, closed = False, True
            continue
        if c == '"' and (fresh or closed):
            inside = True
        fresh, closed = c == ",", False
    return inside


def test_line_codes_and_their_composition(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice('a",') for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string")
    got = [r[1] for r in sorted(frame.select("i", csv_records.line_code(F.col("v"))).collect())]
    assert got == [state_after(x, False) + 2 * state_after(x, True) for x in lines]
    codes = np.array(got[:400])
    for start in (0, 1):
        first, end = csv_records.begins(codes, start)
        state = start
        for x, f in zip(lines[:400], first):
            assert f == state
            state = int(state_after(x, bool(state)))
        assert end == state


def write(path, rows, end="\r\n", header=("id", "title")):
    out = io.StringIO()
    table = csv.writer(out, lineterminator=end)
    table.writerow(header)
    table.writerows(rows)
    path.write_text(out.getvalue(), newline="")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_csv_is_read_by_many_tasks(spark, tmp_path, end):
    rng = random.Random(7)
    def text():
        return "".join(rng.choice(['a', 'é ', '"', '""', ',', '\n', '\r\n', ' ', '\n\n"']) for _ in range(rng.choice([1, 5, 30, 90])))
    rows = [(f"W{i}", "x" + text() + "y") for i in range(120)]
    write(tmp_path / "a.csv", rows[:7], end)
    write(tmp_path / "b.csv", rows[7:115], end)
    write(tmp_path / "c.csv", [r[::-1] for r in rows[115:]], end, header=("title", "id"))
    want = sorted(rows)
    numbers = None
    for size in ("128m", "900", "97"):
        with split_size(spark, size):
            frame = readers.read_csv(spark, str(tmp_path), PLAIN)
            got = frame.collect()
            assert sorted((r["id"], r["title"]) for r in got) == want
            order = [r["id"] for r in sorted(got, key=lambda r: r["seq"])]
            assert order == [r[0] for r in rows] and [r["seq"] for r in sorted(got, key=lambda r: r["seq"])] == list(range(120))
            numbers = numbers or order
            if size == "97":
                assert frame.rdd.getNumPartitions() > 50


def test_quotes_that_open_nothing(spark, tmp_path):
    """Quotes within a plain field are characters, as inches are; the file still splits."""
    (tmp_path / "a.csv").write_text('id,title\n1,5" pipe\n2,"a ""b"", 6"\n3,7"\n4,"x\ny"\n\n5,\n')
    for size in ("128m", "9"):
        with split_size(spark, size):
            rows = readers.read_csv(spark, str(tmp_path / "a.csv"), PLAIN).orderBy("seq").collect()
            assert [(r["id"], r["title"]) for r in rows] == [
                ("1", '5" pipe'), ("2", 'a "b", 6'), ("3", '7"'), ("4", "x\ny"), ("5", None)]


def test_headers_with_breaks_dots_and_repeats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,"a.b","two\nlines",title,id\n1,x,y,T,late\n')
    (tmp_path / "b.csv").write_text("title,id\n")
    (tmp_path / "c.csv").write_text("")
    for size in ("128m", "7"):
        with split_size(spark, size):
            frame = readers.read_csv(spark, str(tmp_path), PLAIN, keep_extra=True)
            assert frame.columns == ["seq", "id", "title", "a.b", "two\nlines"]
            assert [tuple(r) for r in frame.collect()] == [(0, "1", "T", "x", "y")]


def test_map_rows_in_file_order(spark, tmp_path):
    """The last row wins, and the map has no numbers of its own."""
    from citeharbor.operators.references import with_references

    (tmp_path / "a.csv").write_text("openalex_work_id,icpsr_doi\nW1,first\n" + "".join(f"X{i},d\n" for i in range(500)))
    (tmp_path / "b.csv").write_text("openalex_work_id,icpsr_doi\n,none\nW1,last\n")
    cited = spark.createDataFrame([(0, '["W1"]')], "seq bigint, referenced_works string")
    for size in ("128m", "300"):
        with split_size(spark, size):
            table = readers.read_work_map(spark, str(tmp_path), "csv")
            assert with_references(cited, table).first()["ref_icpsr_dois"] == "last"
    frame = spark.createDataFrame([(None, "1", d, "t", "W1") for d in ("first", "last")], schemas.WORK_MAP)
    frame.coalesce(1).write.parquet(str(tmp_path / "p"))
    assert with_references(cited, readers.read_work_map(spark, str(tmp_path / "p"))).first()["ref_icpsr_dois"] == "last"
