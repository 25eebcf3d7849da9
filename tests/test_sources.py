import json

import pytest
from pyspark.sql import functions as F

from citeharbor import schemas
from citeharbor.operators.classify import detected_subset
from citeharbor.plans import fixtures
from citeharbor.plans.jobs import (
    Layout, build_map, load_views, run_detection, summarize, write_stats)
from citeharbor.sources import readers, stages, writers

WORK = {
    "id": "W1", "title": "Tïtle", "doi": None, "publication_year": 2001,
    "referenced_works": ["W2"], "abstract_inverted_index": {"a": [0]},
    "open_access": {"is_oa": True, "oa_status": "gold", "oa_url": "u", "extra": 1},
    "ids": {"doi": "d"}, "primary_location": None}


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([WORK, {"id": "W2"}], indent=2))
    (tmp_path / "lines.json").write_text(json.dumps(WORK) + "\n" + json.dumps({"id": "W2"}))
    for name, one_array in (("array", True), ("lines", False)):
        rows = readers.read_works(spark, str(tmp_path / f"{name}.json"), one_array).orderBy(
            "seq").collect()
        assert [r["id"] for r in rows] == ["W1", "W2"]
        assert rows[0]["open_access"]["oa_url"] == "u" and rows[1]["ids"] is None
        assert rows[0]["abstract_inverted_index"] == {"a": [0]}


def test_json_sink_keeps_characters(spark, tmp_path):
    writers.write_json(spark.createDataFrame([("é", None)], "a string, b string"),
                       str(tmp_path / "out"))
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(written) == {"a": "é", "b": None} and "é" in written


def test_csv_round_trip_of_difficult_text(spark, tmp_path):
    rows = [(1, 'say "hi", ok', "line\nbreak\r\nmore"), (2, "x", None), (3, "  pad  ", "back\\slash"),
            (4, "tab\there", "quote\"end\\")]
    frame = spark.createDataFrame(rows, "seq bigint, title string, fulltext string")
    writers.write_csv(frame, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), frame.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_csv_has_no_empty_strings(spark, tmp_path):
    frame = spark.createDataFrame([(1, "")], "seq bigint, title string")
    writers.write_csv(frame, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), frame.schema).first()["title"] is None


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,extra,id,is_oa\nT,x,W1,True\n")
    row = readers.read_articles_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row["id"], row["title"], row["is_oa"], row["doi"]) == ("W1", "T", True, None)
    assert readers.read_detection_csv(
        spark, str(tmp_path / "a.csv")).columns == [*schemas.DETECTION.names, "extra"]


def test_csv_numbers_written_as_floats(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "seq,publication_year,detection_score,is_oa,icpsr_study_number,title\n"
        "1,2001.0,9.0,True,1024.0,a\n2,,,False,,b\nx,y,3,?,z,c\n")
    rows = readers.read_detection_csv(spark, str(tmp_path / "d.csv")).orderBy("title").collect()
    assert [(r["seq"], r["publication_year"], r["detection_score"], r["is_oa"],
             r["icpsr_study_number"]) for r in rows] == [
        (1, 2001, 9, True, "1024.0"), (2, None, None, False, None), (None, None, 3, None, "z")]


def test_missing_tables_degrade(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert readers.read_datasets(spark, str(tmp_path / "none")).isEmpty()
    with pytest.warns(UserWarning):
        assert readers.read_work_map(spark, str(tmp_path / "none"), "csv").isEmpty()


def test_map_drops_rows_without_work(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "icpsr_study_number,icpsr_doi,title,openalex_work_id\n1,d1,t,W1\n2,d2,t,\n")
    rows = readers.read_work_map(spark, str(tmp_path / "m.csv"), "csv").collect()
    assert [r["openalex_work_id"] for r in rows] == ["W1"]


def test_stage_is_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build(value):
        def run():
            calls.append(value)
            return spark.createDataFrame([(1, value)], "seq bigint, fulltext string")
        return run

    stages.load_or_build(spark, path, build(None))
    assert stages.load_or_build(spark, path, build("text")).first()["fulltext"] == "text"
    assert stages.load_or_build(spark, path, build("other")).first()["fulltext"] == "text"
    assert calls == [None, "text"]


def test_shared_folder_comes_from_the_session(spark):
    assert stages.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_spread_only_when_pieces_are_few(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(50)
    assert readers.spread(few, "id").rdd.getNumPartitions() == 8
    assert readers.spread(many, "id") is many


def test_schema_helpers(spark):
    frame = spark.createDataFrame([(1, "a")], "seq bigint, title string")
    with pytest.raises(ValueError, match="doi, id"):
        schemas.require_columns(frame, ["id", "doi", "seq"])
    assert schemas.require_columns(frame, ["seq"]) is frame
    assert schemas.with_optional(frame, schemas.ARTICLES).schema["is_oa"].dataType.typeName() == "boolean"
    assert schemas.pick_columns(frame, ["title", "x"]).columns == ["title"]
    assert schemas.pick_columns(frame, ["x"]).columns == ["seq", "title"]


def test_optional_stage_failure_is_a_warning(spark, tmp_path):
    def fail():
        raise RuntimeError("no clusters")
    with pytest.warns(UserWarning, match="no clusters"):
        assert not writers.write_optional(fail, str(tmp_path / "c"))
    empty = spark.createDataFrame([], "a string")
    assert not writers.write_if_any(empty, str(tmp_path / "e"))
    assert not (tmp_path / "e").exists()


def test_whole_run_and_feedback(spark, sf_dir, tmp_path):
    layout = Layout(str(tmp_path / "run"))
    text = fixtures.articles(spark, sf_dir).select("seq", "fulltext")
    works = fixtures.nested_works(spark, sf_dir).withColumn(
        "primary_location", F.struct(
            F.lit(None).cast("string").alias("landing_page_url"),
            F.concat(F.lit("http://page/"), "seq").alias("pdf_url"),
            F.col("primary_location.source").alias("source")))
    pages = text.select(
        F.col("seq").alias("page_id"), F.concat(F.lit("http://page/"), "seq").alias("url"),
        F.concat(F.lit("<p>"), F.regexp_replace("fulltext", "[&<>]", " "), F.lit("</p>"))
        .alias("html"))

    with pytest.warns(UserWarning):  # no map yet
        first = run_detection(spark, layout, works, pages, with_csv=True, with_text=True)
    assert set(schemas.DETECTION.names) == set(first.columns)
    assert first.filter("ref_has_icpsr").isEmpty() and not first.filter("has_icpsr").isEmpty()
    subset = spark.read.parquet(layout.detected)
    assert subset.count() == detected_subset(first).count()
    back = readers.read_detection_csv(spark, f"{layout.detection}_csv")
    assert back.count() == first.count()
    assert back.filter("has_icpsr").agg(F.sum("detection_score")).first() == first.filter(
        "has_icpsr").agg(F.sum("detection_score")).first()
    datasets = spark.read.parquet(layout.datasets)
    assert datasets.agg(F.sum("n_articles")).first()[0] == first.filter(
        "has_icpsr and icpsr_study_number is not null").count()
    assert spark.read.parquet(layout.clusters).count() == datasets.count()

    assert build_map(spark, layout).filter("openalex_work_id is not null").count() > 0
    # The second run starts from the stored text: it is given no works and no pages.
    rows = first.count()
    second = run_detection(spark, layout)
    assert second.count() == rows
    assert not second.filter("ref_has_icpsr").isEmpty()

    values = {r["metric"]: r["value"] for r in write_stats(spark, layout).collect()}
    assert values["rows"] == values["total_articles"] == rows
    assert values["research"] + values["data_docs"] + values["other"] == values["total"]
    assert "detection.rows: " in "".join(r[0] + "\n" for r in spark.read.text(layout.stats).collect())
    articles, views_datasets = load_views(spark, layout)
    assert "has_dataset_link" in articles.columns and "icpsr_link" in views_datasets.columns
    articles.unpersist(), views_datasets.unpersist()
    assert summarize(spark, layout, merge_numbers=True)
    third = run_detection(spark, layout, with_text=False)
    assert "fulltext" not in third.columns and third.count() == rows


def test_run_starts_from_stored_detection_text(spark, tmp_path):
    layout = Layout(str(tmp_path / "run"))
    spark.createDataFrame(
        [(1, "W1", "t", None, None, "We used ICPSR 8079.", "[]", True, "old")],
        "seq bigint, id string, title string, doi string, host_venue string, fulltext string, "
        "referenced_works string, has_icpsr boolean, snippet string",
    ).write.parquet(layout.detection)
    with pytest.warns(UserWarning):
        row = run_detection(spark, layout).first()
    assert (row["icpsr_study_number"], row["snippet"]) == ("8079", "We used ICPSR 8079.")


def test_unfinished_or_textless_stage_is_not_used(spark, tmp_path):
    path = tmp_path / "stage"
    frame = spark.createDataFrame([(1, "x"), (2, "")], "seq bigint, fulltext string")
    frame.write.parquet(str(path))
    assert stages.usable_stage(spark, str(path), "fulltext").count() == 2
    assert stages.usable_stage(spark, str(path), "absent") is None
    frame.filter("fulltext = ''").write.parquet(str(tmp_path / "blank"))
    assert stages.usable_stage(spark, str(tmp_path / "blank"), "fulltext") is None
    (path / "_SUCCESS").unlink()
    assert stages.usable_stage(spark, str(path), "fulltext") is None
