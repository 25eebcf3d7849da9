"""Stored stages know what they were made of; only what changed is done again."""

import pytest
from pyspark.sql import functions as F

from citeharbor.plans.jobs import Layout, run_detection, take_works
from citeharbor.sources import refresh, stages


def write(spark, path, rows):
    spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("overwrite").parquet(str(path))


class Build:
    def __init__(self, factor=1):
        self.files, self.factor = [], factor

    def __call__(self, rows):
        self.files.append(sorted({f.rsplit("/", 2)[1] for f in rows.inputFiles()}))
        return rows.filter("v <> 'drop'").select("_source", (F.col("k") * self.factor).alias("k"), "v")


def test_only_changed_files_are_read(spark, tmp_path):
    folder, stage, build = tmp_path / "in +%é", str(tmp_path / "stage"), Build()
    for name in "abc":
        write(spark, folder / name, [(ord(name), name), (ord(name) + 1000, "drop")])

    def rows(b=build, version=""):
        return sorted(tuple(r) for r in refresh.refresh(spark, stage, str(folder), b, version).collect())

    assert rows() == [(97, "a"), (98, "b"), (99, "c")] and build.files == [["a", "b", "c"]]
    assert rows() == [(97, "a"), (98, "b"), (99, "c")] and len(build.files) == 1
    write(spark, folder / "b", [(5, "new"), (6, "new")])
    assert rows() == [(5, "new"), (6, "new"), (97, "a"), (99, "c")] and build.files[1:] == [["b"]]
    write(spark, folder / "b", [(7, "drop")])
    write(spark, folder / "d", [(8, "d")])
    assert rows() == [(8, "d"), (97, "a"), (99, "c")] and build.files[2:] == [["b", "d"]]
    stages.remove(spark, str(folder / "a"))
    assert rows() == [(8, "d"), (99, "c")]
    other = Build(2)
    assert rows(other, "double") == [(16, "d"), (198, "c")] and other.files == [["b", "c", "d"]]
    assert refresh.tidy(spark, stage) and rows(other, "double") == [(16, "d"), (198, "c")] and len(other.files) == 1


def test_a_broken_refresh_is_no_refresh(spark, tmp_path):
    folder, stage = tmp_path / "in", str(tmp_path / "stage")
    write(spark, folder / "a", [(1, "a")])
    refresh.refresh(spark, stage, str(folder), Build())
    write(spark, folder / "b", [(2, "b")])

    def fails(rows):
        return rows.select("_source", F.raise_error(F.lit("lost")).cast("long").alias("k"), "v")

    with pytest.raises(Exception, match="lost"):
        refresh.refresh(spark, stage, str(folder), fails)
    build = Build()
    assert refresh.refresh(spark, stage, str(folder), build).count() == 2 and build.files == [["b"]]


def test_many_generations_are_written_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "MOST_GENERATIONS", 2)
    folder, stage, build = tmp_path / "in", str(tmp_path / "stage"), Build()
    for k in range(5):
        write(spark, folder / f"f{k}", [(k, "x")])
        assert refresh.refresh(spark, stage, str(folder), build).count() == k + 1
    assert build.files == [[f"f{k}"] for k in range(5)]
    assert sorted(r["k"] for r in refresh.refresh(spark, stage, str(folder), build).collect()) == list(range(5))


def test_changed_input_is_never_served_old_rows(spark, tmp_path):
    source, path, calls = tmp_path / "in", str(tmp_path / "stage"), []

    def stage(version="1"):
        table = spark.read.parquet(str(source))
        return stages.load_or_build(spark, path, lambda: (calls.append(version), table)[1], required="v", rebuild=True,
                                    inputs=[table], version=version).collect()

    write(spark, source, [(1, "a")])
    assert [r["k"] for r in stage()] == [r["k"] for r in stage()] == [1] and calls == ["1"]
    write(spark, source, [(2, "a")])
    assert [r["k"] for r in stage()] == [2] and [r["k"] for r in stage("2")] == [2] and calls == ["1", "1", "2"]
    memory = spark.createDataFrame([(3, "m")], "k long, v string")
    for _ in range(2):  # nothing tells whether rows in memory have changed
        assert stages.load_or_build(spark, path, lambda: memory, required="v", rebuild=True, inputs=[memory]).first()["k"] == 3
    assert [r["k"] for r in stage("2")] == [2]


def test_a_run_over_the_same_files_reads_nothing_again(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"id":"W1","abstract_inverted_index":{"ICPSR":[0],"8079":[1]}}\n{bad\n')
    layout = Layout(str(tmp_path / "run"))

    def run():
        works = take_works(spark, layout, str(tmp_path / "w.json"))
        with pytest.warns(UserWarning):
            found = sorted((r["seq"], r["icpsr_study_number"]) for r in run_detection(spark, layout, works).collect())
        return found, [sorted(spark.read.parquet(p).inputFiles()) for p in (layout.articles, layout.texts)]

    first, again = run(), run()
    assert first == again and first[0] == [(0, "8079")]
    (tmp_path / "w.json").write_text('{bad\n{"id":"W2","abstract_inverted_index":{"ICPSR":[0],"8080":[1]}}\n')
    assert run()[0] == [(1, "8080")]
