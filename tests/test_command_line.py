import json

import pytest

from citeharbor.__main__ import main
from citeharbor.plans.jobs import Layout


def test_steps(spark, tmp_path, capsys):
    works = [
        {"id": "W1", "title": "Use", "doi": "https://doi.org/10.1/a", "publication_year": 2010,
         "primary_location": {"pdf_url": "http://p/1", "source": {"display_name": "J"}}},
        {"id": "W2", "title": "Cites", "doi": "https://doi.org/10.1/b",
         "referenced_works": ["W1"], "abstract_inverted_index": {"Nothing": [0]}},
    ]
    (tmp_path / "works.json").write_text(json.dumps(works))
    spark.createDataFrame(
        [(1, "http://p/1", "<p>We used ICPSR 8079.</p>")],
        "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    root = str(tmp_path / "run")
    with pytest.warns(UserWarning):
        main(["run", "--root", root, "--works", str(tmp_path / "works.json"), "--one-array",
              "--pages", str(tmp_path / "pages"), "--csv", "--with-text"])
    layout = Layout(root)
    assert {r["id"]: (r["has_icpsr"], r["fulltext"]) for r in
            spark.read.parquet(layout.detection).collect()} == {
        "W1": (True, "We used ICPSR 8079."), "W2": (False, "Nothing")}
    main(["summary", "--root", root, "--merge-numbers"])
    assert spark.read.parquet(layout.datasets).first()["icpsr_study_number"] == "8079"
    main(["map", "--root", root])
    main(["run", "--root", root])
    rows = {r["id"]: r["ref_icpsr_study_numbers"] for r in
            spark.read.parquet(layout.detection).collect()}
    assert rows == {"W1": "", "W2": "8079"}
    capsys.readouterr()
    main(["stats", "--root", root])
    printed = capsys.readouterr().out.splitlines()
    assert "collected.total_articles: 2" in printed and "related.research: 1" in printed


def test_rejected_records_are_stored_and_counted(spark, tmp_path, capsys):
    lines = [json.dumps({"id": f"W{i}", "doi": f"d{i}"}) for i in range(40)]
    lines[3], lines[30] = lines[3][:-1], "[]"
    (tmp_path / "works.json").write_text("\n".join(lines))
    root = str(tmp_path / "run")
    with pytest.warns(UserWarning):
        main(["run", "--root", root, "--works", str(tmp_path / "works.json")])
    layout = Layout(root)
    assert sorted(r["seq"] for r in spark.read.parquet(layout.rejected).collect()) == [3, 30]
    rows = {r["seq"]: r["id"] for r in spark.read.parquet(layout.articles).collect()}
    assert rows == {i: f"W{i}" for i in range(40) if i not in (3, 30)}
    capsys.readouterr()
    main(["stats", "--root", root])
    printed = capsys.readouterr().out.splitlines()
    assert "collected.total_articles: 38" in printed and "collected.rejected_records: 2" in printed


def test_summary_without_datasets(spark, tmp_path, capsys):
    layout = Layout(str(tmp_path / "run"))
    spark.createDataFrame(
        [(1, False, None, None, "t", "d", None)],
        "seq bigint, has_icpsr boolean, icpsr_study_number string, detection_score int, "
        "title string, doi string, snippet string").write.parquet(layout.detection)
    main(["summary", "--root", str(tmp_path / "run")])
    assert "nothing is written" in capsys.readouterr().out
    assert not (tmp_path / "run" / "detected_datasets").exists()


def test_run_from_flat_articles(spark, tmp_path):
    (tmp_path / "articles.csv").write_text(
        "id,title,doi,publication_year,abstract_text,fulltext_url,record_url,referenced_works\n"
        'W1,t,,2001.0,"ICPSR 8079,\nused",,,[]\nW2,u,,,,http://p,,[]\n')
    spark.createDataFrame([(1, "http://p", "<p>ICPSR 9000</p>")],
                          "page_id bigint, url string, html string",
                          ).write.parquet(str(tmp_path / "pages"))
    root = str(tmp_path / "run")
    with pytest.warns(UserWarning):
        main(["run", "--root", root, "--articles", str(tmp_path / "articles.csv"),
              "--pages", str(tmp_path / "pages")])
    rows = spark.read.parquet(Layout(root).detection).orderBy("seq").collect()
    assert [(r["id"], r["icpsr_study_number"], r["publication_year"]) for r in rows] == [
        ("W1", "8079", 2001), ("W2", "9000", None)]


def test_taking_over_a_stored_detection_table(spark, tmp_path, capsys):
    (tmp_path / "old.csv").write_text(
        "id,title,doi,fulltext,has_icpsr,icpsr_study_number,detection_score,snippet,"
        "referenced_works,icpsr_work_category\n"
        "W1,a,10.1/a,We used ICPSR 8079.,True,8079.0,9.0,s,[],research_article_using_icpsr\n"
        "W2,b,10.1/b,Nothing,False,,,,[],not_icpsr_related\n")
    root = str(tmp_path / "run")
    main(["import", "--root", root, "--detection", str(tmp_path / "old.csv")])
    main(["summary", "--root", root])
    row = spark.read.parquet(Layout(root).datasets).first()
    assert (row["icpsr_study_number"], row["study_norm"], row["max_detection_score"]) == (
        "8079.0", 8079, 9)
    with pytest.warns(UserWarning):  # detection runs again on the imported text
        main(["run", "--root", root])
    rows = {r["id"]: r["detection_score"] for r in
            spark.read.parquet(Layout(root).detection).collect()}
    assert rows == {"W1": 3, "W2": None}
