"""Input that is given is processed; broken, reordered or partial input does no harm."""

import pytest
from pyspark.sql import functions as F

from citeharbor import schemas
from citeharbor.functions.nested import parse_references
from citeharbor.functions.text import decode_all
from citeharbor.operators import normalize, references
from citeharbor.operators.components import components
from citeharbor.operators.fulltext import attach_fulltext
from citeharbor.operators.pages import page_metadata
from citeharbor.operators.rows import with_row_id
from citeharbor.operators.views import dataset_ranking, prepare_articles
from citeharbor.plans import fixtures
from citeharbor.plans.jobs import Layout, run_detection
from citeharbor.sources import readers, stages

ARTICLES = ("seq bigint, id string, title string, doi string, host_venue string, abstract_text string, "
            "referenced_works string")


def articles(spark, *ids):
    return spark.createDataFrame([(i, f"W{i}", "t", None, None, f"We used ICPSR {8000 + i}.", "[]") for i in ids], ARTICLES)


def test_a_second_batch_replaces_stored_stages(spark, tmp_path):
    layout = Layout(str(tmp_path / "run"))
    with pytest.warns(UserWarning):
        assert run_detection(spark, layout, articles=articles(spark, 1)).count() == 1
        second = run_detection(spark, layout, articles=articles(spark, 1, 2))
    assert sorted(r["icpsr_study_number"] for r in second.collect()) == ["8001", "8002"]
    with pytest.warns(UserWarning):
        assert run_detection(spark, layout, articles=articles(spark, 5), reuse=True).count() == 2
        assert run_detection(spark, layout).count() == 2
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id bigint, url string, html string")
    with pytest.warns(UserWarning):
        assert run_detection(spark, layout, pages=pages).count() == 2


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "local-cluster[3,2,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_folder(Session())


@pytest.mark.parametrize("html", [
    '<a class="badge">x</a><![foo[bar]]>', "<![if", '<p id="description">' + "&#" + "9" * 5000 + ";", "<!DOCTYPE [<!x", "\x00<a class=badge"])
def test_a_bad_page_gives_a_row(spark, html):
    frame = spark.createDataFrame([(1, html), (2, '<a class="badge">ok</a>')], "page_id bigint, html string")
    rows = {r["icpsr_id"]: r for r in page_metadata(frame).collect()}
    assert set(rows) == {"1", "2"} and rows["2"]["subjects"] == "ok"


def test_encoded_class_names_reach_the_parser(spark):
    frame = spark.createDataFrame([(1, '<a class="b&#97;dge">x</a>')], "page_id bigint, html string")
    assert page_metadata(frame).first()["subjects"] == "x"


def test_a_reference_of_many_digits_is_left(spark):
    value = "a &#" + "9" * 5000 + "; &eacute;"
    frame = spark.createDataFrame([(value,)], "v string").select(decode_all("v", F.lit(True)).alias("r"))
    assert frame.first()["r"] == value.replace("&eacute;", "é")


@pytest.mark.parametrize("cell, want", [
    ('["a"] x', []), ('["a","b"] ; c', ['["a","b"]', "c"]), ("['a']", []), ("[1,true,2.50,null]", ["1", "True", "2.5", "None"]),
    ('["a;b"]', ["a;b"]), ('["it\'s", "b"]', ["it's", "b"]), ('["x]", "y"]', ["x]", "y"]), ("a;b ;", ["a", "b"]),
    ('{"x":"a;b"}', []), ("[]", []), (None, []), ("", []), ('[ ]', []), ('["true"]', ["true"]),
    ('["a"], x', []), ('["a"] ["b"]', []), ('[["a;b"],["c"]]', ['["a;b"]', '["c"]']), ('["' + "x" * 50_000 + '"]', ["x" * 50_000]),
    ("[" + '"w",' * 20_000 + '"z"]', ["w"] * 20_000 + ["z"])])
def test_reference_cells_are_strict_json(one, cell, want):
    assert one(parse_references, cell) == want


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title\none,A\n")
    (tmp_path / "b.csv").write_text("title,id,authors\nB,two,\"X\nY\"\n")
    (tmp_path / "c.csv").write_text("title,id,authors\nC,three,Z\n")
    rows = readers.read_articles_csv(spark, str(tmp_path)).orderBy("title").collect()
    assert [(r["id"], r["title"], r["authors"]) for r in rows] == [("one", "A", None), ("two", "B", "X\nY"), ("three", "C", "Z")]
    assert len({r["seq"] for r in rows}) == 3


def test_fulltext_without_pages_or_urls(spark):
    rows = articles(spark, 1)
    pages = spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string")
    for given in (None, pages):
        assert attach_fulltext(rows, given).first()["fulltext"] == "We used ICPSR 8001."


def test_united_requests_keep_numbers_apart(spark):
    first = spark.createDataFrame([(0, '["w1"]'), (3, "[]")], "seq bigint, referenced_works string")
    second = spark.createDataFrame([(0, '["w2"]')], "seq bigint, referenced_works string")
    empty = spark.createDataFrame([], "seq bigint, referenced_works string")
    union = normalize.union_results([first, empty, second])
    assert sorted((r["seq"], r["query_ord"], r["source_seq"]) for r in union.collect()) == [(0, 0, 0), (3, 0, 3), (4, 2, 0)]
    mapped = spark.createDataFrame([(1, "w1", "d", "1")], "seq bigint, openalex_work_id string, icpsr_doi string, icpsr_study_number string")
    found = references.with_references(union, mapped)
    assert [r["seq"] for r in found.filter("ref_has_icpsr").collect()] == [0]


def test_row_ids_keep_missing_and_repeated_numbers(spark):
    frame = spark.createDataFrame([(None,), (7,), (None,), (7,), (-3,), (1 << 40,)], "seq bigint")
    rows = with_row_id(frame).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(6))
    assert {r["row_id"] for r in rows if r["seq"] is None} == {0, 1}


def test_one_row_for_a_dataset_with_two_spellings(spark):
    works = prepare_articles(spark.createDataFrame(
        [(i, n, "research_article_using_icpsr", True) for i, n in enumerate(["01035", "1035", "1035", "2"])],
        "seq bigint, icpsr_study_number string, icpsr_work_category string, has_icpsr boolean"))
    datasets = spark.createDataFrame([("01035", 1, 3, 3.0), ("1035", 2, 9, 6.0), ("2", 1, 3, 3.0)],
                                     "icpsr_study_number string, n_articles bigint, max_detection_score int, mean_detection_score double")
    rows = dataset_ranking(datasets, works).collect()
    assert [(r["icpsr_study_number"], r["n_articles_using_dataset"], r["n_articles"], r["max_detection_score"],
             r["mean_detection_score"]) for r in rows] == [("01035", 3, 3, 9, 5.0), ("2", 1, 1, 3, 3.0)]


def test_components_of_named_nodes(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_query_data_reaches_the_rare_branches(spark, sf_dir):
    """Title cut, page fields: each occurs in what the registered queries read."""
    table = fixtures.articles(spark, sf_dir)
    assert table.filter(F.length("title") > 90).count() > 0
    rows = page_metadata(fixtures.study_pages(spark, sf_dir))
    found = rows.agg(*[F.count(c).alias(c) for c in ("creators", "subjects", "description", "doi")]).first()
    assert min(found) > 0 and set(schemas.STUDY_METADATA.names) == set(rows.columns)
