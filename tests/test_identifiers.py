import pytest
from pyspark.sql import functions as F

from citeharbor.functions import identifiers, labels, nested


@pytest.mark.parametrize("value, expected", [
    (None, None), ("", ""), ("10.1/x", "10.1/x"),
    ("https://doi.org/10.1/X", "10.1/X"), ("http://doi.org/10.1/x", "10.1/x"),
    (" HTTPS://DX.DOI.ORG/10.1/aB ", "10.1/aB"), ("http://dx.doi.org/10.1/x", "10.1/x"),
    ("https://example.org/10.1/x", "https://example.org/10.1/x")])
def test_clean_doi(one, value, expected):
    assert one(identifiers.clean_doi, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("x doi:10.3886/icpsr08079.v1, y", "10.3886/icpsr08079.v1"),
    ("10.12/short then 10.1234/AbC-(1);2", "10.1234/AbC-(1);2"),
    ("none", None), (None, None)])
def test_find_doi(one, value, expected):
    assert one(identifiers.find_doi, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("08079", 8079), ("8079", 8079), ("8079.0", 8079), (" 8079 ", 8079), ("8079.5", None),
    ("1e3", 1000), ("12d", None), ("abc", None), ("", None), (None, None), ("NaN", None),
    ("9007199254740993", 9007199254740993), ("99999999999999999999", None)])
def test_study_key(one, value, expected):
    assert one(identifiers.study_key, value) == expected


def test_links(one):
    assert one(identifiers.study_link, "08079").endswith("/studies/8079")
    assert one(identifiers.study_link, None) == ""
    assert one(identifiers.doi_link, " 10.1/x ") == "https://doi.org/10.1/x"
    assert one(identifiers.doi_link, "http://a/b") == "http://a/b"
    assert one(identifiers.doi_link, "  ") == "" and one(identifiers.doi_link, None) == ""


CATEGORIES = [
    # text, reference, doi, venue -> default, strict prefix, documents first
    (False, False, "10.3886/icpsr1", None, "not_icpsr_related", "not_icpsr_related",
     "icpsr_data_doc"),
    (True, None, "10.3886/ICPSR1", None, "icpsr_data_doc", "icpsr_data_doc", "icpsr_data_doc"),
    (True, False, "https://doi.org/10.3886/E12", None, "icpsr_data_doc",
     "research_article_using_icpsr", "icpsr_data_doc"),
    (False, True, "10.1/x", "OpenICPSR", "icpsr_data_doc", "icpsr_data_doc", "icpsr_data_doc"),
    (None, True, None, None, "research_article_using_icpsr", "research_article_using_icpsr",
     "research_article_using_icpsr"),
    (None, None, None, "Journal", "not_icpsr_related", "not_icpsr_related",
     "not_icpsr_related"),
]


def test_work_category(spark):
    frame = spark.createDataFrame(
        [c[:4] for c in CATEGORIES], "t boolean, r boolean, doi string, venue string")
    rows = frame.select(
        identifiers.work_category("t", "r", "doi", "venue"),
        identifiers.work_category("t", "r", "doi", "venue", strict_prefix=True),
        identifiers.work_category("t", "r", "doi", "venue", docs_first=True)).collect()
    assert [tuple(r) for r in rows] == [c[4:] for c in CATEGORIES]


@pytest.mark.parametrize("cell, expected", [
    (None, []), ("", []), ("null", []), ("lone", []), ('{"x":"a;b"}', []), ('"a;b"', []),
    ('["a","b"]', ["a", "b"]), (' ["a"] ', ["a"]), ('["a",null]', ["a", "None"]), ("[]", []),
    ("a;b ;", ["a", "b"]), (" ; ", []), ("[a;b", ["[a", "b"]), ("[1, 2]", ["1", "2"])])
def test_parse_references(one, cell, expected):
    assert one(nested.parse_references, cell) == expected


def test_paths(one):
    document = '{"a":{"b":"c"},"n":null}'
    assert one(lambda c: nested.json_path(c, "a", "b"), document) == "c"
    assert one(lambda c: nested.json_path(c, "a", "x", default="d"), document) == "d"
    assert one(lambda c: nested.json_path(c, "a"), "not json") is None
    maps = {"a": {"b": "c"}}
    kind = "map<string,map<string,string>>"
    assert one(lambda c: nested.map_path(c, "a", "b"), maps, kind) == "c"
    assert one(lambda c: nested.map_path(c, "x", "b", default="d"), maps, kind) == "d"


def test_labels(one):
    assert one(lambda c: labels.shorten(c, 3), "abcd") == "abc…"
    assert one(lambda c: labels.shorten(c, 4), "abcd") == "abcd"
    assert one(lambda c: labels.shorten(c, 4), None) == ""
    assert one(lambda c: labels.row_label(F.lit(2), c, 3), "title") == "[2] tit…"
    assert one(lambda c: labels.dataset_label(F.lit(7), c, F.lit(3)), "T") == "7 · T (n=3)"
    assert one(lambda c: labels.year_range(c, F.lit(2004)), 1999, "int") == "1999–2004"
    assert one(lambda c: labels.year_range(c, F.lit(2004)), None, "int") == "n/a"
