import html
import random
import re

import pytest
from pyspark.sql import functions as F

from citeharbor.functions import text
from citeharbor.functions.core import WHITESPACE, strip
from citeharbor.operators.pages import with_page_text


def test_whitespace_is_every_space_character():
    assert sorted(WHITESPACE) == [chr(c) for c in range(0x3001) if chr(c).isspace()]


@pytest.mark.parametrize("value, expected", [
    (None, None), ("", ""), ("  a \t b\n\nc  ", "a b c"), (" x y\x1c", "x y")])
def test_norm_text(one, value, expected):
    assert one(text.norm_text, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("", [""]),
    ("One. Two!  Three?\nFour", ["One.", "Two!", "Three?", "Four"]),
    ("Study No. 5 e.g.this", ["Study No.", "5 e.g.this"]),
    ("  padded.  ", ["padded."]),
    ("a. b.\x1fc", ["a.", "b.", "c"]),
])
def test_sentences(one, value, expected):
    assert one(text.sentences, value) == expected


def test_sentences_match_a_plain_split(spark, one):
    rng = random.Random(3)
    for _ in range(20):
        value = "".join(rng.choice("ab.!? \n\t \x1d") for _ in range(60))
        spaces = "[" + re.escape(WHITESPACE) + "]"
        expected = re.split(f"(?<=[.!?]){spaces}+", value.strip(WHITESPACE))
        assert one(text.sentences, value) == expected


@pytest.mark.parametrize("index, expected", [
    (None, None), ({}, None),
    ({"Despite": [0], "the": [1, 3], "x": [2]}, "Despite the x the"),
    ({"late": [9], "early": [2]}, "early late"),
    ({"a": [-1, 0], "b": [-3]}, "a"),
    ({"a": [0], "": [1], "b": [2]}, "a b"),
    ({"first": [0, 1], "second": [1]}, "first second"),
    ({"only": [-1]}, ""),
    ({"none": [], "a": [0]}, "a"),
])
def test_inverted_index(one, index, expected):
    assert one(text.decode_inverted_index, index, "map<string,array<int>>") == expected


def page_text(spark, page):
    frame = spark.createDataFrame([(1, page)], "page_id int, html string")
    return with_page_text(frame).first()["text"]


@pytest.mark.parametrize("page, expected", [
    (None, None), ("", None), ("<p> </p>", None),
    ("<p>One</p><p>Two <b>three</b></p>", "One\nTwo\nthree"),
    ("<style>p{}</style><script>var t='</p>';</script>x<noscript>y</noscript>z", "x\nz"),
    ("<!-- <p>no</p> -->yes", "yes"),
    ("<!-- <script> -->kept", "kept"),
    ("<a title=\"a > b\">link</a> 1 < 2", "link\n1 < 2"),
    ("<a title=it's>one</a> don't", "one\ndon't"),
    ("A&amp;B &copy; &lt;p&gt; &amp;lt;", "A&B © <p> &lt;"),
    ("caf&eacute; &#8364; &#x41; &unknown; &amp", "café € A &unknown; &"),
    ("<p>&nbsp;edge&nbsp;</p>", "edge"),
])
def test_page_text(spark, page, expected):
    assert page_text(spark, page) == expected


def test_common_entities_agree_with_the_standard_table(one):
    for name, char in text.COMMON_ENTITIES:
        assert html.unescape(name) == char
        assert one(text.decode_common, f"x{name}y") == f"x{char}y"


def test_only_rare_references_reach_python(spark):
    frame = spark.createDataFrame([("a &amp; b",), ("&eacute;",), (None,)], "v string")
    flags = [r[0] for r in frame.select(text.has_rare_entity("v")).collect()]
    assert flags == [False, True, None]


def test_strip_is_linear_on_long_runs(spark):
    frame = spark.range(1).select(F.repeat(F.lit("  "), 300_000).alias("v"))
    assert frame.select(strip(F.concat("v", F.lit("x"), "v")).alias("r")).first()["r"] == "x"
