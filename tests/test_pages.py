from pyspark.sql import functions as F

from citeharbor.operators.fulltext import attach_fulltext, page_texts
from citeharbor.operators.pages import page_metadata, with_page_text

from conftest import plan_text

STUDY = """
<html><head><title>no</title><script>var h = "<h1>no</h1>";</script></head><body>
<!-- <h1>no</h1> -->
<h1> National <b>Survey</b> &amp; Panel </h1><h1>Second</h1>
<a class="btn badge" href="#">voting</a><a class="badge">  </a><a class='badge'>health</a>
<div class="subject-list other"><div><a>aging</a></div><a>voting</a></div><a>outside</a>
<span>Principal Investigator: <span>Ann <i>Lee</i></span></span>
<a>Co-Investigators</a>
<section id="abstract">Late</section>
<div class="x description">First <div>nested</div> part</div>
doi 10.3886/ICPSR08079.v1</body></html>
"""


def metadata(spark, *pages):
    frame = spark.createDataFrame(list(enumerate(pages, 1)), "page_id bigint, html string")
    return {int(r["icpsr_id"]): r.asDict() for r in page_metadata(frame).collect()}


def test_study_page(spark):
    row = metadata(spark, STUDY)[1]
    assert row["title"] == "NationalSurvey& Panel".replace("& ", "& ")
    assert row["subjects"] == "aging; health; voting"
    assert row["description"] == "First nested part"
    assert row["creators"] == "Co-Investigators; Principal Investigator: Ann Lee"
    assert row["doi"] == "10.3886/ICPSR08079.v1"
    assert row["icpsr_url"].endswith("/studies/1")


def test_description_order_and_absent_fields(spark):
    rows = metadata(
        spark,
        '<div class="abstract">a</div><section id="abstract">b</section>',
        '<p class="description">c</p><i id="study-description">d</i>',
        '<section id="description"></section><div class="abstract">e</div>',
        '<p>plain</p>', None, '<p id="description">no section</p>')
    assert [rows[i]["description"] for i in range(1, 7)] == ["b", "d", "", None, None, None]
    assert all(rows[4][c] is None for c in ("title", "creators", "subjects", "doi"))


def test_unclosed_markup(spark):
    row = metadata(spark, '<h1>Open<p><a class="badge">one<br>two</p><div class="subject-list">'
                          '<a>three</div><a>four')[1]
    assert row["title"] == "Openonetwothreefour"
    assert "onetwo" in row["subjects"] and "three" in row["subjects"]


def test_fulltext_priority(spark):
    pages = spark.createDataFrame(
        [(2, "u", "<p>second copy</p>"), (1, "u", "<p>page</p>"), (3, "r", "<p>record</p>"),
         (4, "empty", "<br>")], "page_id bigint, url string, html string")
    articles = spark.createDataFrame(
        [(1, "u", "r", "abs"), (2, "missing", "r", "abs"), (3, "empty", "r", "abs"),
         (4, None, None, "abs"), (5, "", None, " \t"), (6, "missing", None, None),
         (7, "u", "u", None)],
        "seq bigint, fulltext_url string, record_url string, abstract_text string")
    got = {r["seq"]: r["fulltext"] for r in attach_fulltext(articles, pages).collect()}
    assert got == {1: "page", 2: "record", 3: "record", 4: "abs", 5: "", 6: "", 7: "page"}


def test_fulltext_without_abstract_column(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string")
    articles = spark.createDataFrame([(1, "u"), (2, None)], "seq bigint, record_url string")
    got = {r["seq"]: r["fulltext"] for r in attach_fulltext(articles, pages).collect()}
    assert got == {1: "x", 2: ""}


def test_pages_are_parsed_once_and_after_the_choice(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id bigint, url string, html string",
                          ).write.parquet(str(tmp_path / "p"))
    articles = spark.createDataFrame([(1, "u")], "seq bigint, fulltext_url string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, -1)
    try:
        # What attach_fulltext stores before it joins the text.
        plan = plan_text(page_texts(spark.read.parquet(str(tmp_path / "p")), articles.select(
            F.col("seq").alias("page_id"))))
    finally:
        spark.conf.unset(limit)
    assert plan.count("ArrowEvalPython") == 1 and plan.count("<(script|style|noscript)") == 1
    # The markup is read in one branch only; the other scans see ids and URLs.
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert sum("html" in s for s in schemas) == 1


def test_very_long_markup(spark):
    frame = spark.range(1).select(F.lit(1).alias("page_id"), F.concat(
        F.lit("<div "), F.repeat(F.lit("a='1' b "), 200_000), F.lit(">body</div><p>&eacute;"),
        F.lit("<!--"), F.repeat(F.lit("x "), 1_000_000)).alias("html"))
    assert with_page_text(frame).first()["text"] == "body\né"


def test_many_unclosed_tags(spark):
    page = '<a class="badge">one</a>' + "<p>word " * 50_000 + "</q>" * 50_000
    assert metadata(spark, page)[1]["subjects"] == "one"
