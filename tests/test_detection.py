import re

import pytest
from pyspark.sql import functions as F

from citeharbor.functions.detection import detect, document_signals, sentence_evidence
from citeharbor.functions.patterns import ARCHIVE, PatternSet, SignalRule, archive_patterns
from citeharbor.operators.detect import signal_table, with_detection
from citeharbor.plans import fixtures

from conftest import plan_text

NO = (False, None, None, None, None, None, None)

# seq % 24 -> (score, max, signal type, doi, study) for the rows 24..40, None for no hit.
CASES = {
    24: (9, 3, "doi_pattern", "10.3886/ICPSR01024.v1", "01024"),
    25: (6, 3, "doi_pattern", "10.3886/icpsr01025", "01025"),
    26: (3, 3, "study_pattern", None, "1026"),
    27: None,
    28: (3, 3, "study_pattern", None, "1028"),
    29: (3, 3, "study_pattern", None, "29"),
    30: (3, 3, "verb_context", None, None),
    31: (9, 3, "study_pattern", None, "1031"),
    32: None,
    33: (3, 1, "keyword_only", None, None),
    34: None,
    35: (3, 3, "study_pattern", None, "1035"),
    36: (15, 3, "doi_pattern", "10.3886/ICPSR2222.v2", "1036"),
    37: None,
    38: None,
    39: (6, 3, "study_pattern", None, "1002"),
    40: None,
}


def result(one, value, patterns=ARCHIVE):
    return tuple(one(lambda c: detect(c, patterns), value))


def test_injected_cases(spark, sf_dir):
    found = with_detection(
        fixtures.articles(spark, sf_dir).filter(F.col("seq").between(24, 40)))
    for row in found.collect():
        expected = CASES[row["seq"]]
        if expected is None:
            assert not row["has_icpsr"] and row["detection_score"] is None, row["seq"]
            continue
        assert row["has_icpsr"]
        assert (row["detection_score"], row["max_signal_score"], row["signal_type"],
                row["icpsr_doi"], row["icpsr_study_number"]) == expected, row["seq"]


@pytest.mark.parametrize("value", [None, "", "   ", "No archive here.", "ICPSR once."])
def test_no_hit(one, value):
    assert result(one, value) == NO


def test_study_number_after_abbreviation_is_cut_off(one):
    assert result(one, "Based on ICPSR Study No. 8079 data.") == NO
    assert result(one, "Based on ICPSR Study No 8079 data.")[2] == "8079"


def test_bare_number_length(one):
    assert result(one, "ICPSR 123 here, ICPSR 12 there.") == NO
    assert result(one, "See ICPSR 123456789.")[2] == "123456"


def test_unicode_digits_spaces_and_letters(one):
    assert result(one, "ICPSR # ١٢")[2] == "١٢"
    assert result(one, "data obtained\x1cfrom ICPSR")[5] == "verb_context"
    # Case folding reaches these letters, lower-casing does not.
    assert result(one, "ıcpſr 8079 was used")[2] == "8079"
    assert result(one, "ıcpsr. ıcpsr. ıcpsr.") == NO


def test_negative_sentence_is_dropped_whole(one):
    assert result(one, "Repositories such as ICPSR 8079, see 10.3886/ICPSR8079.") == NO
    hit = result(one, "Repositories like ICPSR exist. We used ICPSR 8079.")
    assert hit[2:4] == ("8079", 3)


def test_signal_order_and_snippet(spark):
    text = " Intro. data obtained from ICPSR 8079 and 10.3886/ICPSR1234.v5 ok.  ICPSR again."
    frame = spark.createDataFrame([(1, text)], "seq bigint, fulltext string")
    rows = [tuple(r) for r in signal_table(frame).collect()]
    snippet = "data obtained from ICPSR 8079 and 10.3886/ICPSR1234.v5 ok."
    assert rows == [
        (1, 1, 0, "doi_pattern", "10.3886/ICPSR1234.v5", None, 3, snippet),
        (1, 1, 1, "doi_pattern", "10.3886/ICPSR1234", None, 3, snippet),
        (1, 1, 2, "study_pattern", None, "8079", 3, snippet),
        (1, 1, 3, "study_pattern", None, "1234", 3, snippet),
        (1, 1, 4, "verb_context", None, None, 3, snippet),
        (1, 2, 5, "keyword_only", None, None, 1, "ICPSR again."),
    ]


def test_verb_pattern_counts_once_per_sentence(one):
    twice = "Data obtained from ICPSR and data obtained from ICPSR."
    assert len(one(sentence_evidence, twice)) == 1


def test_project_dois_on_request(one):
    value = "Files at 10.3886/E123456V1 today."
    assert result(one, value) == NO
    assert result(one, value, archive_patterns(with_project_dois=True))[1] == "10.3886/E123456"


def test_other_pattern_set(one):
    other = PatternSet(
        rules=(SignalRule("weak", (r"alpha",), 1), SignalRule("strong", (r"beta(\d)",), 5,
               fills="study_number", group=1)), threshold=2)
    assert result(one, "Alpha one. Beta7 two. alpha.", other) == (
        True, None, "7", 7, 5, "strong", "Beta7 two.")
    assert result(one, "alpha.", other) == NO


def test_gate_does_not_change_results(spark, sf_dir):
    open_set = PatternSet(ARCHIVE.rules, ARCHIVE.negatives, ARCHIVE.keyword)
    frame = fixtures.articles(spark, sf_dir)
    with_gate = frame.select("seq", document_signals("fulltext").alias("s"))
    without = frame.select("seq", document_signals("fulltext", open_set).alias("s"))
    assert with_gate.exceptAll(without).isEmpty()


def test_partitioning_does_not_matter(spark, sf_dir):
    frame = fixtures.articles(spark, sf_dir).select("seq", "fulltext")
    single = with_detection(frame.repartition(1)).drop("fulltext")
    many = with_detection(frame.repartition(16)).drop("fulltext")
    assert single.exceptAll(many).isEmpty() and many.exceptAll(single).isEmpty()


def test_score_invariants(spark, sf_dir):
    hits = with_detection(fixtures.articles(spark, sf_dir)).filter("has_icpsr")
    assert hits.filter("detection_score < 3 or detection_score < max_signal_score").isEmpty()
    assert hits.filter("signal_type is null or snippet is null").isEmpty()


def test_detection_plan_is_row_local_and_runs_once(spark, sf_dir):
    frame = fixtures.articles(spark, sf_dir).select("seq", "fulltext")
    plan = plan_text(with_detection(frame).filter("has_icpsr and detection_score > 3"))
    assert "Exchange" not in plan and "Python" not in plan
    for pattern in [p for r in ARCHIVE.rules for p in r.patterns]:
        body = pattern.replace(r"\s", r"[\s\x1c-\x1f]")
        assert len(re.findall(re.escape("(?iuU)" + body) + "[,)]", plan)) == 1, pattern


def test_detection_on_a_stream(spark, sf_dir, tmp_path):
    fixtures.articles(spark, sf_dir).select("seq", "fulltext").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq bigint, fulltext string").parquet(str(tmp_path / "in"))
    stream = with_detection(source).drop("fulltext").writeStream.format("memory").queryName(
        "streamed").trigger(availableNow=True).start()
    stream.awaitTermination()
    batch = with_detection(spark.read.parquet(str(tmp_path / "in"))).drop("fulltext")
    assert spark.table("streamed").exceptAll(batch).isEmpty()
    assert spark.table("streamed").count() == batch.count()
