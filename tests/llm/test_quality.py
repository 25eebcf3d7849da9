"""Quality counts against brute force; cutoffs by language and source."""

import re

from citeharbor.llm import quality
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def check(frame, rows):
    got = sorted(((r.doc_id, *[r[c] for c in COUNTS], r.base_failed) for r in frame.collect()), key=repr)
    want = []
    for i, text in rows:
        counts = plain(text)
        want.append((i, *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0]))
    assert got == sorted(want, key=repr)


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    result = QUERIES["op8_quality"](spark, sf_dir)
    check(result, rows)
    assert all(not r.kept for r in result.collect() if r.base_failed)


def test_edge_cases(docs):
    repeated = "a b c d e f g h " * 3 + "x"
    rows = edge_rows() + [(20, repeated), (21, "a b c d e f g h i"), (22, "a " * 9), (23, "x\nx\n x\nx"), (24, "é #ü*"),
                          (25, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(12))))]
    check(quality.quality(docs(rows)), rows)
    assert quality.quality(docs([])).collect() == []


def test_cutoffs_adapt_to_the_source(spark):
    def text(symbols, i):
        return " ".join(f"word{i}x{k}" + "#" * symbols for k in range(40))
    rows = [(i, text(0, i), "en", "plain") for i in range(300)] + [(1000 + i, text(1, i), "en", "code") for i in range(300)]
    rows += [(5000, text(1, 5000), "en", "plain"), (5001, text(2, 5001), "en", "code"), (5002, text(30, 5002), "en", "code"),
             (5003, text(30, 5003), None, None), (5004, text(0, 5004), "en", "new")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(frame).collect()}
    assert sum(kept[i] for i in range(300)) == 300 and sum(kept[1000 + i] for i in range(300)) == 300
    assert [kept[i] for i in range(5000, 5005)] == [False, False, False, False, True]


def test_lengths_of_words_are_bounded_on_both_sides(spark):
    def text(length, i):
        return " ".join(f"{k:02d}x{i}".ljust(length, "a")[:length] for k in range(40))
    letters = " ".join("abcdefghijklmnopqrstuvwxyzabcdefghijklmn")
    rows = [(i, text(5 + i % 2, i), "en", "plain") for i in range(300)]
    rows += [(5000, letters, "en", "plain"), (5001, text(40, 9), "en", "plain"), (5002, text(8, 9), "en", "plain"),
             (5003, letters, None, None)]
    rows += [(6000 + i, text(30, i), "de", "code") for i in range(300)] + [(7000, text(9, 9), "de", "code")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(frame).collect()}
    assert [kept[i] for i in (5000, 5001, 5002, 5003, 7000)] == [False, False, True, False, False]
    assert all(kept[i] for i in [*range(300), *range(6000, 6300)])


def test_cells_keep_ten_leading_bits(spark):
    frame = spark.createDataFrame([(0,), (5,), (1023,), (1024,), (1025,), (4099,), (10**12 + 7,)], "v long")
    cells = [r[0] for r in frame.select(quality.cell(frame["v"])).collect()]
    assert cells[:5] == [0, 5, 1023, 1024, 1024] and cells[5] == 4096
    assert 0 <= 10**12 + 7 - cells[6] <= (10**12) / 512


def test_whole_query_runs_no_python(spark, sf_dir):
    plan = QUERIES["op8_quality"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
