"""What a query reads in one task, shuffles and computes grows no faster than its input."""

from citeharbor.operators import textindex
from citeharbor.plans import catalog, fixtures
from conftest import plan_text

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 20}", None) for i, t in rows], DOCUMENTS)


def test_refresh_folder_is_written_by_as_many_tasks_as_read_it(spark, tmp_path, monkeypatch):
    texts = [(i, f"Text {i}. We used ICPSR {1000 + i} here.") for i in range(80)]
    documents(spark, texts).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    folders = iter([tmp_path / "folder", tmp_path / "stage"])
    monkeypatch.setattr(catalog, "_file_folder", lambda spark: str(next(folders)))
    rows = catalog.QUERIES["q_detection_refresh"](spark, str(tmp_path)).collect()
    assert sorted(r["seq"] for r in rows) == [i for i in range(80) if i % 5 != 2] and all(r["has_icpsr"] for r in rows)
    for name in ("part0", "part1", "part3", "part4"):
        assert len(list((tmp_path / "folder" / name).glob("*.parquet"))) > 1


def test_triples_are_not_looked_for_from_the_start_of_the_text(spark):
    texts = ["", "ab", "abc", "Élan ΣΑΡ", "a\U0001f600b\U0001f600", "x\ny z", None, "abcab" * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq long, title string")
    found = textindex.postings(frame)
    low = [(t or "").lower() for t in texts]
    want = {(t[i:i + 3], n) for n, t in enumerate(low) for i in range(len(t) - 2)}
    got = {(r["gram"], n) for r in found.collect() for n in r["rows"]}
    assert got == want
    assert "substring(" not in plan_text(found) and "substr(" not in plan_text(found)


def test_word_index_shuffles_each_text_once(spark):
    rows = [(1, "b a  b "), (2, ""), (3, None), (4, "x y"), (4, "x y"), (None, "n"), (5, "É " + "w é " * 500)]
    index = fixtures.word_index(documents(spark, rows), "doc_id", "text")
    got = {r["doc_id"]: {w: sorted(p) for w, p in r["word_index"].items()} for r in index.collect()}
    want = {}
    for i, t in rows:
        for place, word in enumerate([] if t is None else t.split(" ")):
            want.setdefault(i, {}).setdefault(word, []).append(place)
    assert got == {i: {w: sorted(p) for w, p in m.items()} for i, m in want.items()}
    plan = plan_text(fixtures.word_index(documents(spark, rows), "doc_id", "text"))
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_works_are_joined_before_their_maps_are_made(spark, tmp_path):
    documents(spark, [(i, f"w{i} w w{i}") for i in range(40)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "http://p/3", "<p>x</p>")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet"))
    flat = catalog.QUERIES["q_works_normalize"](spark, str(tmp_path))
    assert {r["seq"]: r["abstract_text"] for r in flat.collect()} == {
        i: None if i % 5 < 2 else f"w{i} w w{i}" for i in range(40)}
    plan = plan_text(catalog.QUERIES["q_works_normalize"](spark, str(tmp_path)))
    assert plan.count("map_from_entries(") == 1 and plan.index("map_from_entries(") < plan.index("Join")
    assert "Generate" not in plan
