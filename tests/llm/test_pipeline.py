"""The whole pipeline against a brute-force version of its stages on the same input."""

import pytest
import sentencepiece

import corpus_pipeline
from citeharbor.llm import mixing, sentencepieces, toxicity
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_simhash import expected as plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returned, stage by stage, with the input first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [[tuple(r) for r in docs.select(*COLUMNS).collect()]]
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir)
        if stage is not corpus_pipeline.tokenize:
            assert sorted(result.columns) == sorted(COLUMNS), name
            rows = [tuple(r) for r in result.select(*COLUMNS).collect()]
            docs = spark.createDataFrame(rows, docs.select(*COLUMNS).schema)
            out.append(rows)
        else:
            out.append(result.collect())
    return out


def test_stages_are_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_lines", "near_dedup", "mix", "tokenize"]


def test_toxic_documents_go_and_no_others(spark, sf_dir, stages):
    before, after = ({r[0]: r for r in rows} for rows in stages[:2])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert set(after) == {i for i in before if not judged[i]} and all(after[i] == before[i] for i in after)
    clean = {r.doc_id for r in labels.collect() if not r.toxic}
    assert len(clean & set(after)) > 0.95 * len(clean)


def test_lines(stages):
    gone = {i: set(lines) for i, _, lines in plain_lines([r[:2] for r in stages[1]])}
    assert any(gone.values())
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t, *_ in stages[1]}
    assert {r[0]: r[1] for r in stages[2]} == want
    assert all(r[4] == len(r[1]) for r in stages[2])


def test_one_of_each_group_stays(stages):
    keep = {i for i, _, c in plain_groups([r[:2] for r in stages[2]]) if i == c}
    assert {r[0] for r in stages[3]} == keep and len(keep) < len(stages[2])


def test_mixing_keeps_every_document_and_meets_the_weights(spark, sf_dir, stages):
    before = {r for r in stages[3]}
    assert set(stages[4]) == before and len(stages[4]) >= len(before)
    docs = spark.createDataFrame(stages[3], "doc_id long, text string, lang string, source string, n_chars long")
    labels = corpus_pipeline.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("domain <> 'toxic'")
    rated = mixing.judged(docs, labels, corpus_pipeline.WEIGHTS, keep_all=True).collect()
    assert {(r.doc_id, r.copies) for r in rated} == {
        (r[0], sum(x[0] == r[0] for x in stages[4])) for r in stages[3]}
    tokens = {d: sum(r.posterior[d] * r.n_tokens * r.rate for r in rated) for d in corpus_pipeline.WEIGHTS}
    assert abs(tokens["good"] / sum(tokens.values()) - corpus_pipeline.WEIGHTS["good"]) < 0.03


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    assert sorted((r.doc_id, r.ids) for r in stages[5]) == sorted((r[0], library.encode(r[1])) for r in stages[4])
    assert all(r.round_trip for r in stages[5])


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted((r.doc_id, r.ids) for r in stages[5])


def test_stages_keep_columns_with_odd_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "doc_id AS `a.b`", "text AS `c-d`", "lang AS toxicity", "source AS gone", "lang AS copies", "doc_id AS `__id x`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, sf_dir)
        assert found.columns == odd.columns, name
        rows = found.selectExpr("doc_id = `a.b` AND lang = toxicity AND source = gone AND lang = copies AS same").distinct().collect()
        assert [r["same"] for r in rows] == [True], name


def test_mixing_scans_each_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = corpus_pipeline.mix(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("[A-Z]{4}|!!") <= 2
