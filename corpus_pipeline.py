"""From raw documents to token ids: five stages, each an operator of ``citeharbor.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but for
the last one. :func:`run` writes what each stage returns to the shared folder and reads it for the
next, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeharbor.llm import linededup, mixing, sentencepieces, simhash, toxicity
from citeharbor.llm.queries import label_domains
from citeharbor.llm.tables import table
from citeharbor.sources.stages import shared_folder

#: Shares of tokens by label. No document is dropped for them: the rarer domain is repeated.
WEIGHTS = {"good": 0.85, "poor": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the classifier learns from the labels table."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("__row"), "text")  # a column of docs may be called toxicity
    return toxicity.score(rows, model).filter("toxicity < 0.5").select("__row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier line of the table."""
    return linededup.remove_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (fingerprints of four-word shingles that chains of at most
    four differing bits link): the smallest doc_id."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that tokens of the domains come in the proportions of ``WEIGHTS``."""
    domains = label_domains(table(spark, sf_dir, "labels")).filter(F.col("domain").isin(*WEIGHTS))
    return mixing.repeated(docs, domains, WEIGHTS, keep_all=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = sentencepieces.round_trip(docs.select("doc_id", "text", "lang", "source"))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepieces.SPACE, " ")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix),
    ("SentencePiece", tokenize),
]
#: The classifiers and the tokenizer cannot be written in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
