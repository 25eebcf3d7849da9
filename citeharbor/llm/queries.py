"""Registered queries of this subpackage: each operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeharbor.llm import (
    ann, linededup, mixing, packing, periods, pii, prefixtrie, quality, rans, sentencepieces, simhash, substrings,
    toxicity)
from citeharbor.llm.oracle import ORACLE as ORACLE
from citeharbor.llm.tables import table
from citeharbor.sources.stages import cut

QUERIES = {}

END_ID = 1
#: Shares of tokens by domain; a domain is a pair of labels.
DOMAIN_WEIGHTS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_personal_data(spark, sf_dir):
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@query
def op3_line_dedup(spark, sf_dir):
    return linededup.judged(table(spark, sf_dir, "documents"))


@query
def op4_sentencepiece(spark, sf_dir):
    back = sentencepieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepieces.SPACE, " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def label_domains(labels):
    """``doc_id, domain`` of labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(
        F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query
def op5_mixing(spark, sf_dir):
    done = mixing.judged(table(spark, sf_dir, "documents"),
                         label_domains(table(spark, sf_dir, "labels")), DOMAIN_WEIGHTS)
    return done.select("doc_id", "n_tokens", *[
        F.coalesce(F.col("posterior")[d], F.lit(0.0)).alias(f"p_{d}") for d in DOMAIN_WEIGHTS], "rate", "copies")


@query
def op6_token_files(spark, sf_dir):
    folder = rans.write_texts(table(spark, sf_dir, "documents"), END_ID)
    return rans.read(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


@query
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark, sf_dir):
    done = substrings.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op11_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_periodic_runs(spark, sf_dir):
    docs = periods.with_planted_runs(table(spark, sf_dir, "documents"))
    return periods.digest(periods.periodic_runs(docs))


@query
def op13_prefix_trie(spark, sf_dir):
    convs = cut(prefixtrie.sequences(table(spark, sf_dir, "conversations")))
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(convs))
