"""Optional grouping of datasets by the text of their summary rows.

Datasets with one text form a text group; groups are linked if the cosine similarity of their tf-idf
vectors reaches a threshold, and clusters are made of these links.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeharbor.operators.components import components
from citeharbor.sources.stages import cut

LIST_ROWS = 1024  # texts of a term from which its list is dealt out in blocks
LEVELS = 8  # of what a text can still add behind a term; blocks meet only if both together suffice


def summary_text(datasets: DataFrame) -> DataFrame:
    """``text``: title and snippet of each summary row."""
    return datasets.withColumn("text", F.concat_ws(" ", "title", "snippet"))


def cluster_datasets(datasets: DataFrame, threshold: float = 0.5, linkage: str = "single") -> DataFrame:
    """Summary rows with ``cluster``, named after its smallest dataset number.

    With ``single`` linkage datasets belong together if similar texts link them, directly or through
    others; with ``complete`` linkage all texts of a cluster are similar to each other. Every link is
    an exact cosine similarity of ``threshold`` or more, so the result does not depend on
    partitioning or order.
    """
    return clusters_and_matrix(datasets, threshold, linkage)[0]


def clusters_and_matrix(datasets: DataFrame, threshold: float = 0.5,
                        linkage: str = "single") -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`cluster_datasets` and the matrix they were made from.

    The matrix is in long form (``study_a, study_b, similarity``), symmetric with its diagonal, over
    text groups (see :func:`text_groups`); what is below ``threshold`` is left out.
    """
    if linkage not in ("single", "complete"):
        raise ValueError(f"linkage is single or complete, not {linkage}")
    leaders = text_leaders(datasets)
    links = cut(similar_groups(datasets, threshold))
    if linkage == "single":
        roots = components(links.select(F.col("study_a").alias("a"), F.col("study_b").alias("b")))
    else:
        roots = complete_clusters(links)
    named = leaders.select("text", F.col("group_study").alias("node")).join(roots, "node", "left").select(
        "text", F.coalesce("root", "node").alias("cluster"))
    rows = summary_text(datasets).join(named, "text").select(*datasets.columns, "cluster")
    turned = links.select(F.col("study_b").alias("study_a"), F.col("study_a").alias("study_b"), "similarity")
    own = leaders.select(F.col("group_study").alias("study_a"), F.col("group_study").alias("study_b"),
                         F.lit(1.0).alias("similarity"))
    return rows, links.select("study_a", "study_b", "similarity").unionByName(turned).unionByName(own)


def complete_clusters(links: DataFrame) -> DataFrame:
    """``node, root`` of the nodes that are merged: complete-linkage clusters of weighted links.

    ``links`` (``study_a, study_b, similarity``) has each pair once; a pair without a row is too far
    apart. The similarity of two clusters is that of their most distant pair. In each round every
    cluster picks its most similar one (ties: the pair of smaller names) and those that pick each
    other merge, which leads to the clusters that merging one best pair at a time gives. Of the links
    of merged clusters only those stay that all their parts have, so links only become fewer and the
    rounds end when none is left. All is grouping and equi-joins; no component is gathered anywhere.
    """
    edges = cut(links.select(F.least("study_a", "study_b").alias("a"), F.greatest("study_a", "study_b").alias("b"),
                             F.col("similarity").alias("s")))
    named = None
    while not edges.isEmpty():
        # The smallest struct is the best link: highest similarity, then smaller names.
        link = F.struct((-F.col("s")).alias("far"), "a", "b")
        ends = edges.select(F.col("a").alias("node"), link.alias("link")).unionByName(
            edges.select(F.col("b").alias("node"), link.alias("link")))
        best = ends.groupBy("node").agg(F.min("link").alias("link"))
        merged = cut(best.groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(
            F.col("link.a").alias("root"), F.col("link.b").alias("gone")))
        # A cluster is named after its smallest node, which `a` is: links are ordered by name.
        moved = merged.select(F.col("gone").alias("was"), F.col("root").alias("now"))
        if named is None:
            named = moved.select(F.col("was").alias("node"), F.col("now").alias("root"))
        else:
            onward = moved.withColumnsRenamed({"was": "root"})
            named = named.join(onward, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
            named = named.unionByName(moved.select(F.col("was").alias("node"), F.col("now").alias("root")))
        named = cut(named)
        parts = merged.select(F.col("root").alias("part"), F.lit(2).alias("parts"), F.col("root").alias("to")).unionByName(
            merged.select(F.col("gone").alias("part"), F.lit(2).alias("parts"), F.col("root").alias("to")))
        for end in ("a", "b"):
            side = parts.withColumnsRenamed({"part": end, "parts": f"n_{end}", "to": f"to_{end}"})
            edges = edges.join(side, end, "left").withColumns(
                {f"n_{end}": F.coalesce(f"n_{end}", F.lit(1)), f"to_{end}": F.coalesce(f"to_{end}", end)})
        low, high = F.least("to_a", "to_b"), F.greatest("to_a", "to_b")
        edges = cut(edges.filter("to_a != to_b").groupBy(low.alias("a"), high.alias("b")).agg(
            F.min("s").alias("s"), F.count(F.lit(1)).alias("n"), F.first(F.col("n_a") * F.col("n_b")).alias("whole")
        ).filter("n = whole").select("a", "b", "s"))
    if named is None:
        return links.select(F.col("study_a").alias("node"), F.col("study_a").alias("root"))
    return named.unionByName(named.select(F.col("root").alias("node"), "root").distinct())


def text_leaders(datasets: DataFrame) -> DataFrame:
    """``text, group_study, n_datasets``: one row per distinct text.

    A group is named after its smallest dataset number, so exact copies are
    compared once and never against each other.
    """
    return summary_text(datasets).groupBy("text").agg(
        F.min("icpsr_study_number").alias("group_study"), F.count("*").alias("n_datasets"))


def text_groups(datasets: DataFrame) -> DataFrame:
    """``icpsr_study_number, group_study, n_datasets``: the members of each text group."""
    return summary_text(datasets).join(text_leaders(datasets), "text").select(
        "icpsr_study_number", "group_study", "n_datasets")


def term_weights(texts: DataFrame, key: str) -> DataFrame:
    """``key, term, weight``: unit-length tf-idf vectors in long form.

    idf is ``ln((n + 1) / (df + 1)) + 1``, so no weight is zero.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = (texts.select(key, F.explode(words).alias("term"))
              .groupBy(key, "term").agg(F.count("*").alias("tf")))
    n_texts = texts.agg(F.count("*").alias("n")).scalar()
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((n_texts + 1) / (F.col("df") + 1)) + 1
    raw = counts.join(frequency, "term").select(
        key, "term", "df", (F.col("tf") * idf).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "df", (F.col("raw") / norm).alias("weight"))


def dealt(prefix: DataFrame, threshold: float, list_rows: int = LIST_ROWS) -> DataFrame:
    """Rows of the lists of ``term``, once for each pair of blocks (``low``, ``high``) they take part in.

    A list of up to ``list_rows`` rows is one block. A longer one is split by how much a text can
    still add, its length from the term onwards, and these levels by hash into blocks. Two rows of
    the list can belong to a pair only if the product of these lengths reaches ``threshold``, so
    blocks of levels that cannot do so never meet. Nothing is dropped but such pairs.
    """
    rest = F.sqrt(F.col("weight") * F.col("weight") + F.col("rest"))
    share = F.log(F.greatest(rest, F.lit(1e-300))) / math.log(threshold) if 0.01 < threshold < 1 else F.lit(0.0)
    level = F.greatest(F.floor(share * LEVELS - 1e-4), F.lit(0)).cast("long")
    rows = prefix.withColumn("level", level)
    sizes = rows.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(
        F.sum("n").alias("whole"), F.collect_list(F.struct("level", F.ceil(F.col("n") / list_rows).alias("n"))).alias("levels")
    ).filter(F.col("whole") > list_rows).select("term", F.filter("levels", lambda x: x["level"] <= LEVELS).alias("levels"))
    sized = rows.join(sizes, "term", "left")
    own_blocks = F.filter("levels", lambda x: x["level"] == F.col("level"))[0]["n"]
    at = F.col("level") * (1 << 40) + F.pmod(F.xxhash64("group_study"), own_blocks)
    others = F.flatten(F.transform(
        F.filter("levels", lambda x: x["level"] + F.col("level") <= LEVELS),
        lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda k: x["level"] * (1 << 40) + k)))
    blocks = F.when(F.col("levels").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)
    spread = sized.withColumn("own", F.when(F.col("levels").isNull(), F.lit(0).cast("long")).otherwise(at))
    return spread.withColumn("other", F.explode(blocks)).select(
        *prefix.columns, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def similar_groups(datasets: DataFrame, threshold: float = 0.5,
                   digits: int = 6, list_rows: int = LIST_ROWS) -> DataFrame:
    """Pairs of text groups whose cosine similarity reaches ``threshold``.

    Exact, by prefix filtering: with terms ordered from rare to common, the part
    of a unit vector after the point where its remaining length drops below the
    threshold cannot reach the threshold alone. Two similar texts therefore
    share a term within their (rare) prefixes. A pair survives the join on its
    first shared term only if that term and the lengths of what follows it can
    still add up to the threshold; only such pairs are scored. The list of a
    common term is dealt out in blocks (:func:`dealt`).
    """
    weights = cut(term_weights(text_leaders(datasets), "group_study"))
    after = (Window.partitionBy("group_study").orderBy("df", "term")
             .rowsBetween(1, Window.unboundedFollowing))
    square = F.col("weight") * F.col("weight")
    rest = F.coalesce(F.sum(square).over(after), F.lit(0.0))
    slack = 1e-6
    prefix = (weights.withColumn("rest", rest)
              .filter(F.col("rest") + square >= threshold * threshold - slack)
              .select("group_study", "term", "weight", "rest"))
    rows = cut(dealt(prefix, threshold, list_rows))
    place = ["term", "low", "high"]
    a = rows.select(F.col("group_study").alias("study_a"), *place, F.col("own").alias("own_a"),
                    F.col("weight").alias("wa"), F.sqrt("rest").alias("ra"))
    b = rows.select(F.col("group_study").alias("study_b"), *place, F.col("own").alias("own_b"),
                    F.col("weight").alias("wb"), F.sqrt("rest").alias("rb"))
    # Rows of one block meet where the block meets itself, and nowhere else.
    once = (F.col("own_a") != F.col("own_b")) | (F.col("low") == F.col("high"))
    candidates = a.join(b, place).filter((F.col("study_a") < F.col("study_b")) & once & (
        F.col("wa") * F.col("wb") + F.col("ra") * F.col("rb") >= threshold - slack)
    ).select("study_a", "study_b").distinct()
    left = weights.select(F.col("group_study").alias("study_a"), "term",
                          F.col("weight").alias("wa"))
    right = weights.select(F.col("group_study").alias("study_b"), "term",
                           F.col("weight").alias("wb"))
    scored = (candidates.join(left, "study_a").join(right, ["study_b", "term"])
              .groupBy("study_a", "study_b")
              .agg(F.round(F.sum(F.col("wa") * F.col("wb")), digits).alias("similarity")))
    return scored.filter(F.col("similarity") >= threshold)
