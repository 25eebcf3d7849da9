"""Evidence from reference lists: which cited works are mapped datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeharbor.functions.core import non_empty
from citeharbor.functions.identifiers import study_key
from citeharbor.functions.nested import name_nulls, parse_references
from citeharbor.functions.patterns import ARCHIVE, PatternSet
from citeharbor.operators.classify import with_category
from citeharbor.operators.detect import with_detection
from citeharbor.sources.stages import cut

FILTER_BITS = 24  # of the bitmap of mapped work ids: 2 MB, however many there are
REFERENCE_FIELDS = ("ref_has_icpsr", "ref_icpsr_work_ids", "ref_icpsr_dois",
                    "ref_icpsr_study_numbers")


def mapped_works(work_map: DataFrame, order: str = "seq") -> DataFrame:
    """Map with one row per work id; the last row that has a value sets an attribute.

    Empty DOIs and the number zero count as missing, but still replace an earlier value.
    """
    def last(name: str):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order)))

    number = F.coalesce(study_key("study").cast("string"), F.col("study").cast("string"))
    return (
        work_map.filter(F.col("openalex_work_id").isNotNull())
        .withColumnRenamed("icpsr_study_number", "study")
        .groupBy(F.col("openalex_work_id").alias("work_id"))
        .agg(last("icpsr_doi").alias("doi"), last("study").alias("study"))
        .select("work_id", non_empty("doi").alias("doi"),
                F.when(~number.isin("", "0"), number).alias("study")))


def id_bitmap(ids: DataFrame, name: str = "work_id", bits: int = FILTER_BITS) -> DataFrame:
    """One row: ``bitmap``, 2^bits bits in longs, in which the hash of every id has its bit set.

    Of fixed size. Ids that are not there may pass as well, the more of them the fuller it is, so it
    only spares rows that a join drops later.
    """
    spark = ids.sparkSession
    slot = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(1 << bits))
    words = ids.filter(F.col(name).isNotNull()).select(slot.alias("slot")).groupBy(
        F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    every = spark.range(1 << (bits - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    dense = words.unionByName(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "bits")))
    return dense.agg(F.transform(ordered, lambda x: x["bits"]).alias("bitmap"))


def citation_edges(articles: DataFrame, key: str = "seq", among: DataFrame | None = None,
                   bits: int = FILTER_BITS) -> DataFrame:
    """``key, pos, work_id``: one row per reference, in list order.

    ``referenced_works`` is an array of ids or a text cell that encodes one. With ``among``, a table
    with ``work_id``, references that are certainly not in it are dropped inside their list, before
    a row is made of them; a few others remain, so join the result as before.
    """
    kind = articles.schema["referenced_works"].dataType
    parse = name_nulls if isinstance(kind, T.ArrayType) else parse_references
    listed = parse("referenced_works")
    if among is None:
        return articles.select(key, F.posexplode(listed).alias("pos", "work_id"))
    placed = F.transform(listed, lambda x, i: F.struct(i.alias("pos"), x.alias("work_id")))

    def may(x):
        slot = F.pmod(F.xxhash64(x["work_id"].cast("string")), F.lit(1 << bits))
        long = F.get(F.col("bitmap"), F.shiftright(slot, 6).cast("int"))
        return F.getbit(long, F.pmod(slot, F.lit(64)).cast("int")) == 1

    wanted = cut(id_bitmap(among.select("work_id"), bits=bits)).scalar()
    return articles.select(key, placed.alias("placed"), wanted.alias("bitmap")).select(
        key, F.filter("placed", may).alias("placed")).select(key, F.inline("placed"))


def matched_edges(edges: DataFrame, works: DataFrame) -> DataFrame:
    """Edges that cite a mapped work, with its attributes.

    Neither side is forced to be broadcast: Spark does so when the map's size
    allows it and otherwise sorts and merges, splitting a heavily cited work.
    """
    return edges.join(works, "work_id")


def matched_pairs(edges: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """One row per (citing work, mapped work) with the number of citations.

    The join drops all edges to unmapped works before anything is grouped, and
    nothing is gathered per citing work.
    """
    return (matched_edges(edges, works).groupBy(key, "work_id", "doi", "study")
            .agg(F.count("*").alias("n_refs")))


def reference_hits(articles: DataFrame, work_map: DataFrame, key: str = "seq",
                   map_order: str = "seq", prefilter: bool = False) -> DataFrame:
    """Reference evidence of the articles that have any, one row each.

    ``prefilter`` looks references up in a bitmap of the map's ids first, which pays where the map is
    too large to be broadcast and most references are to other works; the result is the same.
    Work ids keep list order and repeats; DOIs and numbers are sorted sets. A
    group is never larger than the reference cell it came from.
    """
    works = mapped_works(work_map, map_order)
    among = work_map.select(F.col("openalex_work_id").alias("work_id")) if prefilter else None
    hits = matched_edges(citation_edges(articles, key, among), works)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "work_id")))
    return hits.groupBy(key).agg(
        F.lit(True).alias("ref_has_icpsr"),
        F.array_join(F.transform(ordered, lambda x: x["work_id"]), ";")
        .alias("ref_icpsr_work_ids"),
        F.array_join(F.sort_array(F.collect_set("doi")), ";").alias("ref_icpsr_dois"),
        F.array_join(F.sort_array(F.collect_set("study")), ";")
        .alias("ref_icpsr_study_numbers"))


def with_references(articles: DataFrame, work_map: DataFrame | None, key: str = "seq",
                    map_order: str = "seq", citations: DataFrame | None = None,
                    prefilter: bool = False) -> DataFrame:
    """Add the four reference columns; without references or a map nothing matches.

    ``citations`` is where the reference cells are read from. Pass the table as
    it was before text detection, so that branch of the plan has no detection.
    """
    articles = articles.drop(*REFERENCE_FIELDS)
    citations = articles if citations is None else citations
    if work_map is None or "referenced_works" not in citations.columns:
        return articles.withColumns({
            "ref_has_icpsr": F.lit(False), "ref_icpsr_work_ids": F.lit(""),
            "ref_icpsr_dois": F.lit(""), "ref_icpsr_study_numbers": F.lit("")})
    hits = reference_hits(citations, work_map, key, map_order, prefilter)
    return articles.join(hits, key, "left").withColumns({
        "ref_has_icpsr": F.coalesce("ref_has_icpsr", F.lit(False)),
        **{c: F.coalesce(c, F.lit("")) for c in REFERENCE_FIELDS[1:]}})


def with_evidence(articles: DataFrame, work_map: DataFrame | None, key: str = "seq",
                  text: str = "fulltext", patterns: PatternSet = ARCHIVE,
                  keep_text: bool = True, **category_options) -> DataFrame:
    """Text evidence, reference evidence and category of every article.

    Detection runs before the join, row by row; without ``keep_text`` the text
    itself never enters a shuffle.
    """
    found = with_detection(articles, text, patterns)
    if not keep_text:
        found = found.drop(text)
    return with_category(
        with_references(found, work_map, key, citations=articles), **category_options)
