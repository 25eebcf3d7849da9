"""Search of article text through an index of letter triples, for tables that are searched often.

The index has a posting for each triple of the lower-cased search columns and each range of 32,768
arrival numbers: the rows of that range whose text has the triple. From the search pattern follow
triples that every match must hold; only rows that have them are read and tested, by the same condition
as a scan. A pattern from which nothing follows, or whose triples most rows have, is answered by a scan.

Triples are derived from a pattern by its syntax tree: a stretch of plain letters needs its triples, a
sequence needs what its parts need, an alternative what one of its branches needs, a part that may be
absent nothing. Syntax that Python's parser does not read like the one that runs the search (flags,
class operations, quoting) is not derived from.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.core import let
from citeharbor.operators.views import SEARCH_COLUMNS, article_condition
from citeharbor.sources.stages import cut

RANGE_BITS = 15
RAREST = 3       # triples asked for in each stretch of letters
HELD_ROWS = 10_000  # so many arrival numbers go into the scan as a list
#: A larger share of rows than this is read by a plain scan.
WORTH = 0.2
FOREIGN = re.compile(r"\(\?[a-zA-Z-]|&&|\\[QERXGhHvVzZpPNx0]|\[[^\]]*\[|\\c")


@dataclass(frozen=True)
class Need:
    """Triples a match must hold: all parts (``every``), or those of some part; None asks for nothing."""

    every: bool
    parts: tuple

    def grams(self) -> set[str]:
        return {g for p in self.parts for g in ({p} if isinstance(p, str) else p.grams())}


def _all(parts) -> Need | None:
    parts = tuple(dict.fromkeys(p for p in parts if p is not None))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 and isinstance(parts[0], Need) else Need(True, parts)


def _stretch(letters: str) -> Need | None:
    return _all(letters[i:i + 3] for i in range(len(letters) - 2))


def _sequence(nodes) -> Need | None:
    """What a parsed sequence needs; plain groups in it are read through."""
    found, letters = [], ""

    def end():
        nonlocal letters
        found.append(_stretch(letters))
        letters = ""

    def read(items):
        nonlocal letters
        for kind, value in items:
            if kind is kinds.LITERAL and chr(value).lower() == chr(value):
                letters += chr(value)
            elif kind is kinds.SUBPATTERN and not value[1] and not value[2]:
                read(value[3])
            else:
                end()
                found.append(_single(kind, value))

    read(nodes)
    end()
    return _all(found)


def _single(kind, value) -> Need | None:
    if kind is kinds.BRANCH:
        branches = [_sequence(b) for b in value[1]]
        return None if None in branches else Need(False, tuple(dict.fromkeys(branches)))
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        return _sequence(value[2]) if value[0] > 0 else None
    if kind is kinds.ATOMIC_GROUP:
        return _sequence(value)
    return None


def required(query: str, mode: str = "regex") -> Need | None:
    """The triples that every text found by a search holds, as far as they are known."""
    query = query.lower()
    if mode == "literal":
        return _stretch(query)
    if FOREIGN.search(query):
        return None
    try:
        return _sequence(parser.parse(query))
    except (re.error, OverflowError, RecursionError):
        return None


def _fewer(need, counts: dict[str, int]):
    """The rarest triples of each stretch only; what is left out is tested with the pattern anyway."""
    if isinstance(need, str):
        return need
    parts = tuple(_fewer(p, counts) for p in need.parts)
    if need.every:
        rare = sorted((p for p in parts if isinstance(p, str)), key=lambda g: counts.get(g, 0))[:RAREST]
        parts = tuple(rare) + tuple(p for p in parts if not isinstance(p, str))
    return Need(need.every, parts)


def _most(need, counts: dict[str, int]) -> int:
    """A bound for the number of rows that have what is needed."""
    if isinstance(need, str):
        return counts.get(need, 0)
    sizes = [_most(p, counts) for p in need.parts]
    return min(sizes) if need.every else sum(sizes)


def _holds(need, grams: Column) -> Column:
    if isinstance(need, str):
        return F.array_contains(grams, need)
    tests = [_holds(p, grams) for p in need.parts]
    return reduce((lambda a, b: a & b) if need.every else (lambda a, b: a | b), tests)


# --- the index -------------------------------------------------------------------------

def _grams(text: Column) -> Column:
    """The triples of a text, from the list of its characters: a substring would be looked for from the start."""
    def triples(letters: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(letters) - 3), lambda i: F.concat(
            F.get(letters, i), F.get(letters, i + 1), F.get(letters, i + 2)))

    return F.when(F.length(text) >= 3, let(F.split(text, ""), triples)).otherwise(F.array().cast("array<string>"))


def postings(articles: DataFrame, key: str = "seq", columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    """``gram, range, rows``: places, in a range of 2^15 arrival numbers, of the rows that have a triple.

    A triple that most rows have is divided by ranges; a list holds at most one entry for each of them.
    """
    names = [c for c in columns if c in articles.columns]
    texts = F.transform(F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names]), _grams)
    rows = articles.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.explode(
        F.array_distinct(F.flatten(texts))).alias("gram"))
    size = 1 << RANGE_BITS
    return rows.groupBy("gram", F.shiftright("k", RANGE_BITS).alias("range")).agg(F.sort_array(F.collect_set(
        F.pmod("k", F.lit(size)).cast("int"))).alias("rows"))


class TextIndex:
    """An article table in arrival order, its postings, and the number of rows of each triple."""

    def __init__(self, spark, path: str, key: str = "seq"):
        self.key = key
        self.articles = spark.read.parquet(f"{path}/articles")
        self.postings = spark.read.parquet(f"{path}/postings")
        self.counts = spark.read.parquet(f"{path}/counts")
        info = spark.read.parquet(f"{path}/info").first()
        self.rows, self.columns = info["n"], info["columns"].split(",")

    def _counted(self, grams: set[str]) -> dict[str, int]:
        return {r["gram"]: r["n"] for r in self.counts.filter(F.col("gram").isin(sorted(grams))).collect()}

    def candidates(self, query: str, mode: str = "regex") -> DataFrame | None:
        """Arrival numbers of the rows that may match; None if a scan is as good."""
        need = required(query, mode)
        if need is None:
            return None
        counts = self._counted(need.grams())
        need = _fewer(need, counts)
        if _most(need, counts) > WORTH * self.rows:
            return None
        rows = self.postings.filter(F.col("gram").isin(sorted(need.grams()))).select(
            "gram", F.explode(F.transform("rows", lambda r: F.shiftleft("range", RANGE_BITS) + r)).alias(self.key))
        return rows.groupBy(self.key).agg(F.collect_set("gram").alias("grams")).filter(
            _holds(need, F.col("grams"))).select(self.key)

    def search(self, query: str, mode: str = "regex", columns: Sequence[str] | None = None, **filters) -> DataFrame:
        """The rows that :func:`views.filter_articles` finds with the same values."""
        columns = self.columns if columns is None else columns
        if not set(columns) & set(self.articles.columns) <= set(self.columns):
            raise ValueError(f"the index has the columns {', '.join(self.columns)} only")
        found = self.candidates(query, mode) if query else None
        rows = self.articles
        if found is not None:
            found = cut(found)
            held = [r[0] for r in found.limit(HELD_ROWS + 1).collect()]
            if len(held) <= HELD_ROWS:  # reaches the Parquet reader, which leaves out row groups and pages
                rows = rows.filter(F.col(self.key).isin(held) if held else F.lit(False))
            else:
                rows = rows.join(found, self.key, "left_semi")
        return rows.filter(article_condition(rows, query=query, mode=mode, columns=columns, **filters))


def build_index(articles: DataFrame, path: str, key: str = "seq", columns: Sequence[str] = SEARCH_COLUMNS) -> TextIndex:
    """Store articles by arrival number and the postings of their search columns under ``path``.

    Rows without an arrival number are left out of both.
    """
    spark = articles.sparkSession
    names = [c for c in columns if c in articles.columns]
    rows = articles.filter(F.col(key).isNotNull())
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/articles")
    stored = spark.read.parquet(f"{path}/articles")
    postings(stored, key, names).repartitionByRange("gram", "range").sortWithinPartitions("gram", "range").write.mode(
        "overwrite").parquet(f"{path}/postings")
    listed = spark.read.parquet(f"{path}/postings")
    listed.groupBy("gram").agg(F.sum(F.size("rows")).alias("n")).repartitionByRange("gram").sortWithinPartitions(
        "gram").write.mode("overwrite").parquet(f"{path}/counts")
    stored.agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(names)).alias("columns")).write.mode("overwrite").parquet(f"{path}/info")
    return TextIndex(spark, path, key)
