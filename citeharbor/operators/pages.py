"""Text of web pages and metadata of dataset landing pages."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.functions.core import WHITESPACE, non_empty
from citeharbor.functions.identifiers import STUDY_PAGE, find_doi
from citeharbor.functions.text import (
    TAG_BODY, bare_text, clean_lines, decode_all, drop_hidden, has_rare_entity, join_nodes,
    text_nodes)
from citeharbor.operators.binding import bind
from citeharbor.schemas import NESTED_PAGE_FIELDS

# Workers need no copy of this package: its Python helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where a landing page keeps its fields, in order of preference.
# Each description place is (tag or None, attribute, value).
BADGE_CLASS = "badge"
SUBJECT_LIST_CLASS = "subject-list"
DESCRIPTION_PLACES = (
    (None, "id", "study-description"),
    (None, "class", "description"),
    ("section", "id", "description"),
    ("section", "id", "abstract"),
    ("div", "class", "abstract"),
)
CREATOR_WORD = "investigator"

# Fixed value: tags that never hold content.
VOID_TAGS = frozenset((
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer").split())
# Pages that can hold such a field: the name in a class or id, the word, or encoded characters.
NEEDS_PARSER = (r"(?i)(?:class|id)\s*=[^>]*(?:badge|subject-list|description|abstract|&)"
                r"|investigator|&#")


class _Fields(HTMLParser):
    """Collects the text of the elements that may nest: links, spans, descriptions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, its buffers, is a subject list
        self.open_tags: Counter[str] = Counter()
        self.buffers: list[list[str]] = []  # of all open elements, outermost first
        self.in_subjects = 0
        self.badges: list[list[str]] = []
        self.listed: list[list[str]] = []
        self.credits: list[list[str]] = []
        self.places: list[list[str] | None] = [None] * len(DESCRIPTION_PLACES)

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in reversed(attrs)}
        classes = values.get("class", "").split()
        text: list[str] = []
        wanted = 0
        for kept, chosen in (
                (self.badges, tag == "a" and BADGE_CLASS in classes),
                (self.listed, tag == "a" and self.in_subjects > 0),
                (self.credits, tag in ("a", "span"))):
            if chosen:
                kept.append(text)
                wanted = 1
        for i, (name, attr, value) in enumerate(DESCRIPTION_PLACES):
            found = value in classes if attr == "class" else values.get(attr) == value
            if self.places[i] is None and found and name in (None, tag):
                self.places[i] = text
                wanted = 1
        if tag not in VOID_TAGS:
            listing = SUBJECT_LIST_CLASS in classes
            self.in_subjects += listing
            self.open.append((tag, wanted, listing))
            self.open_tags[tag] += 1
            if wanted:
                self.buffers.append(text)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open_tags[tag]:
            return
        name = None
        while name != tag:
            name, wanted, listing = self.open.pop()
            self.open_tags[name] -= 1
            self.in_subjects -= listing
            if wanted:
                self.buffers.pop()

    def handle_data(self, data):
        text = data.strip(WHITESPACE)
        if text and not (self.open and self.open[-1][0] in ("script", "style")):
            for buffer in self.buffers:
                buffer.append(text)


def _nested_fields(html: str | None):
    if html is None:
        return None, None, None
    page = _Fields()
    try:
        page.feed(html)
        page.close()
    except Exception:  # noqa: BLE001 - markup that the parser refuses: the page has no such fields
        return None, None, None
    subjects = {"".join(parts) for parts in page.badges + page.listed}
    creators = {" ".join(parts) for parts in page.credits}
    description = next((" ".join(parts) for parts in page.places if parts is not None), None)
    return (sorted(subjects - {""}), description,
            sorted(c for c in creators if CREATOR_WORD in c.lower()))


@F.pandas_udf(NESTED_PAGE_FIELDS)
def _parse_nested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            [_nested_fields(h) for h in batch], columns=["subjects", "description", "creators"])


def with_decoded(df: DataFrame, encoded: Column, name: str) -> DataFrame:
    """Add ``name``: an encoded text column with all character references decoded."""
    bound = bind(df, F.struct(encoded.alias("_encoded")))
    flagged = bound.withColumn("_rare", has_rare_entity("_encoded"))
    return flagged.withColumn(name, decode_all("_encoded", "_rare")).drop("_encoded", "_rare")


def with_page_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Replace ``html`` by the visible text of the page, NULL when there is none.

    The page is stripped of markup, decoded and cleaned in steps that are each
    computed once, whatever is filtered later.
    """
    kept = [c for c in pages.columns if c not in (html, name)]
    decoded = with_decoded(pages, bare_text(html), "_decoded")
    return bind(decoded, F.struct(clean_lines("_decoded").alias(name)), kept)


def heading(html: Column | str) -> Column:
    """Markup of the first ``h1`` element, empty when the page has none."""
    return F.regexp_extract(
        drop_hidden(html), rf"(?is)<h1\b({TAG_BODY})>(.*?)(?:</h1\s*>|\z)", 0)


def page_metadata(pages: DataFrame, key: Column | str = "page_id", html: str = "html",
                  base: str = STUDY_PAGE) -> DataFrame:
    """One metadata row per page.

    Title and DOI are column expressions. Fields whose elements can nest go
    through a standard-library parser, and only for pages that can hold one:
    the others hand a NULL to Python.
    """
    number = (F.col(key) if isinstance(key, str) else key).cast("string")
    source = pages.select(number.alias("icpsr_id"), F.col(html).alias("html"))
    titled = with_decoded(source, text_nodes(heading("html")), "_heading")
    parsed = titled.withColumn(
        "n", _parse_nested(F.when(F.col("html").rlike(NEEDS_PARSER), F.col("html"))))
    return parsed.select(
        "icpsr_id", F.concat(F.lit(base), "icpsr_id").alias("icpsr_url"),
        F.when(F.col("_heading") != "", join_nodes("_heading")).alias("title"),
        non_empty(F.array_join("n.creators", "; ")).alias("creators"),
        non_empty(F.array_join("n.subjects", "; ")).alias("subjects"),
        F.col("n.description").alias("description"), find_doi("html").alias("doi"))
