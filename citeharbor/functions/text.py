"""Text clean-up, sentence splitting, inverted-index decoding and HTML to text."""

from __future__ import annotations

import html as html_module
import re
import sys
from html import entities

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeharbor.functions.core import SPACE_CLASS, as_column, let, non_empty, strip


def norm_text(value: Column | str) -> Column:
    """Every run of white space becomes one blank; ends are trimmed; NULL stays NULL."""
    return strip(F.regexp_replace(as_column(value), f"(?U){SPACE_CLASS}+", " "))


def sentences(value: Column | str) -> Column:
    """Array of sentences: cut at white space that follows ``.``, ``!`` or ``?``."""
    return F.split(strip(value), f"(?U)(?<=[.!?]){SPACE_CLASS}+")


def as_text(value: Column | str) -> Column:
    """String form of any scalar; NULL becomes the empty string."""
    return F.coalesce(as_column(value).cast("string"), F.lit(""))


def decode_inverted_index(index: Column | str) -> Column:
    """Rebuild text from a ``map<word, array<position>>``.

    Negative positions are ignored, gaps leave no trace, and where two words
    claim one position the later map entry wins. NULL and empty maps give NULL.
    """
    index = as_column(index)
    entry = T.StructType([
        T.StructField("pos", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("word", T.StringType()),
    ])
    placed = F.flatten(F.transform(
        F.map_entries(index),
        lambda e, i: F.transform(
            F.coalesce(e["value"], F.array().cast("array<int>")),
            lambda p: F.struct(p.alias("pos"), i.alias("ord"), e["key"].alias("word"))),
    )).cast(T.ArrayType(entry))
    ordered = F.sort_array(F.filter(placed, lambda x: x["pos"] >= 0))

    def text_of(slots: Column) -> Column:
        # Sorted by (position, entry), so the winner of a position is its last slot.
        winners = F.filter(slots, lambda x, i: (
            ~F.get(slots, i + 1)["pos"].eqNullSafe(x["pos"]) & (x["word"] != "")))
        return F.array_join(F.transform(winners, lambda x: x["word"]), " ")

    return F.when(F.size(index) > 0, let(ordered, text_of))


# --- HTML ---------------------------------------------------------------------

# Quotes protect '>' only after '='; possessive groups keep matching linear.
TAG_BODY = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG = rf"</?[a-zA-Z]{TAG_BODY}>"
DECLARATION = r"<[!?][^>]*>"
# One alternation, so whichever of a comment and a hidden element opens first wins.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style|noscript)\b{TAG_BODY}>.*?(?:</\1\s*>|\z)"
)
LINE_BREAK = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Entities decoded inside the JVM; ``&amp;`` must come last.
COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\xa0"),
    ("&copy;", "\xa9"), ("&reg;", "\xae"), ("&middot;", "\xb7"), ("&bull;", "•"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&amp;", "&"),
)
_COMMON_NAMES = "|".join(name[1:-1] for name, _ in COMMON_ENTITIES)
RARE_ENTITY = rf"&(?:#|(?!(?:{_COMMON_NAMES});)[A-Za-z])"


# Workers need no copy of this package: its Python helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_REFERENCE = re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?")


def _reference_char(match: re.Match) -> str:
    name = match[1] + ";"
    known = name[0] == "#" or name in entities.html5
    # A number of thousands of digits is no character; it is left as it is.
    return html_module.unescape("&" + name) if known and len(name) <= 100 else match[0]


@F.pandas_udf(T.StringType())
def _decode_rare_entities(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _REFERENCE.sub(_reference_char, v), na_action="ignore")


def decode_common(value: Column | str) -> Column:
    """Decode the common character references; exact when no other one occurs."""
    value = as_column(value)
    for name, char in COMMON_ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def has_rare_entity(value: Column | str) -> Column:
    return as_column(value).rlike(RARE_ENTITY)


def decode_all(value: Column | str, rare: Column | str) -> Column:
    """Decode every character reference.

    ``rare`` flags the rows that need Python; all others pass a NULL through the
    Arrow batch and are decoded in the JVM.
    """
    value, rare = as_column(value), as_column(rare)
    return F.when(rare, _decode_rare_entities(F.when(rare, value))).otherwise(
        decode_common(value))


def drop_hidden(html: Column | str) -> Column:
    """Remove comments and script, style and noscript elements."""
    return F.regexp_replace(as_column(html), HIDDEN, "\n")


def bare_text(html: Column | str) -> Column:
    """A page without markup, its character references still encoded."""
    return F.regexp_replace(
        F.regexp_replace(drop_hidden(html), TAG, "\n"), DECLARATION, "\n")


def clean_lines(value: Column | str) -> Column:
    """Trimmed non-blank lines; NULL when there is none."""
    lines = F.filter(
        F.transform(F.split(as_column(value), LINE_BREAK), strip), lambda x: x != "")
    return non_empty(let(lines, lambda x: F.array_join(x, "\n")))


def text_nodes(fragment: Column | str) -> Column:
    """An HTML fragment with a NUL character in place of each tag."""
    return F.regexp_replace(as_column(fragment), TAG, "\u0000")


def join_nodes(nodes: Column | str, separator: str = "") -> Column:
    """Trimmed, non-blank text nodes joined by ``separator``."""
    kept = F.filter(
        F.transform(F.split(as_column(nodes), "\u0000"), strip), lambda x: x != "")
    return F.array_join(kept, separator)
