"""Tolerant access to nested and encoded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeharbor.functions.core import as_column, strip


def parse_references(cell: Column | str) -> Column:
    """Reference list of a cell as ``array<string>``, never NULL.

    A JSON list is taken as it is; null, true and false become ``None``, ``True`` and ``False``.
    JSON is strict: double quotes, nothing after the value. Text that is not JSON is split at ``;``
    when it has one. Everything else is empty.
    """
    cell = as_column(cell)
    value = F.when(_strict(cell), F.try_parse_json(cell))
    as_list = F.transform(value.try_cast("array<variant>"), _spelled)
    pieces = F.filter(F.transform(F.split(cell, ";"), strip), lambda x: x != "")
    return F.coalesce(
        F.when(value.isNotNull() & F.ltrim(cell).startswith("["), as_list),
        F.when(value.isNull() & cell.contains(";"), pieces),
        F.array().cast("array<string>"))


# Strings of a JSON text, and what may be left once they are taken out: one value without values
# inside, or a list or object with nothing but separators after a bracket. The parser itself is
# more tolerant.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN = r"""^\s*(?:\[[^\[\]{}']*\]|\{[^\[\]{}']*\}|""|[-+.0-9eE]+|true|false|null)\s*$"""
_NESTED = r"^\s*[\[{][^\[{]*[\[{]"
_NOT_NESTED = r"'|[\]}]\s*[^\s\]},]|[^\]}\s]\s*$"


def _strict(cell: Column) -> Column:
    bare = F.regexp_replace(cell, _STRING, '""')
    return bare.rlike(_PLAIN) | (bare.rlike(_NESTED) & ~bare.rlike(_NOT_NESTED))


def _spelled(element: Column) -> Column:
    kind = F.schema_of_variant(element)
    text = element.cast("string")
    return (F.when(element.isNull() | F.is_variant_null(element), "None")
            .when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))


def name_nulls(references: Column | str) -> Column:
    """A reference list that is an array already: NULL elements become ``"None"``."""
    return F.coalesce(
        F.transform(as_column(references), lambda x: F.coalesce(x.cast("string"), F.lit("None"))),
        F.array().cast("array<string>"))


def json_path(document: Column | str, *keys: str, default: Column | str | None = None) -> Column:
    """Value at a path of object keys in a JSON string, else the default."""
    path = "$" + "".join(f"['{key}']" for key in keys)
    found = F.get_json_object(as_column(document), path)
    return found if default is None else F.coalesce(found, F.lit(default))


def map_path(value: Column | str, *keys: str, default: Column | str | None = None) -> Column:
    """Value at a path of keys in nested maps, else the default."""
    found = as_column(value)
    for key in keys:
        found = F.try_element_at(found, F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))
