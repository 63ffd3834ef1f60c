"""Columns over rows of the node table joined to their trees; all built-in functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """ASCII white space to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[\\t\\n\\f\\r ]+", " "), F.lit(" "))


to_text = collapse


def _slice(text: Column, start: str, end: str) -> Column:
    return F.substring(text, F.col(start) + 1, F.col(end) - F.col(start))


def text_content(tree_text: str = "tree_text", extract: bool = False) -> Column:
    """Text and comments: their data; elements and fragments: the text below; documents and doctypes: null, or with extract the text below."""
    below = _slice(F.col(tree_text), "text_from", "text_to")
    out = F.when(F.col("kind").isin("text", "comment"), F.col("data"))
    if extract:
        return out.when(F.col("kind") == "doctype", "").otherwise(below)
    return out.when(F.col("kind").isin("element", "fragment"), below)


def own_text() -> Column:
    return F.when(F.col("kind") == "text", F.col("data")).otherwise("")


def outer_html(tree_html: str = "tree_html") -> Column:
    return _slice(F.col(tree_html), "html_from", "html_to")


def attr(name: str, missing: str = "") -> Column:
    """An attribute's value, with a placeholder where there is none."""
    at = F.col("attrs")[name.lower()]
    return F.when(F.map_contains_key("attrs", F.lit(name.lower())), F.coalesce(at, F.lit(""))).otherwise(missing)


def class_list(attrs: str = "attrs") -> Column:
    return F.filter(F.split(F.coalesce(F.col(attrs)["class"], F.lit("")), r"[\t\n\x0B\f\r ]+"), lambda x: x != "")


def sorted_attrs(attrs: str = "attrs") -> Column:
    """(key, value) pairs in byte order of the keys."""
    return F.array_sort(F.map_entries(attrs))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]])", r"\\$1")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
