"""Queries over pages: fused (parse, match and project in one stage) and relational (over node tables)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdom.functions.columns import outer_html, text_content, to_text
from sparkdom.html.dom import Node
from sparkdom.html.markdown import to_markdown
from sparkdom.html.parse import parse
from sparkdom.html.serialize import SerializeError, compact, inside, leaf, to_html
from sparkdom.operators.parse import kind_of, nodes, per_page, trees
from sparkdom.plans.css import SelectorError, parse_selector
from sparkdom.plans.early import decidable, find_early, find_first
from sparkdom.plans.matcher import first_n
from sparkdom.plans.relational import flag, flag_few, flag_parent, looks_around
from sparkdom.plans.targeted import compile_targeted, may_match

#: Fields of a match and their types.
TYPES = {
    "pos": "int", "name": "string", "ns": "string", "attrs": "map<string, string>", "text": "string", "raw_text": "string", "extracted": "string",
    "outer_html": "string", "pretty_html": "string", "inner_html": "string", "pretty_children": "string", "markdown": "string",
}


def _children_html(node: Node) -> str:
    return "".join(leaf(c, node) if c.kind in ("text", "comment", "doctype") else compact(c) for c in inside(node))


def _value(node: Node, pos: int, field: str):
    """One field; html that cannot be written (a doctype with both kinds of quotes) is null."""
    if field == "pos":
        return pos
    if field == "attrs":
        return None if node.attrs is None else list(node.attrs.items())
    if field in ("name", "ns"):
        return getattr(node, field)
    if field == "text":
        return node.to_text()
    if field == "raw_text":
        return node.text_content
    if field == "extracted":
        return node.inner_text() if node.kind == "document" else node.text_content or ""
    try:
        if field == "pretty_children":
            return "\n".join(h for c in node.children or () if (h := to_html(c)))
        return {"outer_html": compact, "pretty_html": to_html, "inner_html": _children_html, "markdown": to_markdown}[field](node)
    except SerializeError:
        return None


def _project(node: Node, pos: int, fields: Sequence[str]) -> tuple:
    return tuple(_value(node, pos, f) for f in fields)


def select_local(html: str | bytes, selector: str | None, fields: Sequence[str], limit: int | None = None) -> list[dict]:
    """The matches of one page at hand, without Spark."""
    root = parse(html).root
    found = [root] if selector is None else first_n(root, parse_selector(selector), limit)
    rows = [dict(zip(fields, _project(n, k, fields), strict=True)) for k, n in enumerate(found, 1)]
    return [r | {"attrs": dict(r["attrs"] or ())} if "attrs" in r else r for r in rows]


def select(df: DataFrame, selector: str | None, fields: Sequence[str] = ("pos", "name", "text"), limit: int | None = None, key: str = "page_id", html: str = "html", targeted: bool = False, prefilter: bool = True, encoding: str | None = None) -> DataFrame:
    """One row per match: key and the fields asked for, in document order by pos (from 1).

    Parsing, matching and projecting are one stage, so nothing but the fields leaves it.
    targeted restricts the selector to the subset of targeted extraction, prefilter drops
    pages below the stage that lack a literal every match needs. selector None gives the
    document itself. limit is per page; a targeted selector with a limit reads no further
    than it must.
    """
    parsed = None if selector is None else compile_targeted(selector) if targeted else parse_selector(selector)
    textual = kind_of(df, html) == "string"
    if parsed is not None and prefilter and textual and (needed := may_match(parsed, F.col(html))) is not None:
        df = df.where(needed)

    early = targeted and limit is not None and decidable(parsed)

    def rows(_, text) -> Iterator[tuple]:
        if early:
            for pos, node in enumerate(find_early(text, parsed, limit, encoding), 1):
                yield _project(node, pos, fields)
            return
        root = parse(text, encoding=encoding).root
        found = [root] if parsed is None else first_n(root, parsed, limit)
        for pos, node in enumerate(found, 1):
            yield _project(node, pos, fields)

    return per_page(df, key, html, rows, ", ".join(f"{f} {TYPES[f]}" for f in fields))


def select_first(df: DataFrame, selector: str, fields: Sequence[str] = ("name", "text"), **options) -> DataFrame:
    return select(df, selector, fields, limit=1, targeted=True, **options)


def select_statistics(df: DataFrame, selector: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """For the first match of a targeted selector: characters of each page, those read, elements made, and whether there was a match."""
    parsed = compile_targeted(selector)
    if not decidable(parsed):
        raise SelectorError(f"{selector!r} is not decided before the end of a page")

    def rows(_, text) -> Iterator[tuple]:
        seen: dict[str, int] = {}
        node = find_first(text, parsed, statistics=seen)
        yield len(text or ""), seen["read"], seen["made"], node is not None

    return per_page(df, key, html, rows, "characters int, characters_read int, elements_made int, found boolean")


def matched(node_table: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The rows of a nodes table that match, with no other change."""
    return flag(node_table, selector, key, "_matched").where("_matched").drop("_matched")


def query(pages: DataFrame, selector: str, key: str = "page_id", scope: DataFrame | str | None = None) -> DataFrame:
    """Matching rows of parsed pages, from the node table alone: filters and windows, one shuffle by key at most.

    scope keeps what lies inside the matches of a selector, or inside the nodes of a table
    (key, tree_id, node_id, last_id); ancestors above them still count in the selector. A
    selector costs one more window; a table that comes from the same pages parses them again.
    """
    table = nodes(pages, key)
    if looks_around(selector) or isinstance(scope, str):
        rows = flag_few(table, selector, key, "_matched", scope if isinstance(scope, str) else None).where("_matched").drop("_matched")
    else:
        rows = matched(table, selector, key)
    if scope is None or isinstance(scope, str):
        return rows
    # intervals nest, so the innermost scope that begins before a node and reaches it is enough
    marks = scope.select(key, "tree_id", F.col("node_id").alias("node_id"), F.col("last_id").alias("_reach"))
    both = rows.withColumn("_reach", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key, "tree_id").orderBy("node_id", F.col("_reach").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("_in", F.max("_reach").over(w) >= F.col("node_id"))
    return inside.where("_reach is null and _in").select(*rows.columns)


def _slices(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"raw_text": text_content(), "text": to_text(text_content(extract=True)), "outer_html": outer_html()}).drop("tree_text", "tree_html")


def query_text(pages: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """query, with raw_text, text and outer_html: what with_text adds, from one pass over the pages.

    A tree's text and the page's HTML travel on the tree's root row only, and are passed to
    the matches once the other rows are gone.
    """
    if not looks_around(selector):
        table = pages.select(key, "texts", F.col("html").alias("tree_html"), F.inline("nodes"))
        return _slices(matched(table, selector, key).withColumn("tree_text", F.col("texts")[F.col("tree_id")]).drop("texts"))
    table = pages.select(key, "texts", "html", F.inline("nodes"))
    first = F.col("depth") == 0
    table = table.withColumns({"_text": F.when(first, F.col("texts")[F.col("tree_id")]), "_html": F.when(F.col("node_id") == 0, F.col("html"))}).drop("texts", "html")
    flagged = flag_few(table, selector, key, "_matched", keep=first).where(F.col("_matched") | first)
    page, tree = Window.partitionBy(key).orderBy("node_id"), Window.partitionBy(key, "tree_id").orderBy("node_id")
    rows = flagged.withColumns({"tree_html": F.first("_html").over(page), "tree_text": F.first("_text").over(tree)}).where("_matched")
    return _slices(rows.drop("_matched", "_text", "_html"))


def with_text(rows: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds raw_text, text and outer_html to rows of the node table: slices of their trees.

    For pages that are stored or cached; others are parsed for each of the three tables, and query_text parses them once.
    """
    t = trees(pages, key).select(key, "tree_id", "tree_text")
    h = pages.select(key, F.col("html").alias("tree_html"))
    joined = rows.join(t, [key, "tree_id"]).join(h, key)
    return _slices(joined)


def first_rows(rows: DataFrame, n: int, key: str = "page_id") -> DataFrame:
    """The first n matches of each page."""
    w = Window.partitionBy(key).orderBy("node_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def numbered(rows: DataFrame, key: str = "page_id", name: str = "pos") -> DataFrame:
    """Matches numbered from 1 in document order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy("node_id")))


def counts(rows: DataFrame, pages: DataFrame, key: str = "page_id", name: str = "n") -> DataFrame:
    """Matches of every page, zero included."""
    per = rows.groupBy(key).agg(F.count("*").alias(name))
    return pages.select(key).join(per, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def records(rows: DataFrame, value: Column, key: str = "page_id", separator: str = "\n", order: str = "node_id") -> DataFrame:
    """Each page's values in document order, joined by the separator."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["v"]), separator, "").alias("record"))
