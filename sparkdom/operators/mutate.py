"""Changes of trees, as new node tables: remove, append, insert, replace, clone.

A DataFrame does not change, so each of these gives the parsed pages that the changed trees
would have. What parse_pages or another change gives is changed in the stage that parses it,
before its trees are written as rows. Other pages, such as stored or cached ones, are rebuilt
from their node rows, changed in memory and encoded again. Either way it is one page at a time
in one narrow stage. A change that would not leave a tree leaves its page as it was, and says
so in the column `mutation_error`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdom import schema
from sparkdom.html.dom import HierarchyError, Node
from sparkdom.html.parse import parse
from sparkdom.operators.parse import FLUSH_CHARS, PageBatch, source_of
from sparkdom.plans.css import parse_selector
from sparkdom.plans.matcher import first_n
from sparkdom.plans.relational import flag_inside


def decode(rows: list[dict]) -> Node:
    """The tree that encode() gave these rows for."""
    by_id: dict[int, Node] = {}
    for r in rows:
        data = r["data"]
        if r["kind"] == "doctype":
            d = r["doctype"]
            data = (d["name"], d["public_id"], d["system_id"], d["force_quirks"])
        attrs = r["attrs"]
        node = Node(r["kind"], r["name"], r["ns"], None if attrs is None else dict(attrs), data)
        by_id[r["node_id"]] = node
        if r["owner_id"] is not None:
            by_id[r["owner_id"]].content = node
        elif r["parent_id"] is not None:
            parent = by_id[r["parent_id"]]
            node.parent = parent
            parent.children.append(node)
    return by_id[rows[0]["node_id"]]


def change(pages: DataFrame, selector: str, act: Callable[[Node, Node], None], key: str = "page_id") -> DataFrame:
    """act(root, match) on every match of each page that is still in the tree when its turn comes."""
    parsed = parse_selector(selector)

    def step(root: Node) -> str | None:
        error = None
        for node in first_n(root, parsed, None):
            if node.parent is None:
                continue
            try:
                act(root, node)
            except HierarchyError as e:
                error = str(e)
        return error

    if (source := source_of(pages, key)) is not None:
        return source.then(step)
    out = T._parse_datatype_string(f"`{key}` {pages.schema[key].dataType.simpleString()}, {schema.PAGE}, mutation_error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        made = PageBatch(arrow)
        for b in batches:
            names = b.schema.names
            for k in range(b.num_rows):  # one page at a time as Python values
                page = dict(zip(names, (c[k].as_py() for c in b.columns), strict=True))
                root = decode(page["nodes"])
                problem = step(root)
                made.put(page[key], root, page["encoding"], page["quirks"], page["errors"], problem=problem)
                if made.size >= FLUSH_CHARS:
                    yield made.arrow()
                    made = PageBatch(arrow)
        if made.keys:
            yield made.arrow()

    return pages.select(key, "encoding", "quirks", "nodes", "errors").mapInArrow(run, out)


def fragment(html: str) -> list[Node]:
    """Nodes of a piece of HTML, as a body would have them."""
    return parse(html, context=("body", "html")).root.children


def remove(pages: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    return change(pages, selector, lambda root, n: n.parent.remove_child(n), key)


def append(pages: DataFrame, selector: str, html: str, key: str = "page_id") -> DataFrame:
    """Put new nodes behind the last child of every match."""

    def act(root: Node, node: Node) -> None:
        for c in list(fragment(html)):
            c.parent = None
            node.append_child(c)

    return change(pages, selector, act, key)


def insert_before(pages: DataFrame, selector: str, html: str, key: str = "page_id") -> DataFrame:
    def act(root: Node, node: Node) -> None:
        for c in list(fragment(html)):
            c.parent = None
            node.parent.insert_before(c, node)

    return change(pages, selector, act, key)


def replace(pages: DataFrame, selector: str, html: str, key: str = "page_id") -> DataFrame:
    def act(root: Node, node: Node) -> None:
        new = list(fragment(html))
        for c in new:
            c.parent = None
        if not new:
            node.parent.remove_child(node)
            return
        for c in new[1:]:
            node.parent.insert_before(c, None)
        node.parent.replace_child(new[0], node)

    return change(pages, selector, act, key)


def move(pages: DataFrame, selector: str, target: str, key: str = "page_id") -> DataFrame:
    """Move every match to the end of the page's first match of target."""
    wanted = parse_selector(target)

    def act(root: Node, node: Node) -> None:
        to = next(iter(first_n(root, wanted, 1)), None)
        if to is None:
            raise HierarchyError("no target")
        to.append_child(node)

    return change(pages, selector, act, key)


def clone(pages: DataFrame, selector: str, deep: bool = True, key: str = "page_id") -> DataFrame:
    """Put a copy of every match right behind it; template content is copied too."""

    def act(root: Node, node: Node) -> None:
        after = node.parent.children[node.parent.index(node) + 1 :]
        node.parent.insert_before(node.clone(deep), after[0] if after else None)

    return change(pages, selector, act, key)


def prune(node_table: DataFrame, marked: DataFrame | str, key: str = "page_id") -> DataFrame:
    """The node table without the subtrees of marked nodes; numbers stay as they were.

    marked is a selector, which takes one pass over the table, or a table (key, tree_id,
    node_id, last_id). Intervals nest, so a running maximum over the marks is enough: no
    join, one shuffle.
    """
    if isinstance(marked, str):
        return flag_inside(node_table.repartition(key), marked, key, "_gone", itself=True).where("not _gone").drop("_gone")
    marks = marked.select(key, "tree_id", "node_id", F.col("last_id").alias("_reach"))
    both = node_table.withColumn("_reach", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key, "tree_id").orderBy("node_id", F.col("_reach").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.max("_reach").over(w) >= F.col("node_id"), F.lit(False))
    return both.withColumn("_gone", gone).where("_reach is null and not _gone").select(*node_table.columns)
