"""Pages to rows: the parse stage, and the node, tree, error and event tables that come out of it.

The stage is one narrow mapInArrow: no shuffle, one page in memory at a time. Catalyst does
not push filters or column choices below such a stage, so parse() takes the filter and
reads two columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdom import schema
from sparkdom.html.dom import Node
from sparkdom.html.encode import Columns, encode, encode_into
from sparkdom.html.parse import Document, StrictError, events, parse

#: Output rows are passed on once they stand for so many characters.
FLUSH_CHARS = 1 << 20


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def per_page(df: DataFrame, key: str, html: str, fn: Callable[[object, object], Iterator[tuple]], columns: str) -> DataFrame:
    """fn(page key, html) gives the rows of one page; they leave in batches of bounded size."""
    out = T._parse_datatype_string(f"`{key}` {kind_of(df, key)}, {columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for b in batches:
            for k, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = h.as_py()
                rows += [(k, *r) for r in fn(k, text)]
                size += len(text or "") + 1
                if size >= FLUSH_CHARS and rows:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return df.select(key, html).mapInArrow(run, out)


def _map(attrs: dict | None) -> list[tuple] | None:
    return None if attrs is None else list(attrs.items())


def page_rows(html: str | bytes | None, **options) -> Iterator[tuple]:
    """One page as a row of plain values."""
    doc = parse(html, **options)
    rows, texts, compact = encode(doc.root)
    for r in rows:
        r["attrs"] = _map(r["attrs"])
    yield doc.encoding, doc.quirks, compact, texts, rows, _errors(doc)


def _errors(doc: Document) -> list[dict]:
    return [dict(zip(("seq", "phase", "code", "line", "column"), (k, *e), strict=True)) for k, e in enumerate(doc.errors)]


class PageBatch:
    """Parsed pages on their way to Arrow, column by column: node rows are never put together in Python."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.keys, self.encodings, self.quirks, self.html, self.texts, self.errors, self.problems = [], [], [], [], [], [], []
        self.nodes, self.starts = Columns(), [0]
        #: Characters that the rows stand for: of a page as it came or as it leaves, whichever are more.
        self.size = 0

    def add(self, key, doc: Document, chars: int = 0, problem: str | None = None) -> None:
        self.put(key, doc.root, doc.encoding, doc.quirks, _errors(doc), chars, problem)

    def put(self, key, root: Node, encoding: str | None, quirks: str, errors: list[dict], chars: int = 0, problem: str | None = None) -> None:
        texts, html = encode_into(root, self.nodes)
        self.size += max(chars, sum(map(len, texts)) if html is None else len(html)) + 1
        self.problems.append(problem)
        self.keys.append(key)
        self.encodings.append(encoding)
        self.quirks.append(quirks)
        self.html.append(html)
        self.texts.append(texts)
        self.errors.append(errors)
        self.starts.append(len(self.nodes))

    def arrow(self) -> pa.RecordBatch:
        node = self.schema.field("nodes").type.value_type
        arrays = []
        for f in node:
            values = getattr(self.nodes, f.name)
            arrays.append(_map_array(values, f.type) if f.name == "attrs" else pa.array(values, f.type))
        nodes = pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(node)), type=self.schema.field("nodes").type)
        plain = {"encoding": self.encodings, "quirks": self.quirks, "html": self.html, "texts": self.texts, "errors": self.errors, "mutation_error": self.problems}
        return pa.RecordBatch.from_arrays([pa.array(self.keys, self.schema[0].type), *(nodes if f.name == "nodes" else pa.array(plain[f.name], f.type) for f in list(self.schema)[1:])], schema=self.schema)


def _map_array(values: list[dict | None], kind: pa.DataType) -> pa.Array:
    keys, items, starts = [], [], []
    for v in values:
        starts.append(None if v is None else len(keys))
        if v:
            keys += v
            items += v.values()
    return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()), type=kind)


def parse_pages(df: DataFrame, key: str = "page_id", html: str = "html", where: Column | None = None, context: tuple[str, str] | None = None, collect_errors: bool = False, strict: bool = False, encoding: str | None = None, tasks: int | None = None, **more) -> DataFrame:
    """One row per page: key, encoding, quirks, html (compact), texts by tree, nodes, errors.

    html may be text or bytes; null is an empty page. where is applied below the stage.
    tasks deals the pages out anew, for inputs of few large files. strict fails the query on
    the first parse error of any page. more: iframe_srcdoc, discard_bom, xml.
    """
    df = df if where is None else df.where(where)
    df = df if tasks is None else df.repartition(tasks)
    options = {"context": context, "collect_errors": collect_errors, "strict": strict, "encoding": encoding, **more}
    return Source(df.select(key, html), key, options).pages()


#: What is done with the root of a tree; the text is why it was left as it was.
Step = Callable[[Node], "str | None"]


@dataclass(frozen=True)
class Source:
    """Raw pages, how they are parsed, and what is done with each tree before it is written as rows."""

    raw: DataFrame
    key: str
    options: dict
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> DataFrame:
        return replace(self, steps=(*self.steps, step)).pages()

    def pages(self) -> DataFrame:
        options, steps = self.options, self.steps
        out = T._parse_datatype_string(f"`{self.key}` {kind_of(self.raw, self.key)}, {schema.PAGE}{', mutation_error string' if steps else ''}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return parsed_batches(batches, to_arrow_schema(out), options, steps)

        made = self.raw.mapInArrow(run, out)
        made._parsed_from = self
        return made


def parsed_batches(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, options: dict, steps: tuple[Step, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Batches of keys and pages to batches of parsed pages, of FLUSH_CHARS and one page at most."""
    made = PageBatch(arrow)
    for b in batches:
        for k, h in zip(b.column(0), b.column(1), strict=True):
            text = h.as_py()
            doc = parse(text, **options)
            problem = None
            for step in steps:  # what is seen is the problem of the last
                problem = step(doc.root)
            made.add(k.as_py(), doc, len(text or ""), problem)
            if made.size >= FLUSH_CHARS:
                yield made.arrow()
                made = PageBatch(arrow)
    if made.keys:
        yield made.arrow()


def source_of(pages: DataFrame, key: str) -> Source | None:
    """Where pages come from, if they are what parse_pages or a change gave, with nothing done since: then a further step can go into the same stage."""
    source = getattr(pages, "__dict__", {}).get("_parsed_from")
    return source if source is not None and source.key == key and not pages.is_cached else None


def nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per node, in query order by node_id."""
    return pages.select(key, F.inline("nodes"))


def owned_trees(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The root row of each template's content, with the template's name as `owner`.

    A node's number is its place in the page's array, so the join is a look-up.
    """
    rows = pages.select(key, F.col("nodes").alias("_all"), F.inline("nodes")).where("owner_id is not null")
    return rows.withColumn("owner", F.col("_all")[F.col("owner_id")]["name"]).drop("_all")


def trees(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per tree: its text, and on tree 0 the compact HTML."""
    rows = pages.select(key, F.posexplode("texts").alias("tree_id", "tree_text"), "html")
    return rows.withColumn("tree_html", F.when(F.col("tree_id") == 0, F.col("html"))).drop("html")


def errors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, F.inline("errors"))


def event_rows(html: str | bytes | None, encoding: str | None = None) -> Iterator[tuple]:
    for seq, (event, data, attrs) in enumerate(events(html, encoding)):
        name = data if event in ("start", "end") else None
        text = data if event in ("text", "comment") else None
        doctype = dict(zip(("name", "public_id", "system_id", "force_quirks"), data, strict=True)) if event == "doctype" else None
        yield seq, event, name, _map(attrs), text, doctype


def parse_events(df: DataFrame, key: str = "page_id", html: str = "html", encoding: str | None = None) -> DataFrame:
    """One row per token: start, end, text, comment, doctype, in order of seq. Void elements have a start only; no tree is built."""
    return per_page(df, key, html, lambda _, text: event_rows(text, encoding), schema.EVENT)


__all__ = ["StrictError", "errors", "nodes", "parse_events", "parse_pages", "per_page", "trees"]
