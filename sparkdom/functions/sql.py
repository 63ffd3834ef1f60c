"""Scalar functions and table functions over HTML text, for DataFrames and SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdom import schema
from sparkdom.html import encoding as enc
from sparkdom.html.dom import Node
from sparkdom.html.entities import decode, numeric
from sparkdom.html.markdown import to_markdown
from sparkdom.html.parse import parse
from sparkdom.html.serialize import SerializeError, to_html, to_test_format
from sparkdom.operators.parse import event_rows, page_rows
from sparkdom.operators.select import _project
from sparkdom.plans.css import parse_selector
from sparkdom.plans.matcher import first_n


def _each(fn: Callable):
    """An Arrow-batched function of one text column; null gives null."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    return run


def _guard(fn: Callable[[Node], str | None]) -> Callable[[str], str | None]:
    def run(text: str) -> str | None:
        try:
            return fn(parse(text).root)
        except SerializeError:
            return None

    return run


html_text = _each(_guard(lambda root: root.to_text()))
html_raw_text = _each(_guard(lambda root: root.inner_text()))
html_markdown = _each(_guard(to_markdown))
html_pretty = _each(_guard(lambda root: to_html(root, True)))
html_compact = _each(_guard(lambda root: to_html(root, False)))
html_test_format = _each(_guard(to_test_format))
html_decode_entities = _each(decode)
html_decode_entities_attr = _each(lambda text: decode(text, True))
normalize_label = _each(enc.normalize_label)
numeric_reference = _each(lambda n: numeric(int(n)))
decode_html = _each(lambda data: enc.decode_html(bytes(data))[0])
sniff_encoding = _each(lambda data: enc.sniff(bytes(data))[0])


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_select(html: pd.Series, css: pd.Series) -> pd.Series:
    """Normalized text of every match, in document order; a bad selector fails the query."""
    return pd.Series([None if h is None or c is None else [n.to_text() for n in first_n(parse(h).root, parse_selector(c), None)] for h, c in zip(html, css, strict=True)])


@F.pandas_udf(T.StringType())
def html_select_first(html: pd.Series, css: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or c is None else next((n.to_text() for n in first_n(parse(h).root, parse_selector(c), 1)), None) for h, c in zip(html, css, strict=True)])


class HtmlNodes:
    """SELECT ... FROM pages, LATERAL html_nodes(html)"""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is not None:
            for *_, rows, _errors in page_rows(html):
                for r in rows:
                    yield tuple(dict(v) if isinstance(v, list) else tuple(v.values()) if k == "doctype" and v else v for k, v in r.items())


class HtmlEvents:
    """SELECT ... FROM pages, LATERAL html_events(html)"""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is not None:
            for seq, event, name, attrs, text, doctype in event_rows(html):
                yield seq, event, name, None if attrs is None else dict(attrs), text, None if doctype is None else tuple(doctype.values())


class HtmlMatches:
    """SELECT ... FROM pages, LATERAL html_matches(html, 'css')"""

    def eval(self, html: str, css: str) -> Iterator[tuple]:
        if html is not None:
            for pos, node in enumerate(first_n(parse(html).root, parse_selector(css), None), 1):
                yield _project(node, pos, ("pos", "name", "text", "outer_html"))


SCALARS = {f: globals()[f] for f in ("html_text", "html_raw_text", "html_markdown", "html_pretty", "html_compact", "html_test_format", "html_decode_entities", "html_decode_entities_attr", "normalize_label", "numeric_reference", "decode_html", "sniff_encoding", "html_select", "html_select_first")}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL in this session. Rows of table functions leave in Arrow batches."""
    for name, fn in SCALARS.items():
        spark.udf.register(name, fn)
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType=T._parse_datatype_string(f"struct<{schema.NODE}>"), useArrow=True))
    spark.udtf.register("html_events", F.udtf(HtmlEvents, returnType=schema.EVENT, useArrow=True))
    spark.udtf.register("html_matches", F.udtf(HtmlMatches, returnType="pos int, name string, text string, outer_html string", useArrow=True))
