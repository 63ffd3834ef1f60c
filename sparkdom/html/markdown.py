"""Nodes to Markdown."""

from __future__ import annotations

import re

from sparkdom.html.constants import HEADINGS, words
from sparkdom.html.dom import Node
from sparkdom.html.serialize import compact

BLOCK = HEADINGS | words("p div section article header footer main nav aside blockquote pre ul ol li hr table")
MARKS = re.compile(r"([\\`*_\[\]])")
SPACES = re.compile(r"[\t\n\f\r ]+")
DESTINATION = {"\\": "\\\\", "(": "\\(", ")": "\\)", " ": "%20", "\t": "%09", "\n": "%0A", "\r": "%0D", "\f": "%0C"}
ESCAPED_DESTINATION = str.maketrans(DESTINATION)


class Writer:
    """Text so far, the line ends it closes with, and whether a space is due before the next word."""

    def __init__(self):
        self.parts: list[str] = []
        self.ends, self.space = 0, False

    def line_end(self) -> None:
        self.space = False
        if self.parts:
            self.parts[-1] = self.parts[-1].rstrip(" \t")
        self.parts.append("\n")
        self.ends = min(2, self.ends + 1)

    def at_least(self, ends: int) -> None:
        while self.ends < ends:
            self.line_end()

    def block(self, ends: int = 2) -> None:
        """Start a block: a blank line, unless it is the first."""
        if self.parts:
            self.at_least(ends)

    def raw(self, text: str) -> None:
        if not text:
            return
        if self.space and text[0] not in " \t\n\r\f" and self.parts and not self.ends:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)
        self.ends = min(2, len(text) - len(text.rstrip("\n")))

    def flow(self, text: str) -> None:
        """Text whose white space collapses."""
        for k, word in enumerate(SPACES.split(text)):
            if k:
                self.space = True
            if word:
                self.raw(word)

    def finish(self) -> str:
        return "".join(self.parts).strip(" \t\n")


def code_span(text: str) -> str:
    fence = "`" * (1 + max((len(x) for x in re.findall("`+", text)), default=0))
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def to_markdown(node: Node) -> str:
    out = Writer()
    _walk(node, out, False, 0)
    return out.finish()


def _children(node: Node, out: Writer, keep: bool, depth: int) -> None:
    for c in node.children or ():
        _walk(c, out, keep, depth)


def _walk(node: Node, out: Writer, keep: bool, depth: int) -> None:
    if node.kind == "text":
        out.raw(node.data) if keep else out.flow(MARKS.sub(r"\\\1", node.data))
        return
    if node.kind in ("comment", "doctype"):
        return
    if node.kind != "element":
        _children(node, out, keep, depth)
        return
    tag = node.name.lower()
    if tag == "br":
        out.line_end()
    elif tag == "img":
        out.raw(compact(node))
    elif tag == "code" and not keep:
        out.raw(code_span(node.inner_text()))
    elif tag in ("em", "i", "strong", "b"):
        mark = "*" if tag in ("em", "i") else "**"
        out.raw(mark)
        _children(node, out, False, depth)
        out.raw(mark)
    elif tag == "a":
        out.raw("[")
        _children(node, out, False, depth)
        out.raw("]")
        if href := node.attrs.get("href"):
            out.raw(f"({href.translate(ESCAPED_DESTINATION)})")
    elif tag in ("ul", "ol"):
        out.block(1 if depth else 2)
        _list(node, out, tag == "ol", depth)
        out.at_least(1 if depth else 2)
    elif tag in BLOCK and tag in ("p", "table", "hr", "pre", "blockquote") or tag in HEADINGS:
        out.block()
        if tag == "p":
            _children(node, out, False, depth)
        elif tag == "table":
            out.raw(compact(node))
        elif tag == "hr":
            out.raw("---")
        elif tag == "pre":
            code = node.inner_text()
            out.raw("```")
            out.line_end()
            if code:
                out.raw(code.rstrip("\n"))
                out.line_end()
            out.raw("```")
        elif tag == "blockquote":
            inner = Writer()
            _children(node, inner, False, depth)
            _quote(inner.finish(), out)
        else:
            out.raw("#" * int(tag[1]) + " ")
            _children(node, out, False, depth)
        out.at_least(2)
    else:
        keep = keep or tag in ("textarea", "script", "style")
        _children(node, out, keep, depth)
        if node.content is not None:
            _children(node.content, out, keep, depth)
        if tag in BLOCK:
            out.at_least(2)


def _quote(text: str, out: Writer) -> None:
    for k, line in enumerate(text.split("\n") if text else ()):
        if k:
            out.line_end()
        out.raw("> ")
        out.raw(line)


def _list(node: Node, out: Writer, ordered: bool, depth: int) -> None:
    items = [c for c in node.children or () if c.name.lower() == "li"]
    for n, item in enumerate(items, 1):
        if n > 1:
            out.line_end()
        inner = Writer()
        for c in item.children or ():
            _walk(c, inner, False, depth + 1)
        marker = f"{n}. " if ordered else "- "
        for k, line in enumerate(inner.finish().split("\n")):
            if k:
                out.line_end()
            if line or not k:
                out.raw(" " * len(marker) if k else marker)
                out.raw(line)
