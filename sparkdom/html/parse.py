"""Whole documents, fragments and event streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from sparkdom.html import constants as C
from sparkdom.html.dom import Node
from sparkdom.html.encoding import decode_html
from sparkdom.html.tokenizer import Tokenizer
from sparkdom.html.treebuilder import CONTENT_MODEL, TreeBuilder


class StrictError(ValueError):
    """Raised by strict parsing, with the first parse error."""

    def __init__(self, code: str, line: int, column: int):
        super().__init__(f"{code} at {line}:{column}")
        self.code, self.line, self.column = code, line, column


@dataclass
class Document:
    root: Node
    quirks: str = "no-quirks"
    encoding: str | None = None
    #: (phase, code, line, column): what the tokenizer found, then what the tree builder found.
    errors: list[tuple[str, str, int, int]] = field(default_factory=list)


def parse(html: str | bytes | None, context: tuple[str, str] | None = None, collect_errors: bool = False, strict: bool = False, encoding: str | None = None, iframe_srcdoc: bool = False, discard_bom: bool = True, xml: bool = False, tree_builder: type[TreeBuilder] = TreeBuilder) -> Document:
    """context: (name, namespace) of the element that a fragment is parsed for. tree_builder: a class of one's own, which the tokens go to."""
    chosen = None
    if isinstance(html, (bytes, bytearray, memoryview)):
        html, chosen = decode_html(bytes(html), encoding)
    collect = collect_errors or strict
    lexical, structural = ([], []) if collect else (None, None)
    builder = tree_builder(context, structural, iframe_srcdoc=iframe_srcdoc)
    tokenizer = Tokenizer(html or "", builder, lexical, builder.initial_state(), context[0] if context else "", discard_bom, xml)
    builder.place = lambda: tokenizer.place(tokenizer.pos - 1)
    tokenizer.run()
    errors = [("tokenizer", *e) for e in lexical or ()] + [("tree", *e) for e in structural or ()]
    if strict and errors:
        raise StrictError(*errors[0][1:])
    return Document(builder.result(), builder.quirks, chosen, errors if collect else [])


def tokenize(html: str | bytes | None, sink, encoding: str | None = None, errors: list | None = None, state: str = "data", last_tag: str = "", discard_bom: bool = True, xml: bool = False) -> str | None:
    """Pass the tokens to a sink: an object with start, end, chars, comment, doctype, eof and foreign, as EventSink has them.

    start may name the state that the content of the element is in. The encoding chosen for bytes is returned.
    """
    chosen = None
    if isinstance(html, (bytes, bytearray, memoryview)):
        html, chosen = decode_html(bytes(html), encoding)
    Tokenizer(html or "", sink, errors, state, last_tag, discard_bom, xml).run()
    return chosen


class EventSink:
    """Tokens as events, with enough of a stack to know where foreign content is."""

    def __init__(self):
        self.events: list[tuple] = []
        self.stack: list[tuple[str, str, dict]] = []

    @staticmethod
    def _point(entry: tuple[str, str, dict]) -> bool:
        name, ns, attrs = entry
        if ns == "svg":
            return name in ("foreignobject", "desc", "title")
        return ns == "math" and (name in C.MATH_TEXT or name == "annotation-xml" and attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"))

    def foreign(self) -> bool:
        return bool(self.stack) and self.stack[-1][1] != "html"

    def start(self, name: str, attrs: dict[str, str], self_closing: bool) -> str | None:
        self.events.append(("start", name, attrs))
        inside = self.stack[-1] if self.stack else ("", "html", {})
        breaks = name in C.BREAKOUT or name == "font" and not attrs.keys().isdisjoint(("color", "face", "size"))
        if inside[1] != "html" and not self._point(inside) and breaks:
            while self.stack and self.stack[-1][1] != "html" and not self._point(self.stack[-1]):
                self.stack.pop()
            inside = self.stack[-1] if self.stack else ("", "html", {})
        if inside[1] != "html" and not (self._point(inside) and not (inside[1] == "math" and inside[0] in C.MATH_TEXT and name in ("mglyph", "malignmark"))):
            ns = "svg" if name == "svg" else inside[1]
        else:
            ns = name if name in ("svg", "math") else "html"
        if ns == "html":
            if name not in C.VOID:
                self.stack.append((name, ns, attrs))
            return CONTENT_MODEL.get(name)
        if not self_closing:
            self.stack.append((name, ns, attrs))
        return None

    def end(self, name: str) -> None:
        self.events.append(("end", name, None))
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return
            if self._point(self.stack[k]):
                return

    def chars(self, text: str) -> None:
        self.events.append(("text", text, None))

    def comment(self, data: str) -> None:
        self.events.append(("comment", data, None))

    def doctype(self, *data) -> None:
        self.events.append(("doctype", data, None))

    def eof(self) -> None:
        pass


def events(html: str | bytes | None, encoding: str | None = None):
    """(event, data, attributes) one after the other; the tokenizer reads no further than asked."""
    if isinstance(html, (bytes, bytearray, memoryview)):
        html, _ = decode_html(bytes(html), encoding)
    sink = EventSink()
    tokenizer = Tokenizer(html or "", sink)
    more = True
    while more:
        more = tokenizer.step()
        yield from sink.events
        sink.events = []
