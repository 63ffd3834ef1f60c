"""Nodes back to HTML, and to the dump that tree-construction tests use."""

from __future__ import annotations

import re

from sparkdom.html.constants import FOREIGN_ATTRS, RAW_TEXT, VOID, words
from sparkdom.html.dom import Node

#: Elements whose children may stand on lines of their own.
PRETTY = words(
    "address article aside blockquote body caption colgroup dd details dialog div dl dt fieldset figcaption figure footer form head header hgroup html li main menu nav noframes noscript ol search section table tbody td template tfoot th thead tr ul"
)
#: Elements around which a line break changes no text.
BLOCK = PRETTY | words("base basefont bgsound col dir h1 h2 h3 h4 h5 h6 hr legend link meta p pre script style summary title xmp")
NEEDS_QUOTES = re.compile("[\t\n\f\r \"'=>]")
ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})


class SerializeError(ValueError):
    pass


def escape(text: str) -> str:
    return text.translate(ESCAPES)


def start_tag(name: str, attrs: dict[str, str | None] | None) -> str:
    out = [name]
    for k, v in (attrs or {}).items():
        if not v:
            out.append(k)
            continue
        v = v.replace("&", "&amp;")
        if not NEEDS_QUOTES.search(v):
            out.append(f"{k}={v}")
        elif '"' in v and "'" not in v:
            out.append(f"{k}='{v}'")
        else:
            out.append(k + '="' + v.replace('"', "&quot;") + '"')
    return f"<{' '.join(out)}>"


def end_tag(name: str) -> str:
    return f"</{name}>"


def _quoted(value: str) -> str:
    if '"' in value and "'" in value:
        raise SerializeError("a doctype identifier holds both kinds of quotes")
    return f"'{value}'" if '"' in value else f'"{value}"'


def doctype(data: tuple | None) -> str:
    name, public, system = (data or ("html", None, None, False))[:3]
    keyword = " PUBLIC" if public is not None else " SYSTEM" if system is not None else ""
    ids = "".join(f" {_quoted(x)}" for x in (public, system) if x is not None)
    return f"<!DOCTYPE {'html' if name is None else name}{keyword}{ids}>"


def is_html(node: Node | None) -> bool:
    return node is not None and node.ns in (None, "html")


def leaf(node: Node, parent: Node | None) -> str:
    if node.kind == "text":
        return node.data if parent is not None and parent.kind == "element" and is_html(parent) and parent.name in RAW_TEXT else escape(node.data)
    return f"<!--{node.data}-->" if node.kind == "comment" else doctype(node.data)


def inside(node: Node) -> list[Node]:
    """What is written between the tags."""
    return node.content.children if node.content is not None else node.children or []


def compact(node: Node) -> str:
    out: list[str] = []
    todo: list = [(node, None)]
    while todo:
        at, parent = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif at.kind in ("text", "comment", "doctype"):
            out.append(leaf(at, parent))
        else:
            if at.kind == "element":
                out.append(start_tag(at.name, at.attrs))
                if is_html(at) and at.name in VOID:
                    continue
                todo.append((end_tag(at.name), None))
            todo.extend((c, at) for c in reversed(inside(at)))
    return "".join(out)


def _blank(node: Node) -> bool:
    return node.kind == "text" and not node.data.strip("\t\n\f\r ")


def _can_format(children: list[Node]) -> bool:
    structural = False
    for c in children:
        if c.kind in ("comment", "doctype") or c.kind == "element" and is_html(c) and c.name in BLOCK:
            structural = True
        elif not _blank(c):
            return False
    return structural


def pretty(node: Node, indent: int = 0, size: int = 2) -> str:
    lines: list[str] = []
    _lines(node, indent, size, None, lines)
    return "\n".join(lines)


def _lines(node: Node, indent: int, size: int, parent: Node | None, out: list[str]) -> None:
    pad = " " * (indent * size)
    if node.kind in ("document", "fragment"):
        if not _can_format(node.children):
            out.append(compact(node))
            return
        for c in node.children:
            if not _blank(c):
                _lines(c, indent, size, None, out)
        return
    if node.kind != "element":
        out.append(pad + leaf(node, parent))
        return
    children = inside(node)
    if not (is_html(node) and node.name in PRETTY and _can_format(children)):
        out.append(pad + compact(node))
        return
    out.append(pad + start_tag(node.name, node.attrs))
    for c in children:
        if not _blank(c):
            _lines(c, indent + 1, size, node, out)
    out.append(pad + end_tag(node.name))


def to_html(node: Node, pretty_print: bool = True, indent: int = 0, size: int = 2) -> str:
    return pretty(node, indent, size) if pretty_print else compact(node)


def to_test_format(node: Node, indent: int = 0) -> str:
    lines: list[str] = []
    _dump(node, indent, lines)
    return "\n".join(lines)


def _dump(node: Node, indent: int, out: list[str]) -> None:
    if node.kind in ("document", "fragment"):
        for c in node.children:
            _dump(c, 0, out)
        return
    pad = "| " + " " * indent
    if node.kind == "comment":
        out.append(f"{pad}<!-- {node.data} -->")
    elif node.kind == "text":
        out.append(f'{pad}"{node.data}"')
    elif node.kind == "doctype":
        name, public, system = node.data[:3]
        ids = f' "{public or ""}" "{system or ""}"' if public is not None or system is not None else ""
        out.append(f"| <!DOCTYPE {name or ''}{ids}>")
    else:
        out.append(f"{pad}<{node.name if is_html(node) else f'{node.ns} {node.name}'}>")
        shown = {(k.replace(":", " ") if not is_html(node) and k.lower() in FOREIGN_ATTRS else k): v or "" for k, v in (node.attrs or {}).items()}
        out += [f'{pad}  {k}="{v}"' for k, v in sorted(shown.items(), key=lambda x: x[0].encode())]
        if node.content is not None:
            out.append(f"{pad}  content")
        for c in node.content.children if node.content is not None else node.children or ():
            _dump(c, indent + (4 if node.content is not None else 2), out)
