"""Selectors against nodes in memory: what the fused operators and single documents use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from sparkdom.html.dom import Node
from sparkdom.html.tokenizer import ascii_lower
from sparkdom.plans.css import Complex, SelectorList, Simple, parse_selector

WORDS = re.compile(r"[\t\n\x0b\f\r ]+")


def is_element(node: Node) -> bool:
    """Doctypes count: they have no # in front of their name."""
    return node.kind in ("element", "doctype")


def compare(op: str, have: str | None, want: str) -> bool:
    have = have or ""
    if op == "=":
        return have == want
    if op == "|=":
        return have == want or have.startswith(want + "-")
    if not want:
        return False
    if op == "~=":
        return want in WORDS.split(have)
    return have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have


def type_key(node: Node) -> tuple[str, str]:
    ns = node.ns or "html"
    return ns, ascii_lower(node.name) if ns == "html" else node.name


def nth_holds(a: int, b: int, p: int) -> bool:
    return p == b if a == 0 else (p - b) % a == 0 and (p - b) // a >= 0


class Matcher:
    """Keeps, for each parent it met, the place of its children; good while the tree stays as it is."""

    def __init__(self):
        self.places: dict[int, tuple[Node, dict[int, tuple[int, int, int, int, Node | None]]]] = {}

    def place(self, node: Node) -> tuple[int, int, int, int, Node | None] | None:
        """Position and count among elements, the same within its type, and the element before."""
        parent = node.parent
        if parent is None:
            return None
        got = self.places.get(id(parent))
        if got is None:
            siblings = [c for c in parent.children if is_element(c)]
            total: dict[tuple[str, str], int] = {}
            at: list[tuple[tuple[str, str], int]] = []
            for c in siblings:
                key = type_key(c)
                total[key] = total.get(key, 0) + 1
                at.append((key, total[key]))
            rows = {id(c): (k + 1, len(siblings), n, total[key], siblings[k - 1] if k else None) for k, (c, (key, n)) in enumerate(zip(siblings, at, strict=True))}
            self.places[id(parent)] = got = (parent, rows)
        return got[1].get(id(node))

    def matches(self, node: Node, selector: SelectorList) -> bool:
        return any(self.complex(node, c) for c in selector.branches)

    def complex(self, node: Node, c: Complex) -> bool:
        return self._from(node, c, len(c.compounds) - 1)

    def _from(self, node: Node, c: Complex, k: int) -> bool:
        if not self.compound(node, c.compounds[k]):
            return False
        if k == 0:
            return True
        how = c.combinators[k - 1]
        if how == ">":
            return node.parent is not None and self._from(node.parent, c, k - 1)
        if how == " ":
            up = node.parent
            while up is not None:
                if self._from(up, c, k - 1):
                    return True
                up = up.parent
            return False
        before = (self.place(node) or (0, 0, 0, 0, None))[4]
        while before is not None:
            if self._from(before, c, k - 1):
                return True
            if how == "+":
                return False
            before = self.place(before)[4]
        return False

    def compound(self, node: Node, simples: tuple[Simple, ...]) -> bool:
        return is_element(node) and all(self.simple(node, s) for s in simples)

    def simple(self, node: Node, s: Simple) -> bool:
        attrs = node.attrs or {}
        kind = s.kind
        if kind == "any":
            return True
        if kind == "tag":
            return ascii_lower(node.name) == ascii_lower(s.name) if node.ns in (None, "html") else node.name == s.name
        if kind == "id":
            return attrs.get("id") == s.value
        if kind == "class":
            return bool(attrs.get("class")) and s.value in WORDS.split(attrs["class"])
        if kind == "attr":
            name = ascii_lower(s.name) if node.ns in (None, "html") else s.name
            return name in attrs and (not s.op or compare(s.op, attrs[name], s.value))
        return self.pseudo(node, s)

    def pseudo(self, node: Node, s: Simple) -> bool:
        name = s.name
        if name == "not":
            return not self.matches(node, s.inner)
        if name == "root":
            return node.parent is not None and node.parent.kind in ("document", "fragment")
        if name == "empty":
            return not any(c.kind == "element" or c.kind == "text" and c.data for c in node.children or ())
        place = self.place(node)
        if place is None:
            return False
        p, n, tp, tn, _ = place
        if "of-type" in name:
            p, n = tp, tn
        if s.nth is not None:
            return nth_holds(*s.nth, p)
        return (p == 1 or name.startswith("last")) and (p == n or name.startswith("first"))


def find(root: Node, selector: str | SelectorList) -> Iterator[Node]:
    """Descendants of root that match, in document order; ancestors above root count."""
    parsed = parse_selector(selector) if isinstance(selector, str) else selector
    matcher = Matcher()
    for node in root.walk():
        if is_element(node) and matcher.matches(node, parsed):
            yield node


def query(root: Node, selector: str) -> list[Node]:
    return list(find(root, selector))


def query_first(root: Node, selector: str) -> Node | None:
    return next(find(root, selector), None)


def first_n(root: Node, selector: str | SelectorList, n: int | None) -> list[Node]:
    return list(find(root, selector) if n is None else islice(find(root, selector), n))


def matches(node: Node, selector: str) -> bool:
    return Matcher().matches(node, parse_selector(selector))
