"""Nodes of a parsed document."""

from __future__ import annotations

from collections.abc import Iterator

from sparkdom.html.constants import VOID


class HierarchyError(ValueError):
    """A tree operation that would not leave a tree; nothing is changed when it is raised."""


class Node:
    """kind: document, fragment, element, text, comment or doctype. data: text, or (name, public id, system id, force quirks)."""

    __slots__ = ("kind", "name", "ns", "attrs", "data", "parent", "children", "content")

    def __init__(self, kind: str, name: str, ns: str | None = None, attrs: dict[str, str | None] | None = None, data=None):
        self.kind, self.name, self.ns, self.attrs, self.data = kind, name, ns, attrs, data
        self.parent: Node | None = None
        leaf = kind in ("text", "comment", "doctype") or kind == "element" and ns == "html" and name in VOID
        self.children: list[Node] | None = None if leaf else []
        self.content: Node | None = None

    @classmethod
    def element(cls, name: str, attrs: dict[str, str | None] | None = None, ns: str = "html") -> Node:
        node = cls("element", name, ns, {} if attrs is None else attrs)
        if name == "template" and ns == "html":
            node.content = cls("fragment", "#document-fragment")
        return node

    @classmethod
    def text(cls, data: str) -> Node:
        return cls("text", "#text", data=data)

    # --- reading

    def walk(self) -> Iterator[Node]:
        """Descendants in query order: children depth first, then template content."""
        stack = [iter(self.children or ())]
        if self.content is not None:
            stack.insert(0, iter(self.content.children))
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            yield node
            if node.content is not None:
                stack.append(iter(node.content.children))
            if node.children:
                stack.append(iter(node.children))

    def inner_text(self) -> str:
        """Text of the descendants, comments and template content apart."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.kind == "text":
                parts.append(node.data)
            elif node.children:
                stack.extend(reversed(node.children))
        return "".join(parts)

    @property
    def text_content(self) -> str | None:
        if self.kind in ("text", "comment"):
            return self.data
        return None if self.kind in ("document", "doctype") else self.inner_text()

    def to_text(self) -> str:
        raw = self.data if self.kind in ("text", "comment") else "" if self.kind == "doctype" else self.inner_text()
        return collapse(raw)

    def has_child_nodes(self) -> bool:
        return bool(self.children)

    # --- changing

    def _admit(self, node: Node) -> None:
        if self.children is None:
            raise HierarchyError(f"{self.name} takes no children")
        at: Node | None = self
        while at is not None:
            if at is node:
                raise HierarchyError("a node cannot be put below itself")
            at = at.parent

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def append_child(self, node: Node) -> Node:
        self._admit(node)
        node.detach()
        node.parent = self
        self.children.append(node)
        return node

    def remove_child(self, node: Node) -> Node:
        if node.parent is not self:
            raise HierarchyError("not a child of this node")
        node.detach()
        return node

    def insert_before(self, node: Node, reference: Node | None) -> Node:
        if reference is None:
            return self.append_child(node)
        if reference.parent is not self:
            raise HierarchyError("the reference is not a child of this node")
        self._admit(node)
        if node is not reference:
            node.detach()
            node.parent = self
            self.children.insert(self.index(reference), node)
        return node

    def replace_child(self, new: Node, old: Node) -> Node:
        if old.parent is not self:
            raise HierarchyError("not a child of this node")
        self._admit(new)
        if new is not old:
            new.detach()
            self.children[self.index(old)] = new
            new.parent, old.parent = self, None
        return old

    def index(self, child: Node) -> int:
        return next(i for i, c in enumerate(self.children) if c is child)

    def clone(self, deep: bool = False) -> Node:
        out = Node(self.kind, self.name, self.ns, None if self.attrs is None else dict(self.attrs), self.data)
        if self.content is not None:
            out.content = self.content.clone(deep)
        if deep:
            for c in self.children or ():
                copy = c.clone(True)
                copy.parent = out
                out.children.append(copy)
        return out


def collapse(text: str) -> str:
    """ASCII white space to single spaces, none at the ends."""
    return " ".join(x for x in text.translate(_SPACES).split(" ") if x)


_SPACES = {9: " ", 10: " ", 12: " ", 13: " "}
