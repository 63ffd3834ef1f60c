"""The first matches of a page, without reading on once nothing can change them any more.

A candidate is judged when it is closed and the tree builder is in a calm state: no
formatting element, table, select or template open, and the body beyond
replacement by a frameset; and nothing so far was fostered or moved. From there on elements are only added behind it, so what it is,
where it stands and what it holds are final. Candidates are judged in document order, so a later
one waits for those that are still open before it. Pages that never get calm are parsed to the
end and searched as a whole.
"""

from __future__ import annotations

from itertools import islice

from sparkdom.html.dom import Node
from sparkdom.html.encoding import decode_html
from sparkdom.html.tokenizer import Tokenizer
from sparkdom.html.treebuilder import TreeBuilder
from sparkdom.plans.css import SelectorList, Simple
from sparkdom.plans.matcher import Matcher, find

UNSETTLED = frozenset("table select template tbody tfoot thead tr td th caption colgroup frameset".split())


def _names_root(compound: tuple[Simple, ...]) -> bool:
    """Whether a compound asks for attributes and may be meant for html or body, which get attributes late."""
    tag = next((s.name.lower() for s in compound if s.kind == "tag"), None)
    return tag in (None, "html", "body") and any(s.kind in ("id", "class", "attr") for s in compound)


def decidable(selector: SelectorList) -> bool:
    """Whether a closed element in a calm tree matches for good or never will."""
    for branch in selector.branches:
        for k, compound in enumerate(branch.compounds):
            subject = k == len(branch.compounds) - 1
            tag = next((s.name.lower() for s in compound if s.kind == "tag"), None)
            if any(s.kind == "pseudo" and s.inner is not None for s in compound):
                return False
            if subject and tag in (None, "html", "body", "selectedcontent") and not any(s.kind in ("id", "class") for s in compound):
                return False
            if not subject and _names_root(compound):
                return False
            if subject and tag in ("html", "body"):
                return False
    return True


class _Watcher(TreeBuilder):
    """Notes elements as they come that may be subjects."""

    def __init__(self, tags: frozenset[str] | None):
        super().__init__()
        self.tags, self.seen, self.made = tags, [], 0
        self.displaced = False  # something did not go to the end of the document

    def insert(self, node: Node) -> Node:
        if node.kind == "element":
            self.made += 1
            if self.tags is None or node.name.lower() in self.tags:
                self.seen.append(node)
        return super().insert(node)

    def put(self, node: Node, where: tuple[Node, int | None]) -> Node:
        self.displaced |= where[1] is not None
        return super().put(node, where)

    def adopt(self, name: str) -> None:
        self.displaced |= not self.is_open(name)  # may copy and move elements
        super().adopt(name)

    def calm(self) -> bool:
        # formatting elements that only wait to be opened anew change nothing that is there
        waiting = all(e is None or not any(n is e[0] for n in self.stack) for e in self.formatting)
        return waiting and not self.displaced and not self.templates and not self.saw_selectedcontent and all(n.ns == "html" and n.name not in UNSETTLED for n in self.stack)


def find_early(html: str | bytes | None, selector: SelectorList, limit: int = 1, encoding: str | None = None, statistics: dict[str, int] | None = None) -> list[Node]:
    """The first `limit` of what query() gives for the whole page. statistics gets the characters read and the elements made."""
    if isinstance(html, (bytes, bytearray, memoryview)):
        html, _ = decode_html(bytes(html), encoding)
    tags = [next((s.name.lower() for s in b.compounds[-1] if s.kind == "tag"), None) for b in selector.branches]
    builder = _Watcher(None if None in tags else frozenset(tags))
    tokenizer = Tokenizer(html or "", builder)
    found = _search(tokenizer, builder, selector, limit)
    if statistics is not None:
        statistics |= {"read": min(tokenizer.pos, len(tokenizer.text)), "made": builder.made}
    return found


def find_first(html: str | bytes | None, selector: SelectorList, encoding: str | None = None, statistics: dict[str, int] | None = None) -> Node | None:
    """What query_first() gives for the whole page."""
    return next(iter(find_early(html, selector, 1, encoding, statistics)), None)


def _search(tokenizer: Tokenizer, builder: _Watcher, selector: SelectorList, limit: int) -> list[Node]:
    found: list[Node] = []
    while tokenizer.step():
        if not builder.seen or tokenizer.pending or tokenizer.state != "data":
            continue
        if not builder.calm():
            continue
        matcher, judged = Matcher(), 0
        for node in builder.seen:
            if any(n is node for n in builder.stack):
                break  # still open, and those after it wait
            if (top := _top(node)).kind == "fragment" or builder.frameset_ok and not _in_head(node):
                break  # whether its template stays, or the body, is open
            judged += 1
            if top is builder.document and matcher.matches(node, selector):
                found.append(node)
                if len(found) == limit:
                    return found
        del builder.seen[:judged]
    return list(islice(find(builder.result(), selector), limit))


def _in_head(node: Node) -> bool:
    while node is not None:
        if node.name == "head":
            return True
        node = node.parent
    return False


def _top(node: Node) -> Node:
    while node.parent is not None:
        node = node.parent
    return node
