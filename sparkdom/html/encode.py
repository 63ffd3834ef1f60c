"""A parsed document as columns of rows: preorder numbers, intervals, places among siblings, slices of text and HTML."""

from __future__ import annotations

from sparkdom.html.constants import VOID
from sparkdom.html.dom import Node
from sparkdom.html.serialize import SerializeError, end_tag, leaf, start_tag
from sparkdom.plans.matcher import type_key

FIELDS = (
    "tree_id", "node_id", "last_id", "parent_id", "owner_id", "depth", "kind", "name", "ns", "attrs", "data", "doctype",
    "elem_pos", "elem_cnt", "type_pos", "type_cnt", "prev_elem_id", "is_empty", "text_from", "text_to", "html_from", "html_to",
)
#: What a node waits for on the stack.
ENTER, LEAVE, CONTENT, CLOSE = range(4)
NO_PLACE = (None, None, None, None, None)


class Columns:
    """One list per field, over the nodes of any number of pages."""

    def __init__(self):
        for f in FIELDS:
            setattr(self, f, [])

    def __len__(self) -> int:
        return len(self.node_id)

    def rows(self) -> list[dict]:
        return [dict(zip(FIELDS, r, strict=True)) for r in zip(*(getattr(self, f) for f in FIELDS), strict=True)]


def encode(root: Node) -> tuple[list[dict], list[str], str | None]:
    """Rows in preorder (children, then template content), the text of each tree, and the compact HTML (None if a doctype cannot be written)."""
    out = Columns()
    texts, html = encode_into(root, out)
    return out.rows(), texts, html


def encode_into(root: Node, out: Columns) -> tuple[list[str], str | None]:
    """Append the rows of one page; the texts of its trees, and its compact HTML."""
    base = len(out)
    texts: list[list[str]] = [[]]
    sizes = [0]
    html: list[str] = []
    at = 0
    fine = True
    tree_ids, node_ids, last_ids, parent_ids, owner_ids, depths = out.tree_id, out.node_id, out.last_id, out.parent_id, out.owner_id, out.depth
    kinds, names, spaces, attrs, datas, doctypes = out.kind, out.name, out.ns, out.attrs, out.data, out.doctype
    text_to, html_to = out.text_to, out.html_to
    # an explicit stack: documents can be deeper than Python's
    todo: list[tuple] = [(ENTER, root, None, None, None, 0, 0, NO_PLACE)]
    while todo:
        step, node, *rest = todo.pop()
        if step == ENTER:
            parent, parent_id, owner, depth, tree, place = rest
            number = len(node_ids) - base
            kind = node.kind
            tree_ids.append(tree)
            node_ids.append(number)
            last_ids.append(number)
            parent_ids.append(parent_id)
            owner_ids.append(owner)
            depths.append(depth)
            kinds.append(kind)
            names.append(node.name)
            spaces.append(node.ns)
            attrs.append(node.attrs)
            out.elem_pos.append(place[0])
            out.elem_cnt.append(place[1])
            out.type_pos.append(place[2])
            out.type_cnt.append(place[3])
            out.prev_elem_id.append(None if place[4] is None else place[4][0])
            if place[4] is not None:
                place[4][0] = number  # the next element among the siblings reads it
            out.text_from.append(sizes[tree])
            out.html_from.append(at)
            text_to.append(sizes[tree])
            html_to.append(at)
            children = node.children
            if kind in ("text", "comment", "doctype"):
                out.is_empty.append(True)
                datas.append(None if kind == "doctype" else node.data)
                doctypes.append(dict(zip(("name", "public_id", "system_id", "force_quirks"), node.data, strict=True)) if kind == "doctype" else None)
                if kind == "text":
                    texts[tree].append(node.data)
                    sizes[tree] += len(node.data)
                    text_to[-1] = sizes[tree]
                try:
                    piece = leaf(node, parent)
                    html.append(piece)
                    at += len(piece)
                except SerializeError:
                    fine = False
                html_to[-1] = at
                continue
            datas.append(None)
            doctypes.append(None)
            if kind == "element":
                piece = start_tag(node.name, node.attrs)
                html.append(piece)
                at += len(piece)
                if children is None or not children and node.content is None:
                    # no children: done at once
                    if not (node.ns in (None, "html") and node.name in VOID):
                        piece = end_tag(node.name)
                        html.append(piece)
                        at += len(piece)
                    html_to[-1] = at
                    out.is_empty.append(True)
                    continue
            if node.content is not None:
                todo += [(CLOSE, node, number), (LEAVE, node, number, tree), (CONTENT, node, number)]
            else:
                todo.append((LEAVE, node, number, tree))
            empty = True
            total: dict = {}
            elements, places = 0, []
            previous: list = [None]
            for c in children or ():
                if c.kind == "element" or c.kind == "doctype":
                    if c.kind == "element":
                        empty = False
                    elements += 1
                    key = type_key(c)
                    n = total[key] = total.get(key, 0) + 1
                    places.append((elements, key, n))
                else:
                    if c.kind == "text" and c.data:
                        empty = False
                    places.append(None)
            out.is_empty.append(empty)
            for k in range(len(places) - 1, -1, -1):
                p = places[k]
                todo.append((ENTER, children[k], node, number, None, depth + 1, tree, NO_PLACE if p is None else (p[0], elements, p[2], total[p[1]], previous)))
        elif step == LEAVE:
            number, tree = rest
            if node.content is None:
                last_ids[base + number] = len(node_ids) - base - 1
                if node.kind == "element":
                    piece = end_tag(node.name)
                    html.append(piece)
                    at += len(piece)
                html_to[base + number] = at
            text_to[base + number] = sizes[tree]
        elif step == CONTENT:
            (number,) = rest
            last_ids[base + number] = len(node_ids) - base - 1
            texts.append([])
            sizes.append(0)
            todo.append((ENTER, node.content, None, None, number, 0, len(texts) - 1, NO_PLACE))
        else:  # CLOSE: a template, once its content is out
            (number,) = rest
            piece = end_tag(node.name)
            html.append(piece)
            at += len(piece)
            html_to[base + number] = at
    return ["".join(t) for t in texts], "".join(html) if fine else None
