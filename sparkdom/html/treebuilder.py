"""Tokens to a tree, by the insertion modes of the HTML standard."""

from __future__ import annotations

import re

from sparkdom.html import constants as C
from sparkdom.html.dom import Node

LEADING = re.compile(r"[\t\n\f\r ]*")
CONTENT_MODEL = {"title": "rcdata", "textarea": "rcdata", "style": "rawtext", "xmp": "rawtext", "iframe": "rawtext", "noembed": "rawtext", "noframes": "rawtext", "script": "script", "plaintext": "plaintext"}
#: Tags that selects may hold besides options: the customizable select of the standard's draft.
IN_SELECT = C.words("p div span button datalist selectedcontent")
MARKER = None


class TreeBuilder:
    """Sink of a Tokenizer; `document` is the result."""

    def __init__(self, context: tuple[str, str] | None = None, errors: list | None = None, place=None, iframe_srcdoc: bool = False, selectedcontent: bool = True):
        self.document = Node("document", "#document")
        self.stack: list[Node] = []
        self.formatting: list[tuple[Node, tuple] | None] = []
        self.templates: list[str] = []
        self.mode = self.back = "initial"
        self.head: Node | None = None
        self.form: Node | None = None
        self.quirks = "no-quirks"
        self.frameset_ok = True
        self.foster = False
        self.skip_newline = False
        self.errors, self.place = errors, place
        self.srcdoc, self.fill_selected = iframe_srcdoc, selectedcontent
        self.saw_selectedcontent = False
        self.context: Node | None = None
        if context is not None:
            self._begin_fragment(*context)

    def _begin_fragment(self, name: str, ns: str) -> None:
        self.context = Node.element(name, None, ns)
        root = self.document.append_child(Node.element("html"))
        self.stack.append(root)
        if ns == "html" and name == "template":
            self.templates.append("in_template")
        self.reset_mode()
        self.frameset_ok = False

    def initial_state(self) -> str:
        return CONTENT_MODEL.get(self.context.name, "data") if self.context is not None and self.context.ns == "html" else "data"

    def error(self, code: str) -> None:
        if self.errors is not None:
            self.errors.append((code, *self.place()))

    # --- what the tokenizer calls

    def foreign(self) -> bool:
        node = self.adjusted()
        return node is not None and node.ns != "html"

    def start(self, name: str, attrs: dict[str, str], self_closing: bool) -> str | None:
        self.skip_newline = False
        before = len(self.stack)
        top = self.stack[-1] if self.stack else None
        self.acknowledged = False
        self._start(name, attrs, self_closing)
        if self_closing and not self.acknowledged:
            self.error("non-void-html-element-start-tag-with-trailing-solidus")
        model = CONTENT_MODEL.get(name)
        if model and self.stack and (len(self.stack) != before or self.stack[-1] is not top):
            new = self.stack[-1]
            if new.ns == "html" and new.name == name and not new.children:
                return model
        return None

    def _start(self, name: str, attrs: dict[str, str], self_closing: bool) -> None:
        if self._foreign_start(name):
            self.foreign_start(name, attrs, self_closing)
        else:
            getattr(self, "start_" + self.mode)(name, attrs, self_closing)

    def end(self, name: str) -> None:
        self.skip_newline = False
        if self.stack and (node := self.adjusted()) is not None and node.ns != "html":
            self.foreign_end(name)
        else:
            getattr(self, "end_" + self.mode)(name)

    def chars(self, text: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if text[0] == "\n":
                text = text[1:]
                if not text:
                    return
        node = self.adjusted()
        if node is not None and node.ns != "html" and not (node.ns == "math" and node.name in C.MATH_TEXT) and not self.html_point(node):
            self.foreign_chars(text)
        else:
            getattr(self, "chars_" + self.mode)(text)

    def comment(self, data: str) -> None:
        self.skip_newline = False
        node = Node("comment", "#comment", data=data)
        if self.mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self.document.append_child(node)
        elif self.mode == "after_body":
            self.stack[0].append_child(node)
        else:
            self.insert(node)

    def doctype(self, name: str | None, public: str | None, system: str | None, force: bool) -> None:
        self.skip_newline = False
        if self.mode != "initial":
            self.error("unexpected-doctype")
            return
        self.document.append_child(Node("doctype", "!doctype", data=(name, public, system, force)))
        p, s = (public or "").lower(), (system or "").lower()
        if not self.srcdoc:
            if force or name != "html" or p in C.QUIRKY_PUBLIC or s == C.QUIRKY_SYSTEM or p.startswith(C.QUIRKY_PREFIXES) or system is None and p.startswith(C.HTML4_TRANSITIONAL):
                self.quirks = "quirks"
            elif p.startswith(C.XHTML1_TRANSITIONAL) or system is not None and p.startswith(C.HTML4_TRANSITIONAL):
                self.quirks = "limited-quirks"
        self.mode = "before_html"

    def eof(self) -> None:
        if self.mode == "text":
            self.error("expected-named-closing-tag-but-got-eof")
            self.stack.pop()
            self.mode = self.back
        if self.mode == "initial" and not self.srcdoc:
            self.error("expected-doctype-but-got-eof")
            self.quirks = "quirks"
        while self.mode in ("initial", "before_html", "before_head", "in_head_noscript", "in_head", "after_head"):
            if self.mode == "in_head_noscript":
                self.stack.pop()
                self.mode = "in_head"
            else:
                self._imply()
        fine = C.IMPLIED_END | {"tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
        if any(n.name not in fine for n in self.stack):
            self.error("expected-closing-tag-but-got-eof")
        while self.templates:
            if not any(n.name == "template" and n.ns == "html" for n in self.stack):
                break
            self.error("expected-closing-tag-but-got-eof")
            self.pop_until("template")
            self.clear_formatting()
            self.templates.pop()
            self.reset_mode()
        if self.saw_selectedcontent and self.fill_selected:
            self._fill_selectedcontent()

    def result(self) -> Node:
        """The document, or for a fragment what the root element holds."""
        if self.context is None:
            return self.document
        out = Node("fragment", "#document-fragment")
        out.children = list(self.document.children[0].children)
        for c in out.children:
            c.parent = out
        return out

    # --- the stack of open elements

    def adjusted(self) -> Node | None:
        if self.context is not None and len(self.stack) == 1:
            return self.context
        return self.stack[-1] if self.stack else None

    def is_open(self, *names: str) -> bool:
        return bool(self.stack) and self.stack[-1].name in names and self.stack[-1].ns == "html"

    def in_scope(self, names, boundary=C.DEFAULT_SCOPE) -> bool:
        names = (names,) if isinstance(names, str) else names
        for node in reversed(self.stack):
            if node.ns == "html":
                if node.name in names:
                    return True
                if node.name in boundary:
                    return False
            elif boundary is not C.TABLE_SCOPE and (node.name in C.MATH_SPECIAL if node.ns == "math" else node.name in C.SVG_HTML):
                return False
        return False

    def pop_until(self, *names: str) -> None:
        while self.stack:
            node = self.stack.pop()
            if node.ns == "html" and node.name in names:
                return

    def clear_to(self, names) -> None:
        while self.stack and not (self.stack[-1].ns == "html" and self.stack[-1].name in names):
            self.stack.pop()

    def imply_ends(self, besides: str = "", thorough: bool = False) -> None:
        names = C.IMPLIED_END_THOROUGH if thorough else C.IMPLIED_END
        while self.stack and self.stack[-1].ns == "html" and self.stack[-1].name in names and self.stack[-1].name != besides:
            self.stack.pop()

    def close(self, name: str) -> None:
        """Implied end tags, then up to the named element."""
        self.imply_ends(name)
        if not self.is_open(name):
            self.error("end-tag-too-early")
        self.pop_until(name)

    def close_p(self) -> None:
        if self.in_scope("p", C.BUTTON_SCOPE):
            self.close("p")

    def find_open(self, name: str) -> Node | None:
        return next((n for n in reversed(self.stack) if n.name == name and n.ns == "html"), None)

    # --- insertion

    def location(self, target: Node | None = None) -> tuple[Node, int | None]:
        """Where a node goes: its parent, and the index there (None: at the end)."""
        target = target or self.stack[-1]
        if self.foster and target.ns == "html" and target.name in C.FOSTER:
            for k in range(len(self.stack) - 1, -1, -1):
                node = self.stack[k]
                if node.ns != "html":
                    continue
                if node.name == "template":
                    return node.content, None
                if node.name == "table":
                    if node.parent is not None:
                        return node.parent, node.parent.index(node)
                    target = self.stack[k - 1]
                    break
            else:
                target = self.stack[0]
        return (target.content if target.content is not None else target), None

    def put(self, node: Node, where: tuple[Node, int | None]) -> Node:
        parent, at = where
        node.parent = parent
        if at is None:
            parent.children.append(node)
        else:
            parent.children.insert(at, node)
        return node

    def insert(self, node: Node) -> Node:
        return self.put(node, self.location())

    def insert_text(self, text: str) -> None:
        parent, at = self.location()
        if parent.kind == "document":
            return
        before = parent.children[-1 if at is None else at - 1] if parent.children and at != 0 else None
        if before is not None and before.kind == "text":
            before.data += text
        else:
            self.put(Node.text(text), (parent, at))

    def open(self, name: str, attrs: dict[str, str] | None = None, ns: str = "html") -> Node:
        node = self.insert(Node.element(name, attrs, ns))
        self.stack.append(node)
        if name == "selectedcontent":
            self.saw_selectedcontent = True
        return node

    def void(self, name: str, attrs: dict[str, str], ns: str = "html") -> Node:
        self.acknowledged = True
        return self.insert(Node.element(name, attrs, ns))

    # --- active formatting elements

    def push_formatting(self, node: Node) -> None:
        same, key = 0, (node.name, tuple(sorted(node.attrs.items())))
        for k in range(len(self.formatting) - 1, -1, -1):
            entry = self.formatting[k]
            if entry is MARKER:
                break
            if entry[1] == key:
                same += 1
                if same == 3:
                    del self.formatting[k]
                    break
        self.formatting.append((node, key))

    def reconstruct(self) -> None:
        items = self.formatting
        if not items or items[-1] is MARKER or items[-1][0] in self.stack:
            return
        k = len(items) - 1
        while k > 0 and items[k - 1] is not MARKER and items[k - 1][0] not in self.stack:
            k -= 1
        for j in range(k, len(items)):
            node, key = items[j]
            items[j] = (self.open(node.name, dict(node.attrs)), key)

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not MARKER:
            pass

    def formatting_index(self, node: Node) -> int:
        return next((k for k, e in enumerate(self.formatting) if e is not MARKER and e[0] is node), -1)

    def last_formatting(self, name: str) -> Node | None:
        for e in reversed(self.formatting):
            if e is MARKER:
                return None
            if e[0].name == name:
                return e[0]
        return None

    def adopt(self, name: str) -> None:
        """The adoption agency."""
        if self.is_open(name) and self.formatting_index(self.stack[-1]) < 0:
            self.stack.pop()
            return
        for _ in range(8):
            node = self.last_formatting(name)
            if node is None:
                self.end_any(name)
                return
            if node not in self.stack:
                self.error("adoption-agency-1.3")
                del self.formatting[self.formatting_index(node)]
                return
            if not self.in_element_scope(node):
                self.error("adoption-agency-1.3")
                return
            if node is not self.stack[-1]:
                self.error("adoption-agency-1.3")
            low = self.stack.index(node)
            furthest = next((k for k in range(low + 1, len(self.stack)) if self.special(self.stack[k])), None)
            if furthest is None:
                del self.stack[low:]
                del self.formatting[self.formatting_index(node)]
                return
            block, ancestor = self.stack[furthest], self.stack[low - 1]
            bookmark = self.formatting_index(node)
            last, k, rounds = block, furthest, 0
            while True:
                k -= 1
                inner = self.stack[k]
                if inner is node:
                    break
                rounds += 1
                at = self.formatting_index(inner)
                if rounds > 3 and at >= 0:
                    del self.formatting[at]
                    bookmark -= at < bookmark
                    at = -1
                if at < 0:
                    del self.stack[k]
                    continue
                fresh = Node.element(inner.name, dict(inner.attrs))
                self.formatting[at] = (fresh, self.formatting[at][1])
                self.stack[k] = fresh
                if last is block:
                    bookmark = at + 1
                last.detach()
                self.put(last, (fresh, None))
                last = fresh
            last.detach()
            foster, self.foster = self.foster, True
            self.put(last, self.location(ancestor))
            self.foster = foster
            fresh = Node.element(node.name, dict(node.attrs))
            for child in block.children:
                child.parent = fresh
            fresh.children, block.children = block.children, []
            self.put(fresh, (block, None))
            at = self.formatting_index(node)
            key = self.formatting[at][1]
            del self.formatting[at]
            self.formatting.insert(bookmark - (at < bookmark), (fresh, key))
            self.stack.remove(node)
            self.stack.insert(self.stack.index(block) + 1, fresh)

    def in_element_scope(self, wanted: Node) -> bool:
        for node in reversed(self.stack):
            if node is wanted:
                return True
            if node.ns == "html":
                if node.name in C.DEFAULT_SCOPE:
                    return False
            elif node.name in (C.MATH_SPECIAL if node.ns == "math" else C.SVG_HTML):
                return False
        return False

    @staticmethod
    def special(node: Node) -> bool:
        return node.name in (C.SPECIAL if node.ns == "html" else C.MATH_SPECIAL if node.ns == "math" else C.SVG_HTML)

    # --- modes

    def reset_mode(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            last = k == 0
            node = self.context if last and self.context is not None else self.stack[k]
            name = node.name if node.ns == "html" else ""
            if name == "select":
                self.mode = "in_select"
            elif name in ("td", "th") and not last:
                self.mode = "in_cell"
            elif name == "tr":
                self.mode = "in_row"
            elif name in ("tbody", "thead", "tfoot"):
                self.mode = "in_table_body"
            elif name == "caption":
                self.mode = "in_caption"
            elif name == "colgroup":
                self.mode = "in_column_group"
            elif name == "table":
                self.mode = "in_table"
            elif name == "template":
                self.mode = self.templates[-1]
            elif name == "head" and not last:
                self.mode = "in_head"
            elif name == "body":
                self.mode = "in_body"
            elif name == "frameset":
                self.mode = "in_frameset"
            elif name == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            elif last:
                self.mode = "in_body"
            else:
                continue
            return

    def _imply(self) -> None:
        """Take the step that the mode takes before anything it does not expect."""
        if self.mode == "initial":
            if not self.srcdoc:
                self.quirks = "quirks"
            self.mode = "before_html"
        elif self.mode == "before_html":
            self.stack.append(self.document.append_child(Node.element("html")))
            self.mode = "before_head"
        elif self.mode == "before_head":
            self.head = self.open("head")
            self.mode = "in_head"
        elif self.mode == "in_head":
            self.stack.pop()
            self.mode = "after_head"
        elif self.mode == "after_head":
            self.open("body")
            self.mode = "in_body"

    def _redo_start(self, name, attrs, sc) -> None:
        self._imply()
        self._start(name, attrs, sc)

    # initial, before html, before head

    def start_initial(self, name, attrs, sc):
        self.error("expected-doctype-but-got-start-tag")
        self._redo_start(name, attrs, sc)

    def end_initial(self, name):
        self.error("expected-doctype-but-got-end-tag")
        self._imply()
        self.end(name)

    def chars_initial(self, text):
        text = text[LEADING.match(text).end() :]
        if text:
            if self.mode == "initial":
                self.error("expected-doctype-but-got-chars")
            self._imply()
            self.chars(text)

    def start_before_html(self, name, attrs, sc):
        if name == "html":
            self.stack.append(self.document.append_child(Node.element("html", attrs)))
            self.mode = "before_head"
        else:
            self._redo_start(name, attrs, sc)

    def end_before_html(self, name):
        if name in ("head", "body", "html", "br"):
            self._imply()
            self.end(name)
        else:
            self.error("unexpected-end-tag-before-html")

    chars_before_html = chars_initial

    def start_before_head(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name == "head":
            self.head = self.open(name, attrs)
            self.mode = "in_head"
        else:
            self._redo_start(name, attrs, sc)

    end_before_head = end_before_html
    chars_before_head = chars_initial

    # in head

    def start_in_head(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name in ("base", "basefont", "bgsound", "link", "meta"):
            self.void_or_leaf(name, attrs)
        elif name == "title" or name in ("noframes", "style", "script"):
            self.text_element(name, attrs)
        elif name == "noscript":
            self.open(name, attrs)
            self.mode = "in_head_noscript"
        elif name == "template":
            self.open(name, attrs)
            self.formatting.append(MARKER)
            self.frameset_ok = False
            self.mode = "in_template"
            self.templates.append("in_template")
        elif name == "head":
            self.error("unexpected-start-tag")
        else:
            self._redo_start(name, attrs, sc)

    def void_or_leaf(self, name, attrs):
        self.acknowledged = True
        self.open(name, attrs)
        self.stack.pop()

    def text_element(self, name, attrs):
        self.open(name, attrs)
        self.back, self.mode = self.mode, "text"

    def end_in_head(self, name):
        if name == "head":
            self._imply()
        elif name in ("body", "html", "br"):
            self._imply()
            self.end(name)
        elif name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag")

    def end_template(self):
        if self.find_open("template") is None:
            self.error("unexpected-end-tag")
            return
        self.imply_ends(thorough=True)
        if not self.is_open("template"):
            self.error("expected-closing-tag-but-got-eof")
        self.pop_until("template")
        self.clear_formatting()
        self.templates.pop()
        self.reset_mode()

    def chars_in_head(self, text):
        n = LEADING.match(text).end()
        if n:
            self.insert_text(text[:n])
        if n < len(text):
            if self.mode == "in_head_noscript":
                self.error("unexpected-char-in-noscript")
                self.stack.pop()
                self.mode = "in_head"
            else:
                self._imply()
            self.chars(text[n:])

    def start_in_head_noscript(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            self.start_in_head(name, attrs, sc)
        elif name in ("head", "noscript"):
            self.error("unexpected-start-tag")
        else:
            self.error("unexpected-inside-noscript")
            self.stack.pop()
            self.mode = "in_head"
            self._start(name, attrs, sc)

    def end_in_head_noscript(self, name):
        if name in ("noscript", "br"):
            self.stack.pop()
            self.mode = "in_head"
            if name == "br":
                self.end(name)
        else:
            self.error("unexpected-end-tag")

    chars_in_head_noscript = chars_in_head

    # after head

    def start_after_head(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name == "body":
            self.open(name, attrs)
            self.frameset_ok = False
            self.mode = "in_body"
        elif name == "frameset":
            self.open(name, attrs)
            self.mode = "in_frameset"
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.error("unexpected-start-tag-out-of-my-head")
            self.stack.append(self.head)
            self.start_in_head(name, attrs, sc)
            self.stack.remove(self.head)
        elif name == "head":
            self.error("unexpected-start-tag")
        else:
            self._redo_start(name, attrs, sc)

    def end_after_head(self, name):
        if name in ("body", "html", "br"):
            self._imply()
            self.end(name)
        elif name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag")

    chars_after_head = chars_in_head

    # text

    def start_text(self, name, attrs, sc):  # never told: the tokenizer reads to the end tag
        self.stack.pop()
        self.mode = self.back
        self._start(name, attrs, sc)

    def end_text(self, name):
        self.stack.pop()
        self.mode = self.back

    def chars_text(self, text):
        self.insert_text(text)

    # in body

    def chars_in_body(self, text):
        if "\0" in text:
            self.error("invalid-codepoint")
            text = text.replace("\0", "")
            if not text:
                return
        if self.formatting:
            self.reconstruct()
        self.insert_text(text)
        if self.frameset_ok and LEADING.match(text).end() < len(text):
            self.frameset_ok = False

    def start_in_body(self, name, attrs, sc):
        handler = BODY_START.get(name)
        if handler is not None:
            handler(self, name, attrs)
        elif name in ("svg", "math"):
            self.reconstruct()
            self.foreign_insert(name, attrs, name, sc)
        else:
            self.reconstruct()
            self.open(name, attrs)

    def end_in_body(self, name):
        handler = BODY_END.get(name)
        if handler is not None:
            handler(self, name)
        else:
            self.end_any(name)

    def end_any(self, name):
        for k in range(len(self.stack) - 1, -1, -1):
            node = self.stack[k]
            if node.ns == "html" and node.name == name:
                self.imply_ends(name)
                if self.stack[-1] is not node:
                    self.error("unexpected-end-tag")
                del self.stack[k:]
                return
            if self.special(node):
                self.error("unexpected-end-tag")
                return

    def merge(self, node: Node, attrs: dict[str, str]) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    def s_html(self, name, attrs):
        self.error("unexpected-start-tag")
        if self.find_open("template") is None:
            self.merge(self.stack[0], attrs)

    def s_body(self, name, attrs):
        self.error("unexpected-start-tag")
        if len(self.stack) > 1 and self.stack[1].name == "body" and self.find_open("template") is None:
            self.frameset_ok = False
            self.merge(self.stack[1], attrs)

    def s_head(self, name, attrs):
        self.start_in_head(name, attrs, False)

    def s_ignored(self, name, attrs):
        self.error("unexpected-start-tag-ignored")

    def s_frameset(self, name, attrs):
        self.error("unexpected-start-tag")
        if len(self.stack) > 1 and self.stack[1].name == "body" and self.frameset_ok:
            self.stack[1].detach()
            del self.stack[1:]
            self.open(name, attrs)
            self.mode = "in_frameset"

    def s_block(self, name, attrs):
        self.close_p()
        self.open(name, attrs)

    def s_heading(self, name, attrs):
        self.close_p()
        if self.stack[-1].name in C.HEADINGS and self.stack[-1].ns == "html":
            self.error("unexpected-start-tag")
            self.stack.pop()
        self.open(name, attrs)

    def s_pre(self, name, attrs):
        self.s_block(name, attrs)
        self.skip_newline = True
        self.frameset_ok = False

    def s_form(self, name, attrs):
        template = self.find_open("template") is not None
        if self.form is not None and not template:
            self.error("unexpected-start-tag")
            return
        self.close_p()
        node = self.open(name, attrs)
        if not template:
            self.form = node

    def s_item(self, name, attrs):
        self.frameset_ok = False
        names = ("li",) if name == "li" else ("dd", "dt")
        for node in reversed(self.stack):
            if node.ns == "html" and node.name in names:
                self.close(node.name)
                break
            if self.special(node) and not (node.ns == "html" and node.name in ("address", "div", "p")):
                break
        self.close_p()
        self.open(name, attrs)

    def s_plaintext(self, name, attrs):
        self.close_p()
        self.open(name, attrs)

    def s_button(self, name, attrs):
        if self.in_scope("button"):
            self.error("unexpected-start-tag-implies-end-tag")
            self.imply_ends()
            self.pop_until("button")
        self.reconstruct()
        self.open(name, attrs)
        self.frameset_ok = False

    def s_a(self, name, attrs):
        old = self.last_formatting("a")
        if old is not None:
            self.error("unexpected-start-tag-implies-end-tag")
            self.adopt("a")
            if (at := self.formatting_index(old)) >= 0:
                del self.formatting[at]
            if old in self.stack:
                self.stack.remove(old)
        self.s_formatting(name, attrs)

    def s_formatting(self, name, attrs):
        self.reconstruct()
        self.push_formatting(self.open(name, attrs))

    def s_nobr(self, name, attrs):
        self.reconstruct()
        if self.in_scope("nobr"):
            self.error("unexpected-start-tag-implies-end-tag")
            self.adopt("nobr")
            self.reconstruct()
        self.push_formatting(self.open(name, attrs))

    def s_marked(self, name, attrs):
        self.reconstruct()
        self.open(name, attrs)
        self.formatting.append(MARKER)
        self.frameset_ok = False

    def s_table(self, name, attrs):
        if self.quirks != "quirks":
            self.close_p()
        self.open(name, attrs)
        self.frameset_ok = False
        self.mode = "in_table"

    def s_void(self, name, attrs):
        self.reconstruct()
        self.void_or_leaf(name, attrs)
        self.frameset_ok = False

    def s_input(self, name, attrs):
        self.reconstruct()
        self.void(name, attrs)
        if attrs.get("type", "").lower() != "hidden":
            self.frameset_ok = False

    def s_leaf(self, name, attrs):
        self.void(name, attrs)

    def s_hr(self, name, attrs):
        self.close_p()
        self.void(name, attrs)
        self.frameset_ok = False

    def s_image(self, name, attrs):
        self.error("image-start-tag")
        self.s_void("img", attrs)

    def s_textarea(self, name, attrs):
        self.text_element(name, attrs)
        self.skip_newline = True
        self.frameset_ok = False

    def s_xmp(self, name, attrs):
        self.close_p()
        self.reconstruct()
        self.frameset_ok = False
        self.text_element(name, attrs)

    def s_iframe(self, name, attrs):
        self.frameset_ok = False
        self.text_element(name, attrs)

    def s_raw(self, name, attrs):
        self.text_element(name, attrs)

    def s_select(self, name, attrs):
        self.reconstruct()
        self.open(name, attrs)
        self.frameset_ok = False
        self.mode = "in_select"

    def s_option(self, name, attrs):
        if self.is_open("option"):
            self.stack.pop()
        self.reconstruct()
        self.open(name, attrs)

    def s_ruby(self, name, attrs):
        if self.in_scope("ruby"):
            self.imply_ends("rtc" if name in ("rp", "rt") else "")
        self.open(name, attrs)

    def e_body(self, name):
        if not self.in_scope("body"):
            self.error("unexpected-end-tag")
            return False
        self.mode = "after_body"
        return True

    def e_html(self, name):
        if self.e_body(name):
            self.end(name)

    def e_block(self, name):
        if self.in_scope(name):
            self.close(name)
        else:
            self.error("unexpected-end-tag")

    def e_form(self, name):
        if self.find_open("template") is not None:
            self.e_block(name)
            return
        node, self.form = self.form, None
        if node is None or node not in self.stack or not self.in_element_scope(node):
            self.error("unexpected-end-tag")
            return
        self.imply_ends()
        if self.stack[-1] is not node:
            self.error("end-tag-too-early")
        self.stack.remove(node)

    def e_p(self, name):
        if not self.in_scope("p", C.BUTTON_SCOPE):
            self.error("unexpected-end-tag")
            self.open("p")
        self.close("p")

    def e_li(self, name):
        if self.in_scope("li", C.LIST_SCOPE):
            self.close("li")
        else:
            self.error("unexpected-end-tag")

    def e_heading(self, name):
        if self.in_scope(C.HEADINGS):
            self.imply_ends()
            if not self.is_open(name):
                self.error("end-tag-too-early")
            self.pop_until(*C.HEADINGS)
        else:
            self.error("unexpected-end-tag")

    def e_marked(self, name):
        if self.in_scope(name):
            self.close(name)
            self.clear_formatting()
        else:
            self.error("unexpected-end-tag")

    def e_br(self, name):
        self.error("unexpected-end-tag-treated-as")
        self.s_void("br", {})

    # tables

    def fostered(self, call, *args) -> None:
        self.foster = True
        call(*args)
        self.foster = False

    def chars_in_table(self, text):
        if not self.is_open("table", "tbody", "template", "tfoot", "thead", "tr"):
            self.chars_in_body(text)
            return
        text = text.replace("\0", "")
        if not text:
            return
        if LEADING.match(text).end() == len(text):
            self.insert_text(text)
        else:
            self.error("foster-parenting-character")
            self.fostered(self.chars_in_body, text)

    def start_in_table(self, name, attrs, sc):
        if name == "caption":
            self.clear_to(C.TABLE_SCOPE)
            self.formatting.append(MARKER)
            self.open(name, attrs)
            self.mode = "in_caption"
        elif name == "colgroup":
            self.clear_to(C.TABLE_SCOPE)
            self.open(name, attrs)
            self.mode = "in_column_group"
        elif name == "col":
            self.clear_to(C.TABLE_SCOPE)
            self.open("colgroup")
            self.mode = "in_column_group"
            self._start(name, attrs, sc)
        elif name in ("tbody", "tfoot", "thead"):
            self.clear_to(C.TABLE_SCOPE)
            self.open(name, attrs)
            self.mode = "in_table_body"
        elif name in ("td", "th", "tr"):
            self.clear_to(C.TABLE_SCOPE)
            self.open("tbody")
            self.mode = "in_table_body"
            self._start(name, attrs, sc)
        elif name == "table":
            self.error("unexpected-start-tag-implies-end-tag")
            if self.in_scope("table", C.TABLE_SCOPE):
                self.pop_until("table")
                self.reset_mode()
                self._start(name, attrs, sc)
        elif name in ("style", "script", "template"):
            self.start_in_head(name, attrs, sc)
        elif name == "input" and attrs.get("type", "").lower() == "hidden":
            self.error("unexpected-hidden-input-in-table")
            self.void(name, attrs)
        elif name == "form":
            self.error("unexpected-form-in-table")
            if self.form is None and self.find_open("template") is None:
                self.form = self.open(name, attrs)
                self.stack.pop()
        else:
            self.error("unexpected-start-tag-implies-table-voodoo")
            self.fostered(self.start_in_body, name, attrs, sc)

    def end_in_table(self, name):
        if name == "table":
            if self.in_scope("table", C.TABLE_SCOPE):
                self.pop_until("table")
                self.reset_mode()
            else:
                self.error("unexpected-end-tag")
        elif name in ("body", "html") or name in C.TABLE_PARTS:
            self.error("unexpected-end-tag")
        elif name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag-implies-table-voodoo")
            self.fostered(self.end_in_body, name)

    def close_caption(self) -> bool:
        if not self.in_scope("caption", C.TABLE_SCOPE):
            self.error("unexpected-end-tag")
            return False
        self.imply_ends()
        self.pop_until("caption")
        self.clear_formatting()
        self.mode = "in_table"
        return True

    def start_in_caption(self, name, attrs, sc):
        if name in C.TABLE_PARTS:
            if self.close_caption():
                self._start(name, attrs, sc)
        else:
            self.start_in_body(name, attrs, sc)

    def end_in_caption(self, name):
        if name == "caption":
            self.close_caption()
        elif name == "table":
            if self.close_caption():
                self.end(name)
        elif name == "body" or name == "html" or name in C.TABLE_PARTS:
            self.error("unexpected-end-tag")
        else:
            self.end_in_body(name)

    chars_in_caption = chars_in_body

    def leave_colgroup(self) -> bool:
        if not self.is_open("colgroup"):
            self.error("unexpected-token-in-column-group")
            return False
        self.stack.pop()
        self.mode = "in_table"
        return True

    def start_in_column_group(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name == "col":
            self.void(name, attrs)
        elif name == "template":
            self.start_in_head(name, attrs, sc)
        elif self.leave_colgroup():
            self._start(name, attrs, sc)

    def end_in_column_group(self, name):
        if name == "colgroup":
            self.leave_colgroup()
        elif name == "col":
            self.error("no-end-tag")
        elif name == "template":
            self.end_template()
        elif self.leave_colgroup():
            self.end(name)

    def chars_in_column_group(self, text):
        n = LEADING.match(text).end()
        if n:
            self.insert_text(text[:n])
        if n < len(text) and self.leave_colgroup():
            self.chars(text[n:])

    chars_in_table_body = chars_in_row = chars_in_table

    def start_in_table_body(self, name, attrs, sc):
        if name == "tr":
            self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
            self.open(name, attrs)
            self.mode = "in_row"
        elif name in ("td", "th"):
            self.error("unexpected-cell-in-table-body")
            self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
            self.open("tr")
            self.mode = "in_row"
            self._start(name, attrs, sc)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            if self.leave_body():
                self._start(name, attrs, sc)
        else:
            self.start_in_table(name, attrs, sc)

    def leave_body(self) -> bool:
        if not self.in_scope(("tbody", "thead", "tfoot"), C.TABLE_SCOPE):
            self.error("unexpected-end-tag")
            return False
        self.clear_to(("tbody", "tfoot", "thead", "template", "html"))
        self.stack.pop()
        self.mode = "in_table"
        return True

    def end_in_table_body(self, name):
        if name in ("tbody", "tfoot", "thead"):
            if self.in_scope(name, C.TABLE_SCOPE):
                self.leave_body()
            else:
                self.error("unexpected-end-tag")
        elif name == "table":
            if self.leave_body():
                self.end(name)
        elif name in ("body", "html") or name in C.TABLE_PARTS:
            self.error("unexpected-end-tag")
        else:
            self.end_in_table(name)

    def leave_row(self) -> bool:
        if not self.in_scope("tr", C.TABLE_SCOPE):
            self.error("unexpected-end-tag")
            return False
        self.clear_to(("tr", "template", "html"))
        self.stack.pop()
        self.mode = "in_table_body"
        return True

    def start_in_row(self, name, attrs, sc):
        if name in ("td", "th"):
            self.clear_to(("tr", "template", "html"))
            self.open(name, attrs)
            self.mode = "in_cell"
            self.formatting.append(MARKER)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self.leave_row():
                self._start(name, attrs, sc)
        else:
            self.start_in_table(name, attrs, sc)

    def end_in_row(self, name):
        if name == "tr":
            self.leave_row()
        elif name == "table":
            if self.leave_row():
                self.end(name)
        elif name in ("tbody", "tfoot", "thead"):
            if not self.in_scope(name, C.TABLE_SCOPE):
                self.error("unexpected-end-tag")
            elif self.leave_row():
                self.end(name)
        elif name in ("body", "html") or name in C.TABLE_PARTS:
            self.error("unexpected-end-tag")
        else:
            self.end_in_table(name)

    def close_cell(self) -> None:
        self.imply_ends()
        if not self.is_open("td", "th"):
            self.error("unexpected-cell-end-tag")
        self.pop_until("td", "th")
        self.clear_formatting()
        self.mode = "in_row"

    def start_in_cell(self, name, attrs, sc):
        if name in C.TABLE_PARTS:
            if self.in_scope(("td", "th"), C.TABLE_SCOPE):
                self.close_cell()
                self._start(name, attrs, sc)
            else:
                self.error("unexpected-start-tag")
        else:
            self.start_in_body(name, attrs, sc)

    def end_in_cell(self, name):
        if name in ("td", "th"):
            if self.in_scope(name, C.TABLE_SCOPE):
                self.imply_ends()
                if not self.is_open(name):
                    self.error("unexpected-cell-end-tag")
                self.pop_until(name)
                self.clear_formatting()
                self.mode = "in_row"
            else:
                self.error("unexpected-end-tag")
        elif name in ("body", "caption", "col", "colgroup", "html"):
            self.error("unexpected-end-tag")
        elif name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.in_scope(name, C.TABLE_SCOPE):
                self.close_cell()
                self.end(name)
            else:
                self.error("unexpected-end-tag")
        else:
            self.end_in_body(name)

    chars_in_cell = chars_in_body

    # select

    def chars_in_select(self, text):
        text = text.replace("\0", "").replace("\f", "")
        if text:
            self.reconstruct()
            self.insert_text(text)

    def leave_select(self) -> None:
        self.pop_until("select")
        self.reset_mode()

    def start_in_select(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
            return
        if name in ("script", "template"):
            self.start_in_head(name, attrs, sc)
            return
        if name == "select" or name in ("input", "textarea", "table") or name in C.TABLE_PARTS:
            self.error("unexpected-start-tag-implies-end-tag")
            if self.find_open("select") is None:  # a fragment inside a select
                return
            self.leave_select()
            if name != "select":
                self._start(name, attrs, sc)
            return
        if name in ("option", "optgroup", "hr"):
            if self.is_open("option"):
                self.stack.pop()
            if name != "option" and self.is_open("optgroup"):
                self.stack.pop()
        elif not (name in IN_SELECT or name in C.FORMATTING or name in ("svg", "math", "keygen", "menuitem", "br", "img", "plaintext")):
            self.error("unexpected-start-tag-in-select")
            return
        self.reconstruct()
        if name in ("svg", "math"):
            self.foreign_insert(name, attrs, name, sc)
        elif name in C.FORMATTING:
            self.push_formatting(self.open(name, attrs))
        elif name in ("hr", "keygen", "br", "img"):
            self.void_or_leaf(name, attrs)
        else:
            self.open(name, attrs)
            if sc and name in IN_SELECT:
                self.stack.pop()

    def end_in_select(self, name):
        if name == "optgroup":
            if self.is_open("option") and len(self.stack) > 1 and self.stack[-2].name == "optgroup":
                self.stack.pop()
            if self.is_open("optgroup"):
                self.stack.pop()
            else:
                self.error("unexpected-end-tag")
        elif name == "option":
            if self.is_open("option"):
                self.stack.pop()
            else:
                self.error("unexpected-end-tag")
        elif name == "select":
            if self.find_open("select") is not None:
                self.leave_select()
        elif name == "template":
            self.end_template()
        elif name in C.FORMATTING:
            node, select = self.last_formatting(name), self.find_open("select")
            if node is not None and node in self.stack and select is not None and self.stack.index(node) < self.stack.index(select):
                self.error("unexpected-end-tag")
            else:
                self.adopt(name)
        elif name in IN_SELECT:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].name == name and self.stack[k].ns == "html":
                    del self.stack[k:]
                    return
                if self.stack[k].name == "select":
                    break
            self.error("unexpected-end-tag")
        elif name == "table" or name in C.TABLE_PARTS:
            self.error("unexpected-end-tag")
            if self.in_scope(name, C.TABLE_SCOPE) and self.find_open("select") is not None:
                self.leave_select()
                self.end(name)
        else:
            self.error("unexpected-end-tag")

    def _fill_selectedcontent(self) -> None:
        """Copy the chosen option of each select into its first selectedcontent."""
        for select in [n for n in self.document.walk() if n.name == "select"]:
            inside = list(select.walk())
            target = next((n for n in inside if n.name == "selectedcontent"), None)
            options = [n for n in inside if n.name == "option"]
            if target is not None and options:
                chosen = next((n for n in options if "selected" in n.attrs), options[0])
                for c in [c.clone(True) for c in chosen.children]:
                    self.put(c, (target, None))

    # templates

    def start_in_template(self, name, attrs, sc):
        if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.start_in_head(name, attrs, sc)
            return
        mode = {"caption": "in_table", "colgroup": "in_table", "tbody": "in_table", "tfoot": "in_table", "thead": "in_table", "col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name, "in_body")
        self.templates[-1] = self.mode = mode
        self._start(name, attrs, sc)

    def end_in_template(self, name):
        if name == "template":
            self.end_template()
        else:
            self.error("unexpected-end-tag")

    chars_in_template = chars_in_body

    # after the body, framesets

    def start_after_body(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        else:
            self.error("unexpected-start-tag-after-body")
            self.mode = "in_body"
            self._start(name, attrs, sc)

    def end_after_body(self, name):
        if name == "html":
            if self.context is None:
                self.mode = "after_after_body"
            else:
                self.error("unexpected-end-tag-after-body-innerhtml")
        else:
            self.error("unexpected-end-tag-after-body")
            self.mode = "in_body"
            self.end(name)

    def chars_after_body(self, text):
        if LEADING.match(text).end() < len(text):
            self.error("unexpected-char-after-body")
            self.mode = "in_body"
            self.chars(text)
        else:
            self.chars_in_body(text)

    start_after_after_body, chars_after_after_body = start_after_body, chars_after_body

    def end_after_after_body(self, name):
        self.error("expected-eof-but-got-end-tag")
        self.mode = "in_body"
        self.end(name)

    def start_in_frameset(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name == "frameset":
            self.open(name, attrs)
        elif name == "frame":
            self.void_or_leaf(name, attrs)
        elif name == "noframes":
            self.start_in_head(name, attrs, sc)
        else:
            self.error("unexpected-start-tag-in-frameset")

    def end_in_frameset(self, name):
        if name != "frameset" or len(self.stack) == 1:
            self.error("unexpected-end-tag-in-frameset")
            return
        self.stack.pop()
        if self.context is None and not self.is_open("frameset"):
            self.mode = "after_frameset"

    def chars_in_frameset(self, text):
        kept = "".join(c for c in text if c in C.WHITESPACE)
        if kept != text:
            self.error("unexpected-char-in-frameset")
        if kept:
            self.insert_text(kept)

    def start_after_frameset(self, name, attrs, sc):
        if name == "html":
            self.start_in_body(name, attrs, sc)
        elif name == "noframes":
            self.start_in_head(name, attrs, sc)
        else:
            self.error("unexpected-start-tag-after-frameset")

    def end_after_frameset(self, name):
        if name == "html" and self.mode == "after_frameset":
            self.mode = "after_after_frameset"
        else:
            self.error("unexpected-end-tag-after-frameset")

    chars_after_frameset = chars_in_frameset
    start_after_after_frameset, end_after_after_frameset, chars_after_after_frameset = start_after_frameset, end_after_frameset, chars_in_frameset

    # foreign content

    @staticmethod
    def html_point(node: Node) -> bool:
        if node.ns == "svg":
            return node.name in C.SVG_HTML
        return node.ns == "math" and node.name == "annotation-xml" and (node.attrs.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml")

    def _foreign_start(self, name: str) -> bool:
        node = self.adjusted()
        if node is None or node.ns == "html":
            return False
        if node.ns == "math":
            if node.name in C.MATH_TEXT and name not in ("mglyph", "malignmark"):
                return False
            if node.name == "annotation-xml" and name == "svg":
                return False
        return not self.html_point(node)

    def foreign_insert(self, name, attrs, ns, sc) -> None:
        fixed = C.SVG_ATTRS if ns == "svg" else C.MATH_ATTRS
        node = self.open(name, {fixed.get(k, k): v for k, v in attrs.items()}, ns)
        node.content = None
        if sc:
            self.acknowledged = True
            self.stack.pop()

    def foreign_start(self, name, attrs, sc):
        if name in C.BREAKOUT or name == "font" and not attrs.keys().isdisjoint(("color", "face", "size")):
            self.error("unexpected-html-element-in-foreign-content")
            while not ((node := self.stack[-1]).ns == "html" or node.ns == "math" and node.name in C.MATH_TEXT or self.html_point(node)):
                self.stack.pop()
            getattr(self, "start_" + self.mode)(name, attrs, sc)
            return
        ns = self.adjusted().ns
        self.foreign_insert(C.SVG_TAGS.get(name, name) if ns == "svg" else name, attrs, ns, sc)

    def foreign_end(self, name):
        if name in ("br", "p"):
            self.error("unexpected-html-element-in-foreign-content")
            while not ((node := self.stack[-1]).ns == "html" or node.ns == "math" and node.name in C.MATH_TEXT or self.html_point(node)):
                self.stack.pop()
            getattr(self, "end_" + self.mode)(name)
            return
        for k in range(len(self.stack) - 1, -1, -1):
            node = self.stack[k]
            if node.ns == "html":
                getattr(self, "end_" + self.mode)(name)
                return
            if node.name.lower() == name:
                if k == 0:
                    return
                if k != len(self.stack) - 1:
                    self.error("unexpected-end-tag")
                del self.stack[k:]
                return
            if k == 0:
                return

    def foreign_chars(self, text):
        if "\0" in text:
            self.error("invalid-codepoint-in-foreign-content")
            text = text.replace("\0", "�")
        self.insert_text(text)
        if LEADING.match(text).end() < len(text):
            self.frameset_ok = False


def _table(rows) -> dict:
    return {n: f for names, f in rows for n in (names.split() if isinstance(names, str) else names)}


T = TreeBuilder
BODY_START = _table([
    ("html", T.s_html), ("body", T.s_body), ("base basefont bgsound link meta noframes script style template title", T.s_head), ("head caption col colgroup frame tbody td tfoot th thead tr", T.s_ignored),
    ("frameset", T.s_frameset), (C.CLOSES_P, T.s_block), ("p", T.s_block), (C.HEADINGS, T.s_heading), ("pre listing", T.s_pre), ("form", T.s_form), ("li dd dt", T.s_item), ("plaintext", T.s_plaintext),
    ("button", T.s_button), (C.FORMATTING, T.s_formatting), ("a", T.s_a), ("nobr", T.s_nobr), ("applet marquee object", T.s_marked), ("table", T.s_table), ("area br embed img keygen wbr", T.s_void),
    ("input", T.s_input), ("param source track", T.s_leaf), ("hr", T.s_hr), ("image", T.s_image), ("textarea", T.s_textarea), ("xmp", T.s_xmp), ("iframe", T.s_iframe), ("noembed", T.s_raw),
    ("select", T.s_select), ("option optgroup", T.s_option), ("rb rtc rp rt", T.s_ruby),
])
BODY_END = _table([
    ("template", lambda b, n: b.end_template()), ("body", T.e_body), ("html", T.e_html), (C.END_BLOCK, T.e_block), ("form", T.e_form), ("p", T.e_p), ("li", T.e_li), ("dd dt", T.e_block),
    (C.HEADINGS, T.e_heading), (C.FORMATTING, T.adopt), ("applet marquee object", T.e_marked), ("br", T.e_br),
])

