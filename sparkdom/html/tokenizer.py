"""HTML text to tokens, handed one by one to a sink.

The sink has start(name, attrs, self_closing), end(name), chars(text), comment(text),
doctype(name, public, system, force_quirks), eof() and foreign(). start() may return the
content model that follows: rcdata, rawtext, script or plaintext.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from sparkdom.html.entities import LEGACY, LONGEST_LEGACY, NAMED, REFERENCE, decode

SPACE = "\t\n\f "
TAG_NAME = re.compile(r"[^\t\n\f />]*")
SKIP = re.compile(r"[\t\n\f ]*")
ATTR_NAME = re.compile(r"=?[^\t\n\f />=]*")
UNQUOTED = re.compile(r"[^\t\n\f >]*")
COMMENT_END = re.compile(r"--!?>")
UPPER = {c: c + 32 for c in range(65, 91)}
SCRIPT = re.compile(r"<!--|</script(?=[\t\n\f />])", re.I)
SCRIPT_IN_COMMENT = re.compile(r"-->|<(/?)script(?=[\t\n\f />])", re.I)
XML_BAD = re.compile("[\\ufdd0-\\ufdef\\ufffe\\uffff]" + "".join(f"|[{chr(p << 16 | 0xFFFE)}{chr(p << 16 | 0xFFFF)}]" for p in range(1, 17)))


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(UPPER)


class Tokenizer:
    def __init__(self, text: str, sink, errors: list | None = None, state: str = "data", last_start: str = "", discard_bom: bool = True, xml: bool = False):
        if discard_bom and text.startswith("\ufeff"):
            text = text[1:]
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        self.sink, self.errors, self.state, self.last_start, self.xml = sink, errors, state, last_start, xml
        self.pos, self.pending = 0, []
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))] if errors is not None else []

    # --- errors and text

    def place(self, at: int) -> tuple[int, int]:
        """Line and column, from 1, once the character at `at` is read."""
        at = min(at + 1, len(self.text))
        line = bisect_right(self.lines, at)
        return line, max(1, at - self.lines[line - 1])

    def error(self, code: str, at: int) -> None:
        if self.errors is not None:
            self.errors.append((code, *self.place(at)))

    def emit(self, text: str) -> None:
        if text:
            self.pending.append(text)

    def flush(self) -> None:
        if self.pending:
            text = "".join(self.pending)
            self.pending = []
            if self.xml:
                text = XML_BAD.sub("�", text.replace("\f", " "))
            self.sink.chars(text)

    def reference_errors(self, text: str, base: int, in_attribute: bool) -> None:
        for m in REFERENCE.finditer(text):
            at = base + m.end() - 1
            if m[1] or m[2]:
                digits = (m[1] or m[2]).lstrip("0") or "0"
                n = 0x110000 if len(digits) > 8 else int(digits, 16 if m[1] else 10)
                if not m[0].endswith(";"):
                    self.error("missing-semicolon-after-character-reference", at + 1)
                if n == 0:
                    self.error("null-character-reference", at)
                elif n > 0x10FFFF:
                    self.error("character-reference-outside-unicode-range", at)
                elif 0xD800 <= n <= 0xDFFF:
                    self.error("surrogate-character-reference", at)
                elif 0xFDD0 <= n <= 0xFDEF or n & 0xFFFE == 0xFFFE:
                    self.error("noncharacter-character-reference", at)
                elif n == 0x0D or n < 0x20 and n not in (9, 10, 12) or 0x7F <= n <= 0x9F:
                    self.error("control-character-reference", at)
            elif not (m[4] and m[3] in NAMED):
                legacy = any(m[3][:n] in LEGACY for n in range(2, min(len(m[3]), LONGEST_LEGACY) + 1))
                if legacy and not in_attribute:
                    self.error("missing-semicolon-after-character-reference", at)
                elif m[4] and not legacy:
                    self.error("unknown-named-character-reference", at)

    def decoded(self, start: int, end: int) -> str:
        raw = self.text[start:end]
        if "&" in raw:
            if self.errors is not None:
                self.reference_errors(raw, start, False)
            return decode(raw)
        return raw

    # --- driving

    def run(self) -> None:
        while self.step():
            pass

    def step(self) -> bool:
        """Read on to the next token or change of state; False once the end was told."""
        if self.pos >= len(self.text):
            self.flush()
            self.sink.eof()
            return False
        getattr(self, "read_" + self.state)()
        return True

    def read_data(self) -> None:
        text, start = self.text, self.pos
        at = text.find("<", start)
        if at < 0:
            at = len(text)
        if at > start:
            if self.errors is not None and "\0" in text[start:at]:
                self.error("unexpected-null-character", text.index("\0", start))
            self.emit(self.decoded(start, at))
            self.pos = at
            if at == len(text):
                return
        c = text[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            self.tag(at + 1, False)
        elif c == "/":
            c = text[at + 2 : at + 3]
            if c.isascii() and c.isalpha():
                self.tag(at + 2, True)
            elif c == ">":
                self.error("missing-end-tag-name", at + 2)
                self.pos = at + 3
            elif not c:
                self.error("eof-before-tag-name", at + 1)
                self.emit("</")
                self.pos = at + 2
            else:
                self.error("invalid-first-character-of-tag-name", at + 2)
                self.bogus_comment(at + 2)
        elif c == "!":
            self.declaration(at + 2)
        elif c == "?":
            self.error("unexpected-question-mark-instead-of-tag-name", at + 1)
            self.bogus_comment(at + 1)
        else:
            self.error("eof-before-tag-name" if not c else "invalid-first-character-of-tag-name", at + 1)
            self.emit("<")
            self.pos = at + 1

    def read_rcdata(self) -> None:
        self.raw(True)

    def read_rawtext(self) -> None:
        self.raw(False)

    def raw(self, references: bool) -> None:
        """To the end tag that fits the last start tag."""
        start = self.pos
        m = re.compile(f"</{re.escape(self.last_start)}(?=[\t\n\f />])", re.I).search(self.text, start) if self.last_start else None
        end = m.start() if m else len(self.text)
        got = self.decoded(start, end) if references else self.text[start:end]
        self.emit(got.replace("\0", "�"))
        self.pos = end
        if m:
            self.state = "data"
            self.tag(end + 2, True)

    def read_script(self) -> None:
        """Script data; inside <!-- a nested <script> hides its end tag."""
        text, at = self.text, self.pos
        inside = nested = False
        end = None
        while True:
            m = (SCRIPT_IN_COMMENT if inside else SCRIPT).search(text, at)
            if not m:
                break
            if not inside:
                if m[0] != "<!--":
                    end = m.start()
                    break
                inside, at = True, m.start() + 2  # <!--> and <!---> end at once
                if text.startswith("-->", at):
                    continue
                continue
            if m[0] == "-->":
                inside = nested = False
            elif not m[1]:
                nested = True
            elif nested:
                nested = False
            else:
                end = m.start()
                break
            at = m.end()
        stop = len(text) if end is None else end
        if end is None and inside:
            self.error("eof-in-script-html-comment-like-text", stop)
        self.emit(text[self.pos : stop].replace("\0", "�"))
        self.pos = stop
        if end is not None:
            self.state = "data"
            self.tag(end + 2, True)

    def read_plaintext(self) -> None:
        self.emit(self.text[self.pos :].replace("\0", "�"))
        self.pos = len(self.text)

    def read_cdata(self) -> None:
        end = self.text.find("]]>", self.pos)
        if end < 0:
            self.error("eof-in-cdata", len(self.text))
        self.emit(self.text[self.pos : None if end < 0 else end])
        self.pos = len(self.text) if end < 0 else end + 3
        self.state = "data"

    # --- markup

    def tag(self, at: int, closing: bool) -> None:
        """A tag whose name begins at `at`; one that the text ends in is dropped."""
        text, n = self.text, len(self.text)
        m = TAG_NAME.match(text, at)
        name = ascii_lower(m[0])
        if "\0" in name:
            self.error("unexpected-null-character", at)
            name = name.replace("\0", "�")
        at = m.end()
        attrs: dict[str, str] = {}
        self_closing = False
        while True:
            at = SKIP.match(text, at).end()
            if at >= n:
                self.error("eof-in-tag", n)
                self.pos = n
                return
            c = text[at]
            if c == ">":
                at += 1
                break
            if c == "/":
                if text[at + 1 : at + 2] == ">":
                    self_closing = True
                    at += 2
                    break
                if at + 1 < n:
                    self.error("unexpected-character-after-solidus-in-tag", at + 1)
                at += 1
                continue
            at = self.attribute(at, attrs)
        self.pos = at
        self.flush()
        if closing:
            if attrs:
                self.error("end-tag-with-attributes", at - 1)
            if self_closing:
                self.error("end-tag-with-trailing-solidus", at - 1)
            self.sink.end(name)
        else:
            self.last_start = name
            self.state = self.sink.start(name, attrs, self_closing) or "data"

    def attribute(self, at: int, attrs: dict[str, str]) -> int:
        text, n = self.text, len(self.text)
        if text[at] == "=":
            self.error("unexpected-equals-sign-before-attribute-name", at)
        m = ATTR_NAME.match(text, at)
        name = ascii_lower(m[0])
        at = m.end()
        if self.errors is not None:
            for bad in "\"'<":
                if bad in name:
                    self.error("unexpected-character-in-attribute-name", m.start() + name.index(bad))
        if "\0" in name:
            self.error("unexpected-null-character", m.start())
            name = name.replace("\0", "�")
        value = ""
        mark = SKIP.match(text, at).end()
        if text[mark : mark + 1] == "=":
            at = SKIP.match(text, mark + 1).end()
            quote = text[at : at + 1]
            if quote in ('"', "'") and quote:
                end = text.find(quote, at + 1)
                if end < 0:
                    return n
                start, at = at + 1, end + 1
                if at < n and text[at] not in "\t\n\f />":
                    self.error("missing-whitespace-between-attributes", at)
            elif quote == ">":
                self.error("missing-attribute-value", at)
                start = end = at
            else:
                start, end = at, UNQUOTED.match(text, at).end()
                at = end
                if self.errors is not None:
                    for m in re.finditer("[\"'<=`]", text[start:end]):
                        self.error("unexpected-character-in-unquoted-attribute-value", start + m.start())
            value = text[start:end]
            if "&" in value:
                if self.errors is not None:
                    self.reference_errors(value, start, True)
                value = decode(value, True)
            if "\0" in value:
                self.error("unexpected-null-character", start)
                value = value.replace("\0", "�")
        if name in attrs:
            self.error("duplicate-attribute", m.end() - 1)
        else:
            attrs[name] = value
        return at

    def declaration(self, at: int) -> None:
        text = self.text
        if text.startswith("--", at):
            self.comment(at + 2)
        elif text[at : at + 7].lower() == "doctype":
            self.doctype(at + 7)
        elif text.startswith("[CDATA[", at) and self.sink.foreign():
            self.pos, self.state = at + 7, "cdata"
        else:
            self.error("cdata-in-html-content" if text.startswith("[CDATA[", at) else "incorrectly-opened-comment", at)
            self.bogus_comment(at)

    def tell_comment(self, data: str) -> None:
        self.flush()
        data = data.replace("\0", "�")
        if self.xml:
            data = data.replace("--", "- -")
        self.sink.comment(data)

    def bogus_comment(self, at: int) -> None:
        end = self.text.find(">", at)
        end = len(self.text) if end < 0 else end
        self.pos = end + 1
        self.tell_comment(self.text[at:end])

    def comment(self, at: int) -> None:
        text = self.text
        for short in (">", "->"):
            if text.startswith(short, at):
                self.error("abrupt-closing-of-empty-comment", at + len(short) - 1)
                self.pos = at + len(short)
                self.tell_comment("")
                return
        m = COMMENT_END.search(text, at)
        if m:
            if m[0] == "--!>":
                self.error("incorrectly-closed-comment", m.end() - 1)
            data, self.pos = text[at : m.start()], m.end()
        else:
            self.error("eof-in-comment", len(text))
            data, self.pos = re.sub(r"--!?$|-$", "", text[at:]), len(text)
        if self.errors is not None and "<!--" in data[:-1]:
            self.error("nested-comment", at + data.index("<!--") + 3)
        self.tell_comment(data)

    def doctype(self, at: int) -> None:
        text, n = self.text, len(self.text)
        if at < n and text[at] not in SPACE + ">":
            self.error("missing-whitespace-before-doctype-name", at)
        at = SKIP.match(text, at).end()
        name = public = system = None
        quirks = False

        def finish(at: int) -> None:
            self.pos = at
            self.flush()
            self.sink.doctype(name, public, system, quirks)

        def identifier(at: int) -> tuple[str, int, bool]:
            """The quoted identifier at `at`, what follows it, and whether it was closed."""
            m = re.compile(rf"[^{text[at]}>]*").match(text, at + 1)
            closed = text[m.end() : m.end() + 1] == text[at]
            return m[0].replace("\0", "�"), m.end() + closed, closed

        def bogus(at: int) -> None:
            end = text.find(">", at)
            finish(n if end < 0 else end + 1)

        if at >= n or text[at] == ">":
            self.error("eof-in-doctype" if at >= n else "missing-doctype-name", at)
            quirks = True
            return finish(at + 1)
        m = re.compile(r"[^\t\n\f >]*").match(text, at)
        name = ascii_lower(m[0]).replace("\0", "�")
        at = SKIP.match(text, m.end()).end()
        if at >= n:
            self.error("eof-in-doctype", n)
            quirks = True
            return finish(n)
        if text[at] == ">":
            return finish(at + 1)
        keyword = text[at : at + 6].lower()
        if keyword not in ("public", "system"):
            self.error("invalid-character-sequence-after-doctype-name", at)
            quirks = True
            return bogus(at)
        if text[at + 6 : at + 7] in ('"', "'") and at + 6 < n:
            self.error(f"missing-whitespace-after-doctype-{keyword}-keyword", at + 6)
        at = SKIP.match(text, at + 6).end()
        if text[at : at + 1] not in ('"', "'") or at >= n:
            self.error("eof-in-doctype" if at >= n else f"missing-doctype-{keyword}-identifier" if text[at] == ">" else f"missing-quote-before-doctype-{keyword}-identifier", at)
            quirks = True
            return bogus(at)
        value, at, closed = identifier(at)
        if keyword == "public":
            public = value
            if closed:
                if text[at : at + 1] in ('"', "'") and at < n:
                    self.error("missing-whitespace-between-doctype-public-and-system-identifiers", at)
                at = SKIP.match(text, at).end()
                if text[at : at + 1] in ('"', "'") and at < n:
                    system, at, closed = identifier(at)
                elif at < n and text[at] != ">":
                    self.error("missing-quote-before-doctype-system-identifier", at)
                    quirks = True
                    return bogus(at)
        else:
            system = value
        if not closed:
            self.error("eof-in-doctype" if at >= n else f"abrupt-doctype-{keyword}-identifier", at)
            quirks = True
            return bogus(at)
        at = SKIP.match(text, at).end()
        if at >= n:
            self.error("eof-in-doctype", n)
            quirks = True
        elif text[at] != ">":
            self.error("unexpected-character-after-doctype-system-identifier", at)
        bogus(at)
