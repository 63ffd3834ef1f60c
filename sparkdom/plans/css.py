"""CSS selectors to a tree of frozen records."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Simple:
    """kind: any, tag, id, class, attr, pseudo."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    #: an+b of nth selectors
    nth: tuple[int, int] | None = None
    inner: SelectorList | None = None


@dataclass(frozen=True)
class Complex:
    """Compounds from left to right, each with the combinator before it."""

    compounds: tuple[tuple[Simple, ...], ...]
    combinators: tuple[str, ...]


@dataclass(frozen=True)
class SelectorList:
    branches: tuple[Complex, ...]


IDENT = re.compile(r"(?:[\w\-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\n\f\r])?|[^\n\f\r]))+")
ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\f\r])?|(\r\n|[\n\f\r])|(.)|$)", re.S)
SPACE = re.compile(r"[ \t\n\f\r]*")
NTH = re.compile(r"([+-]?\d*)n(?:[ \t\n\f\r]*([+-])[ \t\n\f\r]*(\d+))?$|([+-]?\d+)$", re.I)
OPERATORS = ("~=", "|=", "^=", "$=", "*=", "=")
PLAIN_PSEUDO = ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "empty", "root")
NTH_PSEUDO = ("nth-child", "nth-of-type")


def unescape(text: str, in_string: bool = False) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            n = int(m[1], 16)
            return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)
        if m[2]:
            return "" if in_string else m[2]
        if m[3] is None:
            raise SelectorError("the selector ends in a backslash")
        return m[3]

    return ESCAPE.sub(one, text)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def space(self) -> bool:
        end = SPACE.match(self.text, self.at).end()
        moved, self.at = end > self.at, end
        return moved

    def ident(self, what: str) -> str:
        m = IDENT.match(self.text, self.at)
        if not m:
            if self.peek() == "\\":
                raise SelectorError("the selector ends in a backslash" if self.at == len(self.text) - 1 else "a bad escape")
            raise SelectorError(f"expected {what} at {self.at} in {self.text!r}")
        self.at = m.end()
        return unescape(m[0])

    def string(self) -> str:
        quote, start = self.peek(), self.at + 1
        at = start
        while at < len(self.text) and self.text[at] != quote:
            at += 2 if self.text[at] == "\\" else 1
        if at >= len(self.text):
            raise SelectorError("a string is not closed")
        self.at = at + 1
        return unescape(self.text[start:at], True)

    def list(self, closing: str = "") -> SelectorList:
        out = []
        while True:
            out.append(self.complex(closing))
            if self.peek() != ",":
                break
            self.at += 1
        return SelectorList(tuple(out))

    def complex(self, closing: str) -> Complex:
        self.space()
        if self.at >= len(self.text) or self.peek() in (",", closing):
            raise SelectorError("an empty selector")
        compounds, combinators = [self.compound()], []
        while True:
            spaced = self.space()
            c = self.peek()
            if not c or c == "," or c == closing:
                return Complex(tuple(compounds), tuple(combinators))
            if c in ">+~":
                self.at += 1
                self.space()
                combinators.append(c)
            elif spaced:
                combinators.append(" ")
            else:
                raise SelectorError(f"unexpected {c!r} at {self.at} in {self.text!r}")
            compounds.append(self.compound())

    def compound(self) -> tuple[Simple, ...]:
        out: list[Simple] = []
        while c := self.peek():
            if c == "*" and not out:
                self.at += 1
                out.append(Simple("any"))
            elif c == "#":
                self.at += 1
                out.append(Simple("id", value=self.ident("an id")))
            elif c == ".":
                self.at += 1
                out.append(Simple("class", value=self.ident("a class")))
            elif c == "[":
                out.append(self.attribute())
            elif c == ":":
                out.append(self.pseudo())
            elif not out and (IDENT.match(self.text, self.at) or c == "\\"):
                out.append(Simple("tag", self.ident("a name")))
            else:
                break
        if not out:
            raise SelectorError(f"expected a selector at {self.at} in {self.text!r}")
        return tuple(out)

    def attribute(self) -> Simple:
        self.at += 1
        self.space()
        name = self.ident("an attribute")
        self.space()
        op = next((o for o in OPERATORS if self.text.startswith(o, self.at)), "")
        value = ""
        if op:
            self.at += len(op)
            self.space()
            value = self.string() if self.peek() in ('"', "'") and self.peek() else self.ident("a value")
            self.space()
        if self.peek() != "]":
            raise SelectorError("Expected ]")
        self.at += 1
        return Simple("attr", name, op, value)

    def pseudo(self) -> Simple:
        self.at += 1
        name = self.ident("a pseudo-class").lower()
        called = self.peek() == "("
        if called:
            self.at += 1
            self.space()
        if name == "not":
            if not called or self.peek() in (")", ""):
                raise SelectorError(":not() needs a selector")
            inner = self.list(")")
            self.close()
            return Simple("pseudo", name, inner=inner)
        if name in NTH_PSEUDO:
            end = self.text.find(")", self.at)
            if not called or end < 0:
                raise SelectorError(f":{name}() needs an argument")
            raw, self.at = self.text[self.at : end], end + 1
            return Simple("pseudo", name, nth=nth(raw))
        if name not in PLAIN_PSEUDO or called:
            raise SelectorError(f"unsupported pseudo-class :{name}")
        return Simple("pseudo", name)

    def close(self) -> None:
        self.space()
        if self.peek() != ")":
            raise SelectorError("expected )")
        self.at += 1


def nth(raw: str) -> tuple[int, int]:
    text = raw.strip(" \t\n\f\r").lower()
    if text in ("odd", "even"):
        return (2, 1 if text == "odd" else 0)
    m = NTH.match(text)
    if not m:
        raise SelectorError(f"bad an+b: {raw!r}")
    if m[4]:
        return 0, int(m[4])
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int((m[2] or "+") + (m[3] or "0"))


@lru_cache(maxsize=256)
def parse_selector(text: str) -> SelectorList:
    reader = _Reader(text)
    if not text.strip(" \t\n\f\r"):
        raise SelectorError("an empty selector")
    out = reader.list()
    if reader.at != len(text):
        raise SelectorError(f"unexpected {reader.peek()!r} at {reader.at} in {text!r}")
    return out
