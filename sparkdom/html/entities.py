"""Character references in text and in attribute values."""

from __future__ import annotations

import re
from html.entities import html5

NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
#: Names that count without their semicolon too.
LEGACY = {k: v for k, v in html5.items() if not k.endswith(";")}
LONGEST_LEGACY = max(map(len, LEGACY))
REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z][A-Za-z0-9]{0,31})(;?))")
#: What the numbers 0x80 to 0x9F stand for: windows-1252, where it has a character.
WINDOWS = {n: c for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "ignore"))}


def numeric(n: int) -> str:
    if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        return "�"
    return WINDOWS.get(n) or chr(n)


def decode(text: str, in_attribute: bool = False) -> str:
    """Replace references; in attributes a name without semicolon stays before a letter, a digit or "="."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            digits = (m[1] or m[2]).lstrip("0") or "0"
            return "�" if len(digits) > 8 else numeric(int(digits, 16 if m[1] else 10))
        name = m[3]
        if m[4] and name in NAMED:
            return NAMED[name]
        for n in range(min(len(name), LONGEST_LEGACY), 1, -1):
            if name[:n] in LEGACY:
                rest = name[n:] + m[4]
                after = rest or text[m.end() : m.end() + 1]
                if in_attribute and after and (after[0] == "=" or after[0].isascii() and after[0].isalnum()):
                    return m[0]
                return LEGACY[name[:n]] + rest
        return m[0]

    return REFERENCE.sub(one, text)
