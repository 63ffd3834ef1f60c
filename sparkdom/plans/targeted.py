"""What targeted extraction accepts, and literals that a page must hold to match at all."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdom.plans.css import SelectorError, SelectorList, Simple, parse_selector

ALLOWED_PSEUDO = ("first-child", "nth-child", "first-of-type", "nth-of-type", "not")
#: Elements that come to be without a tag of theirs.
IMPLIED = ("html", "head", "body", "tbody", "tr", "colgroup", "p", "br", "img")
SAFE = re.compile(r"[A-Za-z0-9_-]+$")


def _check(selector: SelectorList) -> None:
    for branch in selector.branches:
        if bad := [c for c in branch.combinators if c not in (" ", ">")]:
            raise SelectorError(f"targeted selection has no combinator {bad[0]!r}")
        for compound in branch.compounds:
            for s in compound:
                if s.kind == "pseudo":
                    if s.name not in ALLOWED_PSEUDO:
                        raise SelectorError(f"targeted selection has no :{s.name}")
                    if s.inner is not None:
                        _check(s.inner)


def compile_targeted(selector: str) -> SelectorList:
    """Parse a selector of the subset; raised here, on the driver, if it is not in it."""
    parsed = parse_selector(selector)
    _check(parsed)
    return parsed


def _needed(s: Simple, html: Column, lower: Column) -> Column | None:
    if s.kind in ("id", "class") and SAFE.match(s.value):
        return html.contains(s.value)
    if s.kind == "tag" and SAFE.match(s.name) and s.name.lower() not in IMPLIED:
        return lower.contains("<" + s.name.lower())
    return None


def may_match(selector: SelectorList, html: Column) -> Column | None:
    """A condition on the raw page that every match needs; None if there is none to be had.

    Ids and classes may be spelled with character references, so a page with an ampersand,
    or with a null character, stays.
    """
    lower = F.lower(html)
    branches = []
    for branch in selector.branches:
        needs = [n for s in branch.compounds[-1] if (n := _needed(s, html, lower)) is not None]
        if not needs:
            return None
        one = needs[0]
        for n in needs[1:]:
            one = one & n
        branches.append(one)
    out = branches[0]
    for b in branches[1:]:
        out = out | b
    return F.coalesce(out | html.contains("&") | html.contains("\0"), F.lit(False))


def stops_early(selector: SelectorList, limit: int | None) -> bool:
    """Whether a limit of one and a subject of its own make the targeted path the better one."""
    def own(branch) -> bool:
        return any(s.kind in ("id", "class") or s.kind == "tag" and s.name.lower() not in ("html", "body") for s in branch.compounds[-1])

    return limit == 1 and all(map(own, selector.branches))
