"""Selectors to columns over the nodes table: filters, windows and running maxima, no loop over nodes.

One flag per compound is carried from left to right:

    descendant   the running maximum of last_id over flagged nodes reaches this node
    child        the flag of the row before the first child, which in preorder is the parent
    +            the flag of the element before, by lag
    ~            the running maximum of the flag over earlier element siblings

Every predicate is two-valued: NULL counts as false before anything is negated.

Where only the matches are wanted, rows that fit no compound are dropped below the exchange,
and what a compound asks of the row itself crosses it as a boolean. A parent or a brother may
then be missing in front of a row, so `>` gives every flagged row a second copy at the head
of its children, which hands the flag to them, and `+` looks at the number of the row before.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdom.plans.css import Complex, SelectorList, Simple, parse_selector


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _html() -> Column:
    return F.coalesce(F.col("ns"), F.lit("html")) == "html"


def _attr(name: str, test) -> Column:
    """test of the attribute's value, under the lower-cased name in html and the name as it is elsewhere."""
    lower = name.lower()
    if lower == name:
        return F.map_contains_key("attrs", F.lit(name)) & _sure(test(F.coalesce(F.col("attrs")[name], F.lit(""))))
    return F.when(_html(), F.map_contains_key("attrs", F.lit(lower)) & _sure(test(F.coalesce(F.col("attrs")[lower], F.lit(""))))).otherwise(F.map_contains_key("attrs", F.lit(name)) & _sure(test(F.coalesce(F.col("attrs")[name], F.lit("")))))


def _word(text: Column, word: str) -> Column:
    return F.array_contains(F.split(text, r"[\t\n\x0B\f\r ]+"), word)


def _compare(op: str, want: str):
    if op == "":
        return lambda x: F.lit(True)
    if op == "=":
        return lambda x: x == want
    if op == "|=":
        return lambda x: (x == want) | x.startswith(want + "-")
    if not want:
        return lambda x: F.lit(False)
    return {"~=": lambda x: _word(x, want), "^=": lambda x: x.startswith(want), "$=": lambda x: x.endswith(want), "*=": lambda x: x.contains(want)}[op]


def _nth(a: int, b: int, p: Column) -> Column:
    if a == 0:
        return p == b
    return ((p >= b) & ((p - b) % a == 0)) if a > 0 else ((p <= b) & ((F.lit(b) - p) % (-a) == 0))


class Compiler:
    """Adds flag columns to a nodes table; `_f0`, `_f1`, ... are dropped by the caller."""

    def __init__(self, nodes: DataFrame, key: str):
        self.df, self.key, self.n = nodes, key, 0
        #: By compound, the flag of what it asks of the row itself; empty unless narrow() dropped the other rows.
        self.own: dict[tuple[Simple, ...], str] = {}

    def narrow(self, selectors: list[SelectorList], keep: Column | None = None) -> None:
        """Drop rows that fit no compound of the selectors, and that keep does not hold for; then deal out by key."""
        for s in selectors:
            self.prepare(s)
        wanted = [F.col(f) for f in self.own.values()]
        self.df = self.df.where(reduce(or_, wanted if keep is None else [*wanted, keep])).repartition(self.key)

    def prepare(self, selector: SelectorList) -> None:
        for simples in (c for b in selector.branches for c in b.compounds):
            for s in simples:
                if s.inner is not None:
                    self.prepare(s.inner)
            if simples not in self.own:
                name = self.add(self.every(tuple(s for s in simples if s.inner is None)))
                self.own[simples] = name

    def add(self, column: Column) -> str:
        name = f"_f{self.n}"
        self.n += 1
        self.df = self.df.withColumn(name, column)
        return name

    def simple(self, s: Simple) -> Column:
        if s.kind == "any":
            return F.lit(True)
        if s.kind == "tag":
            return F.when(_html(), F.lower("name") == s.name.lower()).otherwise(F.col("name") == s.name)
        if s.kind == "id":
            return F.col("attrs")["id"] == s.value
        if s.kind == "class":
            return _word(F.col("attrs")["class"], s.value)
        if s.kind == "attr":
            return _attr(s.name, _compare(s.op, s.value))
        name = s.name
        if name == "not":
            return ~F.col(self.list(s.inner))
        if name == "root":
            return F.col("depth") == 1
        if name == "empty":
            return F.col("is_empty")
        kind = "type" if "of-type" in name else "elem"
        p, n = F.col(f"{kind}_pos"), F.col(f"{kind}_cnt")
        if s.nth is not None:
            return _nth(*s.nth, p)
        first, last = p == 1, p == n
        return first & last if name.startswith("only") else first if name.startswith("first") else last

    def every(self, simples: tuple[Simple, ...], out: Column | None = None) -> Column:
        out = F.col("kind").isin("element", "doctype") if out is None else out
        for s in simples:
            out = out & _sure(self.simple(s))
        return out

    def compound(self, simples: tuple[Simple, ...]) -> Column:
        if simples not in self.own:
            return self.every(simples)
        return self.every(tuple(s for s in simples if s.inner is not None), F.col(self.own[simples]))

    def complex(self, c: Complex) -> str:
        flag = self.add(self.compound(c.compounds[0]))
        for how, simples in zip(c.combinators, c.compounds[1:], strict=True):
            own = self.add(self.compound(simples))
            flag = self.add(F.col(own) & (F.col(self.child(flag)) if how == ">" else self.carried(how, flag)))
        return flag

    def carried(self, how: str, flag: str) -> Column:
        tree = Window.partitionBy(self.key, "tree_id").orderBy("node_id")
        siblings = Window.partitionBy(self.key, "tree_id", "parent_id", F.col("kind").isin("element", "doctype")).orderBy("node_id")
        before = (Window.unboundedPreceding, -1)
        if how == " ":
            return _sure(F.max(F.when(F.col(flag), F.col("last_id"))).over(tree.rowsBetween(*before)) >= F.col("node_id"))
        if how == "+":
            near = F.lag("node_id").over(siblings) == F.col("prev_elem_id") if self.own else F.lit(True)
            return _sure(F.lag(flag).over(siblings) & near)
        return _sure(F.max(flag).over(siblings.rowsBetween(*before)))

    def child(self, flag: str) -> str:
        """The parent's flag, without a join: the row before a first child is the parent, and its siblings take it from there."""
        if self.own:
            return self.child_of_few(flag)
        tree = Window.partitionBy(self.key, "tree_id").orderBy("node_id")
        family = Window.partitionBy(self.key, "tree_id", "parent_id").orderBy("node_id")
        before = self.add(F.when(F.lag("node_id").over(tree) == F.col("parent_id"), F.lag(flag).over(tree)))
        return self.add(_sure(F.first(before).over(family)))

    def child_of_few(self, flag: str) -> str:
        """The same where parents may be missing: copies of the flagged rows head their children, one sort and no second exchange."""
        head, family, out = f"_h{self.n}", f"_p{self.n}", f"_f{self.n}"
        self.n += 1
        heads = F.when(F.col(flag), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        rows = self.df.withColumn(head, F.explode(heads))
        rows = rows.withColumn(family, F.when(F.col(head), F.col("node_id")).otherwise(F.col("parent_id")))
        w = Window.partitionBy(self.key, "tree_id", family).orderBy(F.desc(head))
        self.df = rows.withColumn(out, _sure(F.first(head).over(w))).where(~F.col(head)).drop(head, family)
        return out

    def list(self, selector: SelectorList) -> str:
        flags = [self.complex(c) for c in selector.branches]
        out = F.col(flags[0])
        for f in flags[1:]:
            out = out | F.col(f)
        return flags[0] if len(flags) == 1 else self.add(out)


def looks_around(selector: str | SelectorList) -> bool:
    """Whether any part of a selector depends on other rows than the node's own."""
    parsed = parse_selector(selector) if isinstance(selector, str) else selector
    return any(b.combinators or any(s.inner is not None and looks_around(s.inner) for c in b.compounds for s in c) for b in parsed.branches)


def flag(nodes: DataFrame, selector: str, key: str, name: str = "matched") -> DataFrame:
    """nodes with a boolean column that says which match."""
    compiler = Compiler(nodes, key)
    last = compiler.list(parse_selector(selector))
    return compiler.df.withColumn(name, F.col(last)).select(*nodes.columns, name)


def flag_parent(nodes: DataFrame, selector: str, key: str, name: str = "matched") -> DataFrame:
    """nodes with a boolean column that says whose parent matches."""
    compiler = Compiler(nodes, key)
    last = compiler.child(compiler.list(parse_selector(selector)))
    return compiler.df.withColumn(name, F.col(last)).select(*nodes.columns, name)


def flag_inside(nodes: DataFrame, selector: str, key: str, name: str = "inside", itself: bool = False) -> DataFrame:
    """nodes with a boolean column that says which lie below a match (or are one)."""
    compiler = Compiler(nodes, key)
    last = compiler.list(parse_selector(selector))
    reach = compiler.carried(" ", last)
    return compiler.df.withColumn(name, F.col(last) | reach if itself else reach).select(*nodes.columns, name)


def flag_few(nodes: DataFrame, selector: str, key: str, name: str = "matched", inside: str | None = None, keep: Column | None = None) -> DataFrame:
    """flag over the rows that selector or inside look at, or that keep holds for; the others go before the one shuffle. inside: only below its matches."""
    parsed, scope = parse_selector(selector), None if inside is None else parse_selector(inside)
    compiler = Compiler(nodes, key)
    compiler.narrow([parsed] if scope is None else [parsed, scope], keep)
    out = F.col(compiler.list(parsed))
    if scope is not None:
        out = out & compiler.carried(" ", compiler.list(scope))
    return compiler.df.withColumn(name, out).select(*nodes.columns, name)
