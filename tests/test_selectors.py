"""Selectors: cases, and the relational compiler against the pointer matcher on random forests."""

from __future__ import annotations

import random

import pytest

from sparkdom.html.dom import Node
from sparkdom.html.encode import encode
from sparkdom.html.parse import parse
from sparkdom.operators.parse import nodes, parse_pages
from sparkdom.operators.select import query, select, with_text
from sparkdom.plans.css import SelectorError, parse_selector
from sparkdom.plans.matcher import find, matches, query as query_tree, query_first
from sparkdom.plans.targeted import compile_targeted, stops_early


def count(html, selector):
    return len(query_tree(parse(html).root, selector))


SHOP = """<!DOCTYPE html><title>Shop</title><main id=shop>
<ul class="list wide"><li id=one data-price="10">Tea</li><li data-price="25" lang="en-GB">Cup <em>blue</em></li><li data-price="10 off" class="sale new">Pot</li><li></li></ul>
<section><h2>About</h2><p class="x:y 9to5">Open</p><!-- note --><p title="a]b">Closed</p></section>
<svg viewBox="0 0 9 9"><radialGradient id=g /></svg><template id=t class=t><p>later</p></template></main><footer><p>End</p></footer>"""


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("#shop p", ["Open", "Closed"]), ("main > ul em", ["blue"]), (".wide > li + li em", ["blue"]), ("li ~ li", ["Cup blue", "Pot", ""]), ("ul.list, h2", ["TeaCup bluePot", "About"]),
        ("[data-price='10']", ["Tea"]), ("[data-price~=off]", ["Pot"]), ("[lang|=en]", ["Cup blue"]), ("[data-price^='1']", ["Tea", "Pot"]), ("[data-price$='5']", ["Cup blue"]), ("[data-price*=o]", ["Pot"]),
        ("li:nth-child(even)", ["Cup blue", ""]), ("li:nth-child(3n+1)", ["Tea", ""]), ("li:not([class]):not(:empty)", ["Tea", "Cup blue"]), ("section :first-of-type", ["About", "Open"]), ("section p:last-child", ["Closed"]),
        (".x\\:y", ["Open"]), (".\\39to5", ["Open"]), (".\\39 to5", ["Open"]), ("\\66ooter p", ["End"]), ("p[title='a]b']", ["Closed"]), ("p:not([title='a]b']):not(.x\\:y)", ["later", "End"]), ("[title='a\\\n]b']", ["Closed"]),
        ("#t p", []), ("template.t p", []), ("template p", []), ("p:only-child", ["later", "End"]), (" h2 , em ", ["blue", "About"]), ("MAIN H2", ["About"]),
        ("radialGradient#g", [""]), ("radialgradient", []), ("svg[viewBox]", [""]), ("svg[viewbox]", []), ("ul > :empty", [""]),
    ],
)
def test_cases(selector, want):
    assert [n.to_text() for n in query_tree(parse(SHOP).root, selector)] == want


def test_roots_and_firsts():
    doc = parse(SHOP).root
    assert query_first(doc, "li").to_text() == "Tea" and query_first(doc, "#nowhere") is None
    # a doctype counts among the elements
    assert count("<!DOCTYPE html><h2>x</h2>", ":root") == 2 and count(SHOP, "html:first-child") == 0
    assert count("<hr noshade><hr>", "[noshade]") == 1 and count("<hr noshade>", "[noshade='']") == 1


def test_built_nodes():
    svg = Node.element("svg", ns="svg")
    camel, lower = svg.append_child(Node.element("linearGradient", ns="svg")), svg.append_child(Node.element("lineargradient", ns="svg"))
    assert matches(camel, ":only-of-type") and matches(lower, ":nth-of-type(1)") and not matches(lower, ":nth-of-type(2)")
    div = Node.element("div")
    upper, low = div.append_child(Node.element("DIV")), div.append_child(Node.element("div"))
    assert matches(upper, ":first-of-type") and matches(low, ":nth-of-type(2)")
    span = Node.element("span", {"data-x": None})
    assert matches(span, "[data-x]") and matches(span, '[data-x=""]') and not matches(span, "[data-x^=a]") and not matches(span, "[data-y]")


@pytest.mark.parametrize("bad", ["", " ", ":not", ":not()", ":nth-child", ":nth-child()", ":nth-child(foo)", ":nth-of-type()", "div,", "div,,p", "div, ,p", ",p", "a >", "[a=v i]", "[a", "'", "a\\", ":hover", ":has(a)", ":nth-last-child(1)", "[a='x]", "..a", "a:not(b"])
def test_errors(bad):
    with pytest.raises(SelectorError):
        parse_selector(bad)


def test_targeted():
    for good in ("p", "div > p.x", "#a b, c", "p:first-child", "li:not(.x)", "td:nth-of-type(2)"):
        compile_targeted(good)
    for bad in ("a + b", "a ~ b", ":empty", "p:last-child", ":root", "p:not(a + b)", "p:only-child"):
        with pytest.raises(SelectorError):
            compile_targeted(bad)
    assert stops_early(parse_selector("p.x"), 1) and not stops_early(parse_selector("p, body"), 1) and not stops_early(parse_selector("p"), 2)


SELECTORS = ["*", "div", "div p", "div > p", "li + li", "li ~ li", "div > p > b", "p:first-child", "p:last-child", ":only-child", "li:nth-child(2n+1)", "p:nth-of-type(-n+2)", ":root", ":empty", "div:not(.x)", ":not(div p)", "div:not(.x > .y), #a", "[class~=y]", "[data-q^='1']", "#a > .x ~ *", "svg *", "template div", "b:only-of-type", "div + p ~ span"]
HAZARDS = [
    "<title>t</title>", "<p>a<p>b", "<table>x<tr><td>y</table>z", "<b><p>x</b>y", "<body class=a><p>x</p><body id=b>", "<p>x</p><html id=late>", "<template><div><p>x</template><p>y",
    "<select><option>a<selectedcontent></select>", "<frameset><frame></frameset>", "<svg><foreignObject><p>x</svg>", "<math><mi><p>x</math>", "<br><hr><img>", "<plaintext><p>", "<h1>a<h2>b", "<ul><li>a<ul><li>b</ul><li>c</ul>",
]


def forest(rng: random.Random) -> str:
    out = ["<!DOCTYPE html>"] * rng.randint(0, 1)
    for _ in range(rng.randint(5, 50)):
        tag = rng.choice("div p ul li span b table tr td template svg title a br".split())
        r = rng.random()
        out.append(f"<{tag}{rng.choice(['', ' class=`x y`', ' id=a', ' class=z data-q=`1 2`']).replace('`', chr(39))}>" if r < 0.6 else f"</{tag}>" if r < 0.9 else rng.choice(["txt", " ", "<!-- c -->", "a&amp;b"]))
    return "".join(out)


@pytest.fixture(scope="module")
def forests(spark):
    rng = random.Random(5)
    docs = HAZARDS + [forest(rng) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(docs)), "page_id long, html string")
    return docs, table, parse_pages(table).cache()


def order_of(root):
    out = [root]

    def go(n):
        for c in n.children or ():
            out.append(c)
            go(c)
        if n.content is not None:
            out.append(n.content)
            go(n.content)

    go(root)
    return out


@pytest.mark.parametrize("selector", SELECTORS)
def test_relational_is_pointer(forests, selector):
    docs, _, pages = forests
    got = sorted(tuple(r) for r in query(pages, selector).select("page_id", "node_id").collect())
    want = []
    for i, html in enumerate(docs):
        root = parse(html).root
        at = {id(n): k for k, n in enumerate(order_of(root))}
        want += [(i, at[id(n)]) for n in find(root, selector)]
    assert got == sorted(want)


def test_exchanges(spark):
    """One exchange for any number of combinators, none without, and never a join."""
    pages = parse_pages(spark.createDataFrame([(1, "<p>")], "page_id long, html string"))
    for selector, want in (("nav > ul > li > a", 1), ("nav a, li + li ~ b", 1), ("li:not(.x):first-child", 0), ("p:not(div p)", 1)):
        plan = query(pages, selector)._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan
        assert plan.count("RepartitionByExpression") + plan.count("Exchange") == want


def test_few_rows_cross_the_exchange(spark):
    """Rows that no compound fits stay below the exchange."""
    html = "<nav><ul>" + "<li><a href=/x>t</a><p><b>u</b><i>v</i></p></li>" * 20 + "</ul></nav>" + "<p>w<b>z</b>" * 200
    pages = parse_pages(spark.createDataFrame([(k, html) for k in range(4)], "page_id long, html string"))
    df = query(pages, "nav > ul > li > a").select("page_id", "node_id")
    assert len(df.collect()) == 80
    assert _rows_exchanged(df) == 4 * 42 < nodes(pages).count() / 10


def _rows_exchanged(df) -> int:
    """Records that the plan of a collected DataFrame wrote for its exchange."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        elif name == "Exchange":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        else:
            children = plan.children()
            todo += [children.apply(k) for k in range(children.size())]
    assert len(found) == 1
    return found[0]


def test_fused_is_relational(forests):
    _, table, pages = forests
    for selector in ("div p", "li:first-child", "p.x, #a", "template div"):
        fused = select(table, selector, ("name", "text", "outer_html"), targeted=True).collect()
        rel = with_text(query(pages, selector), pages).orderBy("page_id", "node_id").select("page_id", "name", "text", "outer_html").collect()
        assert sorted(map(tuple, fused)) == sorted(map(tuple, rel))


MISNESTED = ["<p><b>x<p>y</b>z", "<b><p>x</p></b><p>y", "<b><div><p>x</p></div>y</b>", "<i><b><p>a</p></i>b</b>c", "<a><p>x</p><a>y", "<p><b><i>x<p>y</i>z</b>", "<b><table><td><p>x</p></table></b>", "<p><nobr>x<p>y<nobr>z", "<b>1<p>2</b>3<p>4", "<p><font>a<div class=x>b</font>c</div>"]
EARLY = ["title", "p", "div p", "div > p", "p.x", "#a", ".z", "li:first-child", "p:nth-of-type(2)", "b, #a", "td", "template div", "span.x, li", "ul > li", "table p", "svg a"]


def test_early_is_query_first():
    from sparkdom.html.serialize import compact
    from sparkdom.plans.early import decidable, find_early, find_first

    rng = random.Random(12)
    for selector in EARLY:
        parsed = compile_targeted(selector)
        assert decidable(parsed)
        for html in HAZARDS + MISNESTED + [forest(rng) for _ in range(250)]:
            got, want = find_first(html, parsed), query_first(parse(html).root, selector)
            assert (got and compact(got), got and got.attrs) == (want and compact(want), want and want.attrs), (selector, html)
            whole = [(compact(n), n.attrs) for n in query_tree(parse(html).root, selector)]
            for limit in (2, 5):
                assert [(compact(n), n.attrs) for n in find_early(html, parsed, limit)] == whole[:limit], (selector, html, limit)
    assert not any(decidable(compile_targeted(s)) for s in ("*", "body", ":first-child", "p:not(.x)", ".a p", "html", "[x]"))
    head = "<!DOCTYPE html><title>a</title>"
    assert find_first(head + "<p>" * 200_000, compile_targeted("title")).to_text() == "a"
    seen: dict[str, int] = {}
    items = "".join(f"<li>{i}</li>" for i in range(50_000))
    assert [n.to_text() for n in find_early(f"<ul>{items}</ul>", compile_targeted("li"), 3, statistics=seen)] == ["0", "1", "2"] and seen["read"] < 100


def test_slices(forests):
    docs, _, pages = forests
    from sparkdom.html.serialize import compact

    trees = {}
    for r in with_text(nodes(pages), pages).select("page_id", "node_id", "raw_text", "text", "outer_html").collect():
        order = trees.setdefault(r[0], order_of(parse(docs[r[0]]).root))
        n = order[r[1]]
        if n.kind == "text":  # alone it is escaped even if its parent holds raw text
            continue
        assert (n.text_content, n.to_text(), compact(n)) == tuple(r)[2:]


def test_rows():
    rows, texts, html = encode(parse("<p>a<b>c</b></p><template><i>t</i></template>").root)
    assert [r["name"] for r in rows] == ["#document", "html", "head", "body", "p", "#text", "b", "#text", "template", "#document-fragment", "i", "#text"]
    assert texts == ["ac", "t"] and html == "<html><head></head><body><p>a<b>c</b></p><template><i>t</i></template></body></html>"
    assert [r["last_id"] for r in rows][:5] == [11, 11, 2, 11, 7] and rows[9]["tree_id"] == 1 and rows[9]["owner_id"] == 8
