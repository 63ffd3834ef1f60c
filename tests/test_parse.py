"""Tokenizer, tree construction, entities, serializers and Markdown, on inline documents."""

from __future__ import annotations

import time

import pytest

from sparkdom.html.dom import HierarchyError, Node
from sparkdom.html.entities import decode, numeric
from sparkdom.html.markdown import to_markdown
from sparkdom.html.parse import StrictError, events, parse
from sparkdom.html.serialize import SerializeError, compact, end_tag, start_tag, to_html, to_test_format


def dump(html, **options):
    return to_test_format(parse(html, **options).root).split("\n")


def body(html):
    return compact(parse(html).root.children[-1].children[-1])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<br>b</p>", "<p>a<br>b</p>"),
        ("<p>a<hr>b</p>", "<p>a</p><hr>b<p></p>"),
        ("x</br>y", "x<br>y"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<a>1<div>2<a>3</a></div>", "<a>1</a><div><a>2</a><a>3</a></div>"),
        ("<b>1<div>2<div>3<div>4</b>5", "<b>1</b><div><b>2</b><div><b>3</b><div><b>4</b>5</div></div></div>"),
        ("<table><tr><td>a</td></tr>foo<b>bar</table>baz", "foo<b>bar</b><table><tbody><tr><td>a</td></tr></tbody></table><b>baz</b>"),
        ("<table> <td>x", "<table> <tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><table><td>x", "<table></table><table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><caption>c<td>x", "<table><caption>c</caption><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><col><td>x", "<table><colgroup><col></colgroup><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><input type=hidden><input><form><tr>", "<input><table><input type=hidden><form></form><tbody><tr></tr></tbody></table>"),
        ("<ul><li>1<li>2</ul>z", "<ul><li>1</li><li>2</li></ul>z"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
        ("<h1>a</h3>b", "<h1>a</h1>b"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
        ("<b><b><b><b>x<p>y", "<b><b><b><b>x<p>y</p></b></b></b></b>"),
        ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
        ("<select><option>a<option>b<optgroup><option>c</select>d", "<select><option>a</option><option>b</option><optgroup><option>c</option></optgroup></select>d"),
        ("<select><div>x</div><b>y</b><hr></select>", "<select><div>x</div><b>y</b><hr></select>"),
        ("<select><option>a</option><option selected>b</option><selectedcontent></selectedcontent></select>", "<select><option>a</option><option selected>b</option><selectedcontent>b</selectedcontent></select>"),
        ("<select><table><td>x", "<select></select><table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<ruby>a<rb>b<rt>c<rp>d", "<ruby>a<rb>b</rb><rt>c</rt><rp>d</rp></ruby>"),
        ("<form>a<form>b</form>c", "<form>ab</form>c"),
        ("<pre>\n\nx</pre><textarea>\ny</textarea>", "<pre>\nx</pre><textarea>y</textarea>"),
        ("<pre><b>\nx</b></pre>", "<pre><b>\nx</b></pre>"),
        ("<image src=a>", "<img src=a>"),
        ("<svg><circle/><foreignObject><p>x</p></foreignObject></svg>y", "<svg><circle></circle><foreignObject><p>x</p></foreignObject></svg>y"),
        ("<svg><p>x", "<svg></svg><p>x</p>"),
        ("<svg><font color=red>x", "<svg></svg><font color=red>x</font>"),
        ("<svg><font>x</font></svg>", "<svg><font>x</font></svg>"),
        ("<math><mi><b>x</b></mi><mglyph/></math>", "<math><mi><b>x</b></mi><mglyph></mglyph></math>"),
        ("<math><annotation-xml encoding=text/html><div>x", "<math><annotation-xml encoding=text/html><div>x</div></annotation-xml></math>"),
        ("<svg viewbox=1><lineargradient/></svg>", "<svg viewBox=1><linearGradient></linearGradient></svg>"),
        ("<svg><![CDATA[a<b]]></svg><![CDATA[c]]>", "<svg>a&lt;b</svg><!--[CDATA[c]]-->"),
        ("<p>a</p></body>b", "<p>a</p>b"),
        ("<template><td>x</template>y", "y"),
        ("<plaintext>a</plaintext>b", "<plaintext>a</plaintext>b</plaintext>"),
        ("<xmp><b></xmp>c", "<xmp><b></xmp>c"),
        ("<iframe><b></iframe>c", "<iframe><b></iframe>c"),
        ("<body a=1><body a=2 b=3>", ""),
    ],
)
def test_body(html, want):
    got = body(html)
    assert got.removeprefix("<body>").removesuffix("</body>") == want or got == f"<body{' a=1 b=3'}>{want}</body>"


def test_documents():
    assert dump("") == ["| <html>", "|   <head>", "|   <body>"]
    assert dump(None) == dump("")
    assert dump("<title>a</title >b") == ["| <html>", "|   <head>", "|     <title>", '|       "a"', "|   <body>", '|     "b"']
    assert dump("<frameset><frame></frameset><noframes>x</noframes>") == ["| <html>", "|   <head>", "|   <frameset>", "|     <frame>", "|   <noframes>", '|     "x"']
    assert compact(parse("<p>a</p><frameset>").root) == "<html><head></head><body><p>a</p></body></html>"
    assert compact(parse("<p></p><frameset><frame>").root) == "<html><head></head><frameset><frame></frame></frameset></html>"
    assert compact(parse("<html a=1><p><html a=2 b=3>").root) == "<html a=1 b=3><head></head><body><p></p></body></html>"
    assert compact(parse("a<!-- c --></html><!--d-->").root) == "<html><head></head><body>a<!-- c --></body></html><!--d-->"
    assert compact(parse("</head><link>x").root) == "<html><head></head><link><body>x</body></html>".replace("<head></head><link>", "<head><link></head>")
    assert "content" in "\n".join(dump("<template><p>x</template>"))


def test_quirks():
    assert parse("<p>").quirks == "quirks"
    assert parse("<!DOCTYPE html>").quirks == "no-quirks"
    assert parse('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "x">').quirks == "limited-quirks"
    assert parse('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">').quirks == "quirks"
    assert compact(parse("<p>a<table>").root).endswith("<body><p>a<table></table></p></body></html>")
    assert compact(parse("<!DOCTYPE html><p>a<table>").root).endswith("<body><p>a</p><table></table></body></html>")
    # several spaces before the keyword keep the identifiers
    assert compact(parse('<!DOCTYPE html   PUBLIC "a" "b">').root).startswith('<!DOCTYPE html PUBLIC "a" "b">')


def test_script_escapes():
    def script(html):
        return parse(html).root.children[0].children[0].children[0].inner_text()

    assert script("<script>var t='</p>';</script>") == "var t='</p>';"
    assert script("<script><!-- <script> </script> --></script>x") == "<!-- <script> </script> -->"
    assert script("<script><!-- x </script>y") == "<!-- x "
    assert script("<script><!--><script></script>") == "<!--><script>"


def test_fragments():
    assert dump("<td>x</td>", context=("tr", "html")) == ["| <td>", '|   "x"']
    assert dump("<b>x</b>", context=("textarea", "html")) == ['| "<b>x</b>"']
    assert dump("<b>x</b>&amp;", context=("title", "html")) == ['| "<b>x</b>&"']
    assert dump("<a>&amp;", context=("style", "html")) == ['| "<a>&amp;"']
    assert dump("<tr>", context=("select", "html")) == [""]
    assert dump("<circle>", context=("svg", "svg")) == ["| <svg circle>"]


def test_entities():
    assert decode("&amp;&copy;&middot&quot;&notit;&notin;&#x41;&#65&#0;&#x80;&#xD800;&#x110000;") == '&©·"¬it;∉AA�€��'
    assert decode("&copy=1 &copy1 &copy; &ampx", True) == "&copy=1 &copy1 © &ampx"
    assert decode("&nosuch; & &; &#; &#x; &#xg") == "&nosuch; & &; &#; &#x; &#xg"
    assert numeric(0x9F) == "Ÿ" and numeric(0x81) == "\x81"
    long = "&" + "a" * 2000 + ";"
    began = time.perf_counter()
    assert decode(long) == long and decode(long * 50) == long * 50
    assert time.perf_counter() - began < 2


def test_error_positions():
    def first(html, code):
        return next((line, column) for _, c, line, column in parse(html, collect_errors=True).errors if c == code)

    assert first("é<@>", "invalid-first-character-of-tag-name") == (1, 3)
    assert first("<div/\r\n>", "unexpected-character-after-solidus-in-tag") == (2, 1)
    assert first("a\rb\r<@>", "invalid-first-character-of-tag-name") == (3, 2)
    assert first("<p a=1 a=2>", "duplicate-attribute")[0] == 1
    assert first("<svg><![CDATA[x", "eof-in-cdata") == (1, 15)
    phases = [p for p, *_ in parse("<p a=1 a=2></b>", collect_errors=True).errors]
    assert phases == sorted(phases, key=["tokenizer", "tree"].index)
    with pytest.raises(StrictError):
        parse("<p a a>", strict=True)
    assert parse("<!DOCTYPE html><title>x</title>", strict=True).errors == []


def test_serializer():
    assert start_tag("a", {"b": "", "c": None, "d": "x", "e": "x y", "f": 'x"y', "g": "x\"'y", "h": "a&b", "i": "a>b"}) == "<a b c d=x e=\"x y\" f='x\"y' g=\"x&quot;'y\" h=a&amp;b i=\"a>b\">"
    assert end_tag("a") == "</a>"
    root = parse("<!DOCTYPE html><div><p>a <b>b</b></p><ul><li>x</li></ul></div><script>a<b</script>").root
    assert to_html(root).split("\n") == ["<!DOCTYPE html>", "<html>", "  <head></head>", "  <body>", "    <div>", "      <p>a <b>b</b></p>", "      <ul>", "        <li>x</li>", "      </ul>", "    </div>", "    <script>a<b</script>", "  </body>", "</html>"]
    assert compact(parse("<template><p>x</template>").root) == "<html><head><template><p>x</p></template></head><body></body></html>"
    assert compact(parse('<!DOCTYPE html SYSTEM "a">').root).startswith('<!DOCTYPE html SYSTEM "a">')
    with pytest.raises(SerializeError):
        compact(Node("doctype", "!doctype", data=("html", "a'\"b", None, False)))
    deep = parse("<div>" * 3000 + "x").root
    assert compact(deep).count("<div>") == 3000 and deep.inner_text() == "x"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<ul><li><p>one</p><p>two</p></li><li>three</li></ul>", "- one\n\n  two\n- three"),
        ("<ol><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ol>", "1. a\n   - b\n   - c\n2. d"),
        ('<a href="http://x.com/a(b) c">t</a><a>u</a>', "[t](http://x.com/a\\(b\\)%20c)[u]"),
        ("<h2>a  b</h2><p>c<br>d</p><hr><p>e", "## a b\n\nc\nd\n\n---\n\ne"),
        ("<pre>x\n y\n</pre>", "```\nx\n y\n```"),
        ("a <code>b`c</code> <em>d</em> <strong>e</strong>", "a ``b`c`` *d* **e**"),
        ("<blockquote><p>a<p>b</blockquote>", "> a\n>\n> b"),
        ("a*b_c[d]", "a\\*b\\_c\\[d\\]"),
        ("<p>x<table><tr><td>1</table>", "x\n\n<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<p>a<img src=x> b", "a<img src=x> b"),
    ],
)
def test_markdown(html, want):
    assert to_markdown(parse("<!DOCTYPE html>" + html).root) == want


def test_deep_documents():
    root = parse("<div>" * 3_000 + "x").root
    assert to_markdown(root) == "x" and len(compact(root.clone(True))) == len(compact(root)) and "x" in to_html(root) and '"x"' in to_test_format(root)


def test_text():
    root = parse("<p>a&nbsp; b\n c<!-- x --><template>t</template></p>").root
    p = root.children[0].children[1].children[0]
    assert p.text_content == "a\xa0 b\n c" and p.to_text() == "a\xa0 b c"
    assert root.text_content is None and root.to_text() == "a\xa0 b c"
    assert p.children[1].text_content == " x "
    pre = parse("<pre>\nA\r\n&amp;</pre>").root.children[0].children[1].children[0]
    assert pre.text_content == "A\n&"


def test_mutation():
    a, b, c = Node.element("div"), Node.element("p"), Node.text("x")
    a.append_child(b)
    b.append_child(c)
    with pytest.raises(HierarchyError):
        b.append_child(a)
    with pytest.raises(HierarchyError):
        a.remove_child(c)
    with pytest.raises(HierarchyError):
        Node.element("br").append_child(c)
    assert compact(a) == "<div><p>x</p></div>"
    d = a.insert_before(Node.element("i"), b)
    a.replace_child(Node.element("u"), d)
    assert compact(a) == "<div><u></u><p>x</p></div>"
    a.insert_before(b, a.children[0])
    assert compact(a) == "<div><p>x</p><u></u></div>" and d.parent is None
    t = Node.element("template")
    t.content.append_child(Node.text("y"))
    assert compact(t.clone(True)) == "<template>y</template>" and compact(t.clone()) == "<template></template>"


def test_events():
    got = [(e, d) for e, d, _ in events("<!DOCTYPE html><p a=1>x<br>&amp;<!--c--></p><svg><![CDATA[<]]></svg><title><b></title>")]
    assert [e for e, _ in got] == ["doctype", "start", "text", "start", "text", "comment", "end", "start", "text", "end", "start", "text", "end"]
    assert ("text", "<b>") in got and ("text", "<") in got and ("text", "&") in got
    for html in ("<svg><foreignObject><![CDATA[x<y]]></foreignObject></svg>", "<math><mi><![CDATA[x<y]]></mi></math>"):
        assert ("text", "x<y", None) in list(events(html))
    assert [d for e, d, _ in events("<p><![CDATA[x]]></p>") if e == "comment"] == ["[CDATA[x]]"]
    lazy = events("<p>" * 100_000)
    assert next(lazy)[0] == "start"


def test_own_sink_and_builder():
    from sparkdom.html.parse import EventSink, tokenize
    from sparkdom.html.treebuilder import TreeBuilder

    class Names(EventSink):
        def start(self, name, attrs, self_closing):
            super().start(name, attrs, self_closing)
            return "rawtext" if name == "note" else None

    sink, errors = Names(), []
    assert tokenize(b"\xef\xbb\xbf<note a a>&lt;<b></note>x", sink, errors=errors) == "utf-8"
    assert [(kind, data) for kind, data, _ in sink.events] == [("start", "note"), ("text", "&lt;<b>"), ("end", "note"), ("text", "x")]
    assert [e[0] for e in errors] == ["duplicate-attribute"]

    class Upper(TreeBuilder):
        def chars(self, text):
            super().chars(text.upper())

    assert parse("<p>a<b>b", tree_builder=Upper).root.to_text() == "AB"
