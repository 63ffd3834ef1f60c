"""Queries that put small documents, each with the page's number in it, through one operator.

Every page of the table gives a row for every case; `{}` stands for the page's number in
the input and in what is expected. The SQL says what is expected, by the HTML standard and
the Encoding Standard, without any parsing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdom import __version__
from sparkdom.cli import escapes, run as run_cli
from sparkdom.functions import sql as U
from sparkdom.html.parse import StrictError, parse
from sparkdom.html.serialize import to_html
from sparkdom.operators import parse as P
from sparkdom.plans.css import SelectorError, parse_selector
from sparkdom.plans.early import find_first
from sparkdom.plans.targeted import compile_targeted

Case = tuple[str, str | None]


def body(inside: str) -> str:
    return f"<html><head></head><body>{inside}</body></html>"


def head(inside: str) -> str:
    return f"<html><head>{inside}</head><body></body></html>"


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def text_udf(fn: Callable[[str], str | None]):
    @F.pandas_udf(T.StringType())
    def each(values: pd.Series) -> pd.Series:
        return values.map(fn)

    return each


def parsed_with(**options):
    return text_udf(lambda html: to_html(parse(html, **options).root, False))


def _strict(html: str) -> str:
    try:
        parse(html, strict=True)
    except StrictError as e:
        return e.code
    return "fine"


def _codes(html: str) -> str:
    return " ".join(code for phase, code, _, _ in parse(html, collect_errors=True).errors if phase == "tokenizer")


def _places(html: str) -> str:
    return " ".join(f"{code}@{line}:{column}" for phase, code, line, column in parse(html, collect_errors=True).errors if phase == "tokenizer")


def _selector(parse_it: Callable[[str], object]) -> Callable[[str], str]:
    def run(selector: str) -> str:
        try:
            parse_it(selector)
        except SelectorError:
            return "error"
        return "fine"

    return run


def _events(html: str) -> str:
    return "|".join(f"{event}:{name or text or ''}" for _, event, name, _, text, _ in P.event_rows(html))


def _first(selector: str) -> Callable[[str], str | None]:
    wanted = compile_targeted(selector)

    def run(html: str) -> str | None:
        node = find_first(html, wanted)
        return None if node is None else f"{node.name}:{node.to_text()}"

    return run


def _cli(arguments: str) -> str:
    """Exit code and output of a command on the page that comes before the bar."""
    page, _, line = arguments.partition("|")
    code, out, _ = run_cli(["--local", *line.split(" ")], page.encode())
    return f"{code}:{out}"


def _escapes(value: str) -> str:
    try:
        return escapes(value, "separator")
    except Exception:
        return "error"


def raw(hexed: str) -> Column:
    """Bytes given in hex, with the page's number in ASCII for the braces."""
    parts = [F.unhex(F.lit(p)) if k % 2 == 0 else F.col("page_id").cast("string").cast("binary") for k, p in enumerate(_around(hexed))]
    return F.concat(*parts)


def _around(hexed: str) -> list[str]:
    a, mark, b = hexed.partition("{}")
    return [a, "", b] if mark else [a]


def ascii_hex(text: str) -> str:
    return text.encode("ascii").hex()


tree, dump, text, plain, pretty, markdown = U.html_compact, U.html_test_format, U.html_text, U.html_raw_text, U.html_pretty, U.html_markdown
#: Operator: what is done with the inputs, and the cases.
TEXTS: dict[str, tuple[Callable, list[Case]]] = {
    "SRC12_bom_in_text": (tree, [("﻿<p>{}", body("<p>{}</p>"))]),
    "TOK1_newlines": (tree, [("<pre>a{}\r\nb\rc\n</pre>", body("<pre>a{}\nb\nc\n</pre>")), ("<p title='x\r\n{}'>", body("<p title=\"x\n{}\"></p>"))]),
    "TOK2_text_by_state": (plain, [("<title>&lt;{}</title>", "<{}"), ("<xmp>&lt;{}</xmp>", "&lt;{}"), ("<textarea>&lt;{}</textarea>", "<{}"), ("<p>&lt;{}", "<{}"), ("<plaintext>&lt;{}", "&lt;{}")]),
    "TOK3_attributes": (tree, [("<p a=1 A=2 b=&lt;{}>x", body("<p a=1 b=<{}>x</p>")), ("<p b='&copy={}&copy'>", body("<p b=\"&amp;copy={}©\"></p>"))]),
    "TOK5_comments_and_doctypes": (tree, [("<!--{}--><!-x{}><p>", "<!--{}--><!---x{}-->" + body("<p></p>")), ("<?php {}?><p>", "<!--?php {}?-->" + body("<p></p>")), ('<!doctype HTML PUBLIC "a{}" "b"><p>', '<!DOCTYPE html PUBLIC "a{}" "b">' + body("<p></p>")), ("</ {}><p>", "<!-- {}-->" + body("<p></p>"))]),
    "TOK6_cdata": (tree, [("<p><![CDATA[x{}]]></p><svg><![CDATA[y<{}]]></svg>", body("<p><!--[CDATA[x{}]]--></p><svg>y&lt;{}</svg>"))]),
    "TOK7_xml_coercion": (parsed_with(xml=True), [("<!--a--b{}--><p>x\f{}", "<!--a- -b{}-->" + body("<p>x {}</p>"))]),
    "TOK8_error_codes": (text_udf(_codes), [
        ("<!doctype html><p a a>{}", "duplicate-attribute"), ("<!doctype html>{}<!-- x", "eof-in-comment"), ("<!doctypehtml>{}", "missing-whitespace-before-doctype-name"), ("<!doctype>{}", "missing-doctype-name"),
        ('<!doctype html PUBLIC"a" "b">{}', "missing-whitespace-after-doctype-public-keyword"), ('<!doctype html SYSTEM"a">{}', "missing-whitespace-after-doctype-system-keyword"), ('<!doctype html PUBLIC "a""b">{}', "missing-whitespace-between-doctype-public-and-system-identifiers"),
        ("<!doctype html PUBLIC>{}", "missing-doctype-public-identifier"), ("<!doctype html SYSTEM 'a>{}", "abrupt-doctype-system-identifier"), ("<!doctype html x>{}", "invalid-character-sequence-after-doctype-name"), ("<!doctype html SYSTEM 'a' b>{}", "unexpected-character-after-doctype-system-identifier"),
        ("<!doctype html></>{}", "missing-end-tag-name"), ("<!doctype html><p a=>{}", "missing-attribute-value"), ("<!doctype html><p a=1b=\"2\">{}", "unexpected-character-in-unquoted-attribute-value unexpected-character-in-unquoted-attribute-value unexpected-character-in-unquoted-attribute-value"), ("<!doctype html><p>&#0;{}", "null-character-reference"), ("<!doctype html>{}<p", "eof-in-tag"),
    ]),
    "TOK8_error_places": (text_udf(_places), [("<!doctype html>\n<p>é&#0; {}", "null-character-reference@2:8"), ("<!doctype html>\r\n\n<p a a> {}", "duplicate-attribute@3:6")]),
    "TOK9_keep_bom": (parsed_with(discard_bom=False), [("﻿<p>{}", body("﻿<p>{}</p>"))]),
    "ENT1_numeric": (text, [("&#65;{}&#x80;&#0;&#xD800;&#x110000;", "A{}€���"), ("&#x41 {}", "A {}"), ("&#;{}&#x;", "&#;{}&#x;")]),
    "ENT2_named": (text, [("&notit;{}&notin;&not ", "¬it;{}∉¬"), ("&ampx{}&amp;&nosuch;", "&x{}&&nosuch;")]),
    "TB1_dispatch": (tree, [("<svg><p>{}", body("<svg></svg><p>{}</p>")), ("<math><mtext><b>{}</b></mtext></math>", body("<math><mtext><b>{}</b></mtext></math>"))]),
    "TB2_implied_parts": (tree, [("{}", body("{}")), ("<title>{}</title>", head("<title>{}</title>")), ("<head><meta name=n{}><p>", "<html><head><meta name=n{}></head><body><p></p></body></html>")]),
    "TB3_scopes": (tree, [("<button>a<table><td><button>{}</table>", body("<button>a<table><tbody><tr><td><button>{}</button></td></tr></tbody></table></button>")), ("<p><marquee><p>{}", body("<p><marquee><p>{}</p></marquee></p>")), ("<ul><li>a<ol><li>{}</ol><li>b", body("<ul><li>a<ol><li>{}</li></ol></li><li>b</li></ul>"))]),
    "TB4_implied_ends": (tree, [("<dl><dt>a<dd>{}", body("<dl><dt>a</dt><dd>{}</dd></dl>")), ("<ruby>a<rb>b<rt>{}", body("<ruby>a<rb>b</rb><rt>{}</rt></ruby>")), ("<div><p>{}</div>b", body("<div><p>{}</p></div>b"))]),
    "TB5_three_alike": (tree, [("<p><b><b><b><b>x<p>{}", body("<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>{}</b></b></b></p>")), ("<p><i><i id=n{}><i><i>x<p>y", body("<p><i><i id=n{}><i><i>x</i></i></i></i></p><p><i><i id=n{}><i><i>y</i></i></i></i></p>"))]),
    "TB6_reconstruct": (tree, [("<p><b>x{}</p>y", body("<p><b>x{}</b></p><b>y</b>")), ("<div><em>a</div><section>{}", body("<div><em>a</em></div><section><em>{}</em></section>"))]),
    "TB7_adoption": (tree, [("<b>1<p>{}</b>3</p>", body("<b>1</b><p><b>{}</b>3</p>")), ("<i>p{}<div>q<section>r</i>s</section>t</div>", body("<i>p{}</i><div><i>q</i><section><i>r</i>s</section>t</div>")), ("<a>x<a>{}", body("<a>x</a><a>{}</a>")), ("<em>a<strong>{}</em>c</strong>", body("<em>a<strong>{}</strong></em><strong>c</strong>"))]),
    "TB8_foster": (tree, [("<table>{}<tr><td>c", body("{}<table><tbody><tr><td>c</td></tr></tbody></table>")), ("<table><b>{}<tr><td>c", body("<b>{}</b><table><tbody><tr><td>c</td></tr></tbody></table>")), ("<div><table><tr><p>{}</table>", body("<div><p>{}</p><table><tbody><tr></tr></tbody></table></div>"))]),
    "TB9_table_text": (tree, [("<table> <tr> <td>{}</table>", body("<table> <tbody><tr> <td>{}</td></tr></tbody></table>")), ("<table> x{} <tr>", body(" x{} <table><tbody><tr></tr></tbody></table>"))]),
    "TB10_late_attributes": (tree, [("<body a=1><body a=2 b={}>", "<html><head></head><body a=1 b={}></body></html>"), ("<html lang=x><p><html lang=y id=n{}>", "<html lang=x id=n{}><head></head><body><p></p></body></html>")]),
    "TB11_frameset": (tree, [("<div></div><frameset id=f{}><frame></frameset>", "<html><head></head><frameset id=f{}><frame></frame></frameset></html>"), ("x{}<frameset><frame></frameset>", body("x{}"))]),
    "TB12_templates": (tree, [("<template><td>{}</td></template>", head("<template><td>{}</td></template>")), ("<p><template><tr><td>a</template>{}", body("<p><template><tr><td>a</td></tr></template>{}</p>"))]),
    "TB13_foreign": (tree, [('<svg viewbox="0 {}"><foreignobject/><lineargradient/></svg>', body('<svg viewBox="0 {}"><foreignObject></foreignObject><linearGradient></linearGradient></svg>')), ("<math><font color=r>{}", body("<math></math><font color=r>{}</font>")), ("<math><font x=r>{}", body("<math><font x=r>{}</font></math>")), ("<math definitionurl=d{}></math>", body("<math definitionURL=d{}></math>")), ("<svg><g>a</svg>{}", body("<svg><g>a</g></svg>{}"))]),
    "TB14_integration_points": (tree, [("<svg><desc><p>{}</desc></svg>", body("<svg><desc><p>{}</p></desc></svg>")), ("<math><mi><p>{}</mi></math>", body("<math><mi><p>{}</p></mi></math>")), ('<math><annotation-xml encoding="text/html"><p>{}', body("<math><annotation-xml encoding=text/html><p>{}</p></annotation-xml></math>")), ("<math><annotation-xml><p>{}", body("<math><annotation-xml></annotation-xml></math><p>{}</p>"))]),
    "TB15_select": (tree, [("<select><div>{}<option>x</select>", body("<select><div>{}<option>x</option></div></select>")), ("<select><option>a{}<optgroup><option>b</select>c", body("<select><option>a{}</option><optgroup><option>b</option></optgroup></select>c")), ("<select><option>a<hr><option>{}", body("<select><option>a</option><hr><option>{}</option></select>"))]),
    "TB16_selectedcontent": (tree, [("<select><button><selectedcontent></selectedcontent></button><option>a<option selected>b{}</select>", body("<select><button><selectedcontent>b{}</selectedcontent></button><option>a</option><option selected>b{}</option></select>"))]),
    "TB17_quirks": (tree, [("<p>{}<table>", body("<p>{}<table></table></p>")), ("<!doctype html><p>{}<table>", "<!DOCTYPE html>" + body("<p>{}</p><table></table>")), ('<!doctype html public "-//W3C//DTD HTML 3.2//EN"><p>{}<table>', '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 3.2//EN">' + body("<p>{}<table></table></p>"))]),
    "TB18_fragment_contexts": (parsed_with(context=("tr", "html")), [("<td>{}<td>b", "<td>{}</td><td>b</td>"), ("<tr><td>{}", "<td>{}</td>")]),
    "TB19_first_line_feed": (tree, [("<pre>\n{}</pre><textarea>\n\n{}</textarea><listing>\n{}</listing>", body("<pre>{}</pre><textarea>\n{}</textarea><listing>{}</listing>"))]),
    "TB20_text_merged": (dump, [("a{}</nope>b", '| <html>\n|   <head>\n|   <body>\n|     "a{}b"'), ("<table>a<tr>b{}", '| <html>\n|   <head>\n|   <body>\n|     "ab{}"\n|     <table>\n|       <tbody>\n|         <tr>')]),
    "TB21_mode_reset": (tree, [("<table><caption><template></template></table>{}", body("<table><caption><template></template></caption></table>{}")), ("<table><tr><td><template><p></template><td>{}", body("<table><tbody><tr><td><template><p></p></template></td><td>{}</td></tr></tbody></table>"))]),
    "TB22_iframe_srcdoc": (parsed_with(iframe_srcdoc=True), [("<p>{}<table>", body("<p>{}</p><table></table>"))]),
    "TB23_strict": (text_udf(_strict), [("<!doctype html><p a a>{}", "duplicate-attribute"), ("<!doctype html><title>{}</title>", "fine"), ("<!doctype html><p>&#0;{}", "null-character-reference")]),
    "TB24_comment_places": (tree, [("<!--1--><html><!--2--><body>{}</body><!--3--></html><!--4-->", "<!--1--><html><!--2--><head></head><body>{}</body><!--3--></html><!--4-->")]),
    "SEL26_errors": (text_udf(_selector(parse_selector)), [("p{},", "error"), ("a,,p{}", "error"), (".n{}\\", "error"), ("[a='{}]", "error"), (":nth-child(x{})", "error"), (":not()", "error"), (".n{}", "fine"), ("li:nth-child({}n+1)", "fine")]),
    "SEL27_unsupported": (text_udf(_selector(parse_selector)), [("p.n{}:hover", "error"), (":has(.n{})", "error"), ("li:nth-last-child({})", "error")]),
    "SEL28_attribute_flags": (text_udf(_selector(parse_selector)), [("[a=v{} i]", "error"), ("[a='{}' s]", "error"), ("[a='{}']", "fine")]),
    "PRJ5_preserved_text": (plain, [("<p> a  {}\n</p> <b>\tc</b>", " a  {}\n \tc")]),
    "FN_T1b_document_text": (plain, [("<title>t</title><p>{}<!--c--><template>x</template>", "t{}")]),
    "FN_H2_pretty": (pretty, [("<div><p>a{}</p><p>b</p></div>", "<html>\n  <head></head>\n  <body>\n    <div>\n      <p>a{}</p>\n      <p>b</p>\n    </div>\n  </body>\n</html>")]),
    "FN_H3_start_tags": (tree, [("<a b='x y' c='\"' d='' e={}>x", body("<a b=\"x y\" c='\"' d e={}>x</a>"))]),
    "FN_H4_escaping": (tree, [("<p a='&quot;&apos;{}'>&lt;{}&gt;&amp;&quot;</p><style>a>{}</style>", body("<p a=\"&quot;'{}\">&lt;{}&gt;&amp;\"</p><style>a>{}</style>"))]),
    "FN_H5_doctypes": (tree, [('<!doctype html system "x{}">', '<!DOCTYPE html SYSTEM "x{}">' + body("")), ("<!doctype n{}>", "<!DOCTYPE n{}>" + body("")), ("<!doctype html system 'x\"{}'>", "<!DOCTYPE html SYSTEM 'x\"{}'>" + body(""))]),
    "FN_H6_dump": (dump, [("<!doctype html><p b=1 a={}>x<svg xlink:href=h><!--c--></svg>", '| <!DOCTYPE html>\n| <html>\n|   <head>\n|   <body>\n|     <p>\n|       a="{}"\n|       b="1"\n|       "x"\n|       <svg svg>\n|         xlink href="h"\n|         <!-- c -->')]),
    "FN_M3_text_escape": (markdown, [("<p>a*b_{}[c]`\\</p>", "a\\*b\\_{}\\[c\\]\\`\\\\")]),
    "FN_M4_code_spans": (markdown, [("<p><code>a`{}</code></p>", "``a`{}``"), ("<p><code>`{}</code></p>", "`` `{} ``"), ("<p><code>{}</code></p>", "`{}`")]),
    "FN_M5_link_targets": (markdown, [("<a href='/a b({})'>x</a>", "[x](/a%20b\\({}\\))")]),
    "FN_X1_cli_escapes": (text_udf(_escapes), [("\\n{}\\t\\\\", "\n{}\t\\"), ("\\x{}", "error"), ("{}\\", "error")]),
    "TS2_subset": (text_udf(_selector(compile_targeted)), [("div > p.n{}", "fine"), ("li:nth-of-type({}n)", "fine"), ("a + b.n{}", "error"), (".n{}:empty", "error"), ("p.n{}:last-child", "error")]),
    "TS4_observed_match": (text_udf(_first("ul > li")), [("<ul><li>{}</li><li>b</li></ul>", "li:{}"), ("<div><li>x</li></div><ul><li>{}", "li:{}"), ("<ol><li>{}</ol>", None)]),
    "TS5_late_attributes": (text_udf(_first(".late")), [("<p>x{}</p><body class=late>", "body:x{}"), ("<p class=late>{}</p>", "p:{}")]),
    "TS6_moved_match": (text_udf(_first("div p")), [("<p>{}</p><div><p>b{}</p></div>", "p:b{}"), ("<div><table><p>{}</table></div>", "p:{}"), ("<b><p>x</b><div><p>{}", "p:{}")]),
    "EV2_text_of_a_step": (text_udf(_events), [("a&amp;{}b<p>", "text:a&{}b|start:p"), ("<i>{}</i>", "start:i|text:{}|end:i")]),
    "EV3_foreign_events": (text_udf(_events), [("<svg><![CDATA[x{}]]></svg>", "start:svg|text:x{}|end:svg"), ("<svg><title>&lt;{}</title></svg>", "start:svg|start:title|text:<{}|end:title|end:svg"), ("<p><![CDATA[x{}]]>", "start:p|comment:[CDATA[x{}]]")]),
    "EV4_void_events": (text_udf(_events), [("<br>{}<img/>", "start:br|text:{}|start:img")]),
    "CLI1_options": (text_udf(_cli), [("<p>{}</p>|--selector p --format text -", "0:{}\n"), ("<p>{}</p>|--selector=p --format=text -", "0:{}\n"), ("<p>{}</p>|--nope -", "1:")]),
    "CLI2_conflicts": (text_udf(_cli), [("<p>{}</p>|--count --first --selector p -", "1:"), ("<p>{}</p>|--first --limit 2 --selector p -", "1:"), ("<p>{}</p>|--attr id --format text --selector p -", "1:"), ("<p>{}</p>|--field-separator , --selector p -", "1:"), ("<p>{}</p>|--whitespace preserve --selector p -", "1:")]),
    "CLI3_exit_codes": (text_udf(_cli), [("<p>{}</p>|--selector b -", "1:"), ("<p>{}</p>|--selector p[ -", "2:"), ("<p>{}</p>|--selector b --count -", "0:0\n"), ("<p>{}</p>|--selector p --count -", "0:1\n")]),
    "CLI4_first": (text_udf(_cli), [("<p>a{}<p>b|--selector p --first --format text -", "0:a{}\n"), ("<p>a{}<p>b<p>c|--selector p --limit 2 --format text -", "0:a{}\nb\n")]),
    "CLI5_document": (text_udf(_cli), [("<p>a{}</p>|--format text -", "0:a{}\n"), ("<b>a{}</b>|--format markdown -", "0:**a{}**\n")]),
    "CLI6_separators": (text_udf(_cli), [("<p>a{}<p>b|--selector p --format text -", "0:a{}\nb\n"), ("<p>a{}<p>b|--selector p --format markdown -", "0:a{}\n\nb\n"), ("<a id=i{} rel=r>x</a>|--selector a --attr id --attr rel -", "0:i{}\tr\n"), ("<a id=i{}>x</a>|--selector a --attr id --attr rel --field-separator , -", "0:i{},__MISSING__\n")]),
    "CLI7_version": (text_udf(_cli), [("{}|--version", f"0:sparkdom {__version__}\n")]),
    "SNK1_records": (text_udf(_cli), [("<p>a{}<p>b|--selector p --format text --separator ; -", "0:a{};b\n"), ("<p>a{}<p>b|--selector p --separator \\t -", "0:<p>a{}</p>\t<p>b</p>\n")]),
    "SNK2_compact": (tree, [("<ul>\n<li>{}", body("<ul>\n<li>{}</li></ul>"))]),
    "SNK3_dump": (dump, [("<template>{}</template>", '| <html>\n|   <head>\n|     <template>\n|       content\n|         "{}"\n|   <body>')]),
    "FN_S1_code_points": (U.numeric_reference, [("8364", "€"), ("55296", "�"), ("128", "€"), ("65", "A")]),
    "FN_M1_page": (markdown, [("<h2>T{}</h2><p>a <b>b</b> <i>c</i></p><ul><li>x<li>y</ul><hr>", "## T{}\n\na **b** *c*\n\n- x\n- y\n\n---")]),
    "SRC2_stdin": (text_udf(_cli), [("<title>é{}</title>|--selector title --format text -", "0:é{}\n")]),
    "SRC9_labels": (U.normalize_label, [(" Latin1 ", "windows-1252"), ("UTF-7", "windows-1252"), ("ISO-8859-9", "windows-1254"), ("x-sjis", "shift_jis"), ("koi8-ru", "koi8-u"), ("nope{}", None)]),
}

#: Operator: what is done with bytes (in hex), and the cases.
META = "<meta charset={}>"
BYTES: dict[str, tuple[Callable, list[Case]]] = {
    "SRC6_byte_order_marks": (U.sniff_encoding, [("efbbbf{}", "utf-8"), ("fffe{}", "utf-16le"), ("feff{}", "utf-16be"), ("ff{}", "windows-1252")]),
    "SRC7_meta_prescan": (U.sniff_encoding, [(ascii_hex("<meta charset=koi8-r>") + "{}", "koi8-r"), (ascii_hex("<!-- <meta charset=koi8-r> -->") + "{}", "windows-1252"), (ascii_hex("<p title='<meta charset=koi8-r>'>") + "{}", "windows-1252"), (ascii_hex("<META name=x CHARSET='Big5'>") + "{}", "big5")]),
    "SRC8_content_charset": (U.sniff_encoding, [(ascii_hex('<meta http-equiv=content-type content="text/html; charset=shift_jis">') + "{}", "shift_jis"), (ascii_hex("<meta content='x; charset=\"gbk\"; y' http-equiv=Content-Type>") + "{}", "gbk"), (ascii_hex("<meta content='charset=gbk'>") + "{}", "windows-1252")]),
    "SRC10_declared_override": (U.sniff_encoding, [(ascii_hex("<meta charset=utf-16>") + "{}", "utf-8"), (ascii_hex("<meta charset=x-user-defined>") + "{}", "windows-1252")]),
    "SRC11_decoders": (U.decode_html, [
        (ascii_hex(META.format("windows-1251")) + "cff0e8e2e5f2{}", META.format("windows-1251") + "Привет{}"), (ascii_hex(META.format("koi8-r")) + "f0d2c9d7c5d4{}", META.format("koi8-r") + "Привет{}"),
        (ascii_hex(META.format("shift_jis")) + "93fa967b{}", META.format("shift_jis") + "日本{}"), (ascii_hex(META.format("euc-jp")) + "c6fccbdc{}", META.format("euc-jp") + "日本{}"), (ascii_hex(META.format("euc-kr")) + "c7d1b1db{}", META.format("euc-kr") + "한글{}"),
        (ascii_hex(META.format("gbk")) + "d6d0b9fa{}", META.format("gbk") + "中国{}"), (ascii_hex(META.format("big5")) + "a4a4a4e5{}", META.format("big5") + "中文{}"), ("80e9{}", "€é{}"), ("efbbbfc3a9{}", "é{}"), (ascii_hex(META.format("utf-8")) + "ff{}", META.format("utf-8") + "�{}"),
        (ascii_hex(META.format("iso-8859-5")) + "bfe0{}", META.format("iso-8859-5") + "Пр{}"),
    ]),
}


def expected(cases: list[Case]) -> str:
    rows = ", ".join(f"({k}, {quoted(want)})" for k, (_, want) in enumerate(cases, 1))
    return f"SELECT page_id, CAST(c.n AS INT) AS case_number, replace(c.want, '{{}}', CAST(page_id AS VARCHAR)) AS result FROM pages, (VALUES {rows}) AS c(n, want)"


def inputs(df: DataFrame, values: list[Column]) -> DataFrame:
    """page_id, case_number, value: every case for every page."""
    listed = F.array(*[F.struct(F.lit(k).alias("case_number"), v.alias("value")) for k, v in enumerate(values, 1)])
    return df.select("page_id", F.explode(listed).alias("c")).select("page_id", "c.case_number", "c.value")


def query_of(fn: Callable, cases: list[Case], binary: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
        number = F.col("page_id").cast("string")
        values = [raw(given) if binary else F.replace(F.lit(given), F.lit("{}"), number) for given, _ in cases]
        return inputs(df, values).select("page_id", "case_number", fn("value").alias("result"))

    return run


QUERIES = {name: query_of(fn, cases, table is BYTES) for table in (TEXTS, BYTES) for name, (fn, cases) in table.items()}
ORACLE_SQL = {name: expected(cases) for table in (TEXTS, BYTES) for name, (_, cases) in table.items()}
