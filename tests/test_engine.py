"""Sources, functions, SQL, mutation, streaming, the command line and the registered queries."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkdom import queries
from sparkdom.cli import run as cli
from sparkdom.engine import Engine
from sparkdom.functions import columns as C
from sparkdom.functions import sql as U
from sparkdom.html import encoding as E
from sparkdom.operators import mutate as M
from sparkdom.operators import parse as P
from sparkdom.operators import select as S
from sparkdom.plans.css import SelectorError
from sparkdom.sources import pages as R
from sparkdom.streaming import pages as ST

PAGE = '<!DOCTYPE html><title>Hi &amp; ho</title><ul id=u><li class="a b">one<li>two<li>three</ul><template><li>t</template><p>x <b>y</b>'


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string").withColumn("nodes", F.lit("clash"))


# --- encodings


def test_labels():
    assert E.normalize_label(" UTF8 ") == "utf-8" and E.normalize_label("latin1") == "windows-1252" and E.normalize_label("utf-7") == "windows-1252"
    assert E.normalize_label("sjis") == "shift_jis" and E.normalize_label("nope") is None and E.normalize_label(None) is None
    assert len(E.ENCODINGS) == 40
    for codec, _ in E.ENCODINGS.values():
        if codec:
            b"a".decode(codec, "replace")


@pytest.mark.parametrize(
    ("data", "transport", "want"),
    [
        (b"\xef\xbb\xbfx", None, "utf-8"), (b"\xff\xfex\0", None, "utf-16le"), (b"\xfe\xff\0x", None, "utf-16be"), (b"\xef\xbb\xbfx", "latin1", "windows-1252"), (b"x", None, "windows-1252"),
        (b"<meta charset=koi8-r>", None, "koi8-r"), (b"<META http-equiv='Content-Type' content='text/html; charset=\"big5\"'>", None, "big5"), (b"<meta content='text/html; charset=big5'>", None, "windows-1252"),
        (b"<!-- <meta charset=big5> --><meta charset=gbk>", None, "gbk"), (b"<meta charset=utf-16>", None, "utf-8"), (b"<meta charset=x-user-defined>", None, "windows-1252"), (b"<meta charset=nope><meta charset=euc-kr>", None, "euc-kr"),
        (b"<p title='<meta charset=big5>'><meta charset=gbk>", None, "gbk"), (b"x" * 2000 + b"<meta charset=gbk>", None, "windows-1252"), (b"<!--" + b"x" * 2000 + b"--><meta charset=gbk>", None, "gbk"),
    ],
)
def test_sniff(data, transport, want):
    assert E.sniff(data, transport)[0] == want


def test_decoders():
    assert E.decode_html(b"\x82\xa0", "shift_jis") == ("あ", "shift_jis")
    assert E.decode(b"\x80\x81\x9f", "windows-1252") == "€\x81Ÿ"
    assert E.decode(b"abc", "replacement") == "�" and E.decode(b"", "replacement") == ""
    assert E.decode(b"a\x80\xff", "x-user-defined") == "a\uf780\uf7ff"
    assert E.decode_html("é".encode("utf-16-le"), "utf-16")[0] == "é"


# --- tables


def test_pages(spark, one):
    pages = P.parse_pages(one, collect_errors=True)
    rows = {r.page_id: r for r in pages.collect()}
    assert rows[2].html == rows[3].html == "<html><head></head><body></body></html>" and rows[1].quirks == "no-quirks" and len(rows[1].texts) == 2
    assert P.parse_pages(one.where("false")).count() == 0
    assert P.nodes(P.parse_pages(one, where=F.col("page_id") == 1)).select("page_id").distinct().count() == 1
    assert P.errors(pages).where("page_id = 2").count() > 0
    assert [r.tree_text for r in P.trees(pages).where("page_id = 1").orderBy("tree_id").collect()] == ["Hi & hoonetwothreex y", "t"]
    with pytest.raises(Exception, match="StrictError"):
        P.parse_pages(spark.createDataFrame([(1, "<p a a>")], "page_id long, html string"), strict=True).count()
    raw = spark.createDataFrame([(1, bytearray("<meta charset=utf-8><title>é".encode()))], "page_id long, html binary")
    assert P.parse_pages(raw).select("encoding", F.element_at("texts", 1)).first() == ("utf-8", "é")


def test_columns(spark, one):
    pages = P.parse_pages(one)
    rows = S.with_text(S.query(pages, "li, title, template"), pages)
    got = rows.orderBy("node_id").select("name", "raw_text", "text", "outer_html", C.attr("CLASS", "-").alias("c"), C.class_list().alias("l")).collect()
    assert tuple(got[0]) == ("title", "Hi & ho", "Hi & ho", "<title>Hi &amp; ho</title>", "-", [])
    assert tuple(got[1]) == ("li", "one", "one", '<li class="a b">one</li>', "a b", ["a", "b"])
    assert [r.text for r in got[2:]] == ["two", "three", "", "t"] and [r.outer_html for r in got][4] == "<template><li>t</li></template>"
    t = spark.createDataFrame([(" a \n b\xa0 ", "a*b_[c]`\\", "<&>")], "a string, b string, c string")
    assert tuple(t.select(C.collapse(F.col("a")), C.escape_markdown(F.col("b")), C.escape_html(F.col("c"))).first()) == ("a b\xa0", "a\\*b\\_\\[c\\]\\`\\\\", "&lt;&amp;&gt;")


def test_counts_limits_records(one):
    pages = P.parse_pages(one)
    found = S.query(pages, "ul li")
    assert sorted(map(tuple, S.counts(found, one).collect())) == [(1, 3), (2, 0), (3, 0)]
    assert S.first_rows(found, 2).count() == 2
    assert S.records(S.numbered(found), F.col("pos").cast("string"), separator="|").first().record == "1|2|3"
    inside = S.query(pages, "ul").select("page_id", "tree_id", "node_id", "last_id")
    assert S.query(pages, "body li", scope=inside).count() == 3 and S.query(pages, "li", scope=inside).count() == 3
    assert S.select(one, "ul li", limit=2).count() == 2 and S.select_first(one, "li.b", ("text",)).first().text == "one"
    with pytest.raises(SelectorError):
        S.select_first(one, "li + li")


def test_prefilter_keeps_every_match(spark):
    pages = ["<p class=foo>", '<p class="f&#111;o">', "<P CLASS=foo>", "<div>foo", "<table><td>x", "</p>", "<image src=x>", "<p class=\0foo>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    for s in ("p.foo", ".foo", "div", "tbody", "tr td", "p", "img", "div, .foo"):
        assert sorted(map(tuple, S.select(df, s).collect())) == sorted(map(tuple, S.select(df, s, prefilter=False).collect()))
    plan = S.select(df, "footer")._jdf.queryExecution().executedPlan().toString()
    assert "<footer" in plan.split("MapInArrow")[1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=latin1><title>é".encode("latin-1"))
    files = R.read_files(spark, str(tmp_path))
    assert S.select(files, "title", ("text",), key="path").first().text == "é"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.html").write_text("<title>a\nb")
    assert S.select(R.read_text_files(spark, str(tmp_path / "t")), "title", ("raw_text",), key="path").first().raw_text == "a\nb"
    assert R.from_strings(spark, ["x", None]).where("html = ''").count() == 1
    assert S.select(R.from_bytes(spark, [b"<p>x"]), "p").first().text == "x"
    R.write_table(R.from_strings(spark, ["<p>x"]), str(tmp_path / "out"), "page_id")
    assert Engine(spark).read(str(tmp_path / "out")).count() == 1
    R.write_records(S.select(R.from_strings(spark, ["<p>x"]), "p", ("text",)).withColumnRenamed("text", "record"), str(tmp_path / "rec"))
    assert spark.read.text(str(tmp_path / "rec")).first()[0] == "x"


def test_sql(spark, one):
    engine = Engine(spark).register()
    one.select("page_id", "html").createOrReplaceTempView("one")
    row = spark.sql("select html_text(html) t, html_select(html, 'li') s, html_select_first(html, 'b') f, html_decode_entities('&lt;&copy') e, html_markdown(html) m, sniff_encoding(cast(html as binary)) x from one where page_id = 1").first()
    assert row.t == "Hi & hoonetwothreex y" and row.s == ["one", "two", "three", "t"] and row.f == "y" and row.e == "<©" and "- one" in row.m and row.x == "windows-1252"
    assert spark.sql("select html_text(html) t from one where page_id = 2").first().t is None
    assert spark.sql("select count(*) from one, lateral html_nodes(html) n where n.name = 'li'").first()[0] == 4
    assert spark.sql("select e.name from one, lateral html_events(html) e where e.event = 'start' and page_id = 1 order by e.seq limit 2").collect()[1].name == "ul"
    assert [r.text for r in spark.sql("select m.pos, m.text from one, lateral html_matches(html, 'ul > li') m order by m.pos").collect()] == ["one", "two", "three"]
    assert engine.query_first(engine.parse(one), "li").count() == 1 and engine.stream(one).count() == engine.events(one).count()


def html_of(df):
    return df.where("page_id = 1").first().html.split("<body>")[1].split("<template>")[0]


def test_mutation(one):
    pages = P.parse_pages(one).cache()
    assert html_of(M.remove(pages, "li:nth-child(2)")) == '<ul id=u><li class="a b">one</li><li>three</li></ul>'
    assert html_of(M.append(pages, "ul", "<li>4")) == '<ul id=u><li class="a b">one</li><li>two</li><li>three</li><li>4</li></ul>'
    assert html_of(M.insert_before(pages, "ul", "a<i>b</i>")).startswith("a<i>b</i><ul")
    assert html_of(M.replace(pages, "li:first-child", "<li>new</li>")) == "<ul id=u><li>new</li><li>two</li><li>three</li></ul>"
    assert html_of(M.clone(pages, "li:first-child")).count("one") == 2 and html_of(M.clone(pages, "li:first-child", deep=False)).count("one") == 1
    assert M.move(pages, "ul li", "p").where("page_id = 1").first().html.endswith("</b><li class=\"a b\">one</li><li>two</li><li>three</li></p></body></html>")
    bad = M.move(pages, "body", "ul")
    assert bad.where("page_id = 1").first().mutation_error and html_of(bad) == html_of(pages)
    left = M.prune(P.nodes(pages), S.query(pages, "ul").select("page_id", "tree_id", "node_id", "last_id"))
    assert {r.name for r in left.where("page_id = 1").select("name").collect()} >= {"template", "p", "li"} and left.where("name = 'li' and tree_id = 0").count() == 0


CHANGES = {
    "MUT2": lambda pages: M.remove(pages, "li:first-child"),
    "MUT3": lambda pages: M.insert_before(pages, "li, b", "<li>new</li>x"),
    "MUT1": lambda pages: M.append(pages, "ul, template", "<li>more"),
    "MUT4": lambda pages: M.replace(pages, "li:first-child", "<i>1</i><i>2</i>"),
    "MUT6": lambda pages: M.clone(pages, "li, template"),
    "MUT5": lambda pages: M.move(pages, "ul", "li"),
    "chain": lambda pages: M.remove(M.append(M.move(pages, "ul", "li"), "ul", "<li>4"), "li:first-child"),
}
TREES = [PAGE, None, "", "<table><li>x<td><ul><li>y</table>z", "<svg><li/></svg><b><p>a<ul><li>b", "<!DOCTYPE html PUBLIC 'a\"b'><ul><li>c<template><ul><li>d</ul></template>"]


@pytest.mark.parametrize("name", CHANGES)
def test_changes_in_the_parse_stage(spark, name):
    """Fresh pages are changed where they are parsed, in one stage, with the result that stored ones have."""
    raw = spark.createDataFrame(list(enumerate(TREES)), "page_id long, html string")
    fresh, stored = P.parse_pages(raw, collect_errors=True), P.parse_pages(raw, collect_errors=True).select("*")
    change = CHANGES[name]
    plans = [change(p)._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") for p in (fresh, stored)]
    assert plans[0] == 1 < plans[1]
    got, want = (sorted(map(str, change(p).collect())) for p in (fresh, stored))
    assert got == want and len(got) == len(TREES)
    assert fresh.schema == stored.schema and "mutation_error" not in fresh.columns and change(fresh).schema == change(stored).schema


def test_stream(spark, tmp_path):
    R.write_table(spark.createDataFrame([(i, "u", f"<title>t{i}</title>") for i in range(20)], "page_id long, url string, html string").repartition(4), str(tmp_path / "in"))
    pages = ST.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    ST.run_available(ST.select_stream(pages, "title", ("text",)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"t{i}" for i in range(20))
    ST.run_available(ST.event_stream(pages), str(tmp_path / "ev"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 60


# --- command line

CLI_PAGE = '<!DOCTYPE html><title>Hi</title><dl><dt>Mon</dt><dd class=open>9 to 5</dd><dt>Sun</dt><dd class=open>noon</dd></dl><p class=gap>\n \t</p><p><kbd>F1</kbd> or <kbd>F2</kbd></p><p><a href=/up title=Up>up</a><a href=/down>down</a></p>'


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["--selector", "dd.open", "--format", "text", "--separator", "\\n\\n"], (0, "9 to 5\n\nnoon\n")),
        (["--selector", "p.gap", "--format", "text", "--first"], (0, "\n")),
        (["--selector", "p.gap", "--format=text", "--whitespace", "preserve", "--first"], (0, "\n \t\n")),
        (["--selector", "kbd", "--format", "html", "--separator", "|"], (0, "<kbd>F1</kbd>|<kbd>F2</kbd>\n")),
        (["--selector", "dt", "--format", "markdown", "--separator", "|"], (0, "Mon|Sun\n")),
        (["--selector", "dt", "--format", "markdown"], (0, "Mon\n\nSun\n")),
        (["--selector", "a", "--attr", "HREF", "--attr", "title", "--field-separator", ","], (0, "/up,Up\n/down,__MISSING__\n")),
        (["--selector", "a", "--attr=href", "--attr=title", "--missing", "NA", "--limit", "1"], (0, "/up\tUp\n")),
        (["--selector", "a", "--inner", "--limit=2"], (0, "up\ndown\n")),
        (["--selector", "title:last-of-type", "--format", "text", "--first"], (0, "Hi\n")),
        (["--selector", "p", "--count"], (0, "3\n")),
        (["--selector", "q", "--count"], (0, "0\n")),
        (["--selector", "q"], (1, "")),
        (["--selector", "p:("], (2, "")),
        (["--version"], (0, "sparkdom 0.1.0\n")),
        *[(a, (1, "")) for a in (["--selector", "p", "--count", "--format", "text"], ["--attr", "href", "--format", "text"], ["--first", "--limit", "2"], ["--count", "--separator", ","], ["--whitespace", "preserve"], ["--field-separator", ","], ["--strip"], ["--separator", "\\d"], ["--limit", "0"], ["--limit", "x"], ["--limit", "9" * 24], ["--format", "pdf"], ["--whitespace", "x", "--format", "text"], ["--attr", ""], ["--selector"])],
    ],
)
def test_cli(args, want, tmp_path):
    (tmp_path / "p.html").write_text(CLI_PAGE)
    tail = [str(tmp_path / "p.html")] if args != ["--selector"] else []
    code, out, message = cli(["--local", *args, *tail])
    assert (code, out) == want
    assert bool(message) == (code == 2 or code == 1 and "q" not in args)


def test_cli_input(spark, tmp_path):
    assert cli(["--selector", "p", "--format", "text", "-"], b"<p>in") == (0, "in\n", "")
    assert cli(["--local", "--format", "text", "-"], b"<p>in") == (0, "in\n", "")
    assert cli(["--local", str(tmp_path / "none")])[0] == 1 and cli([])[0] == 1 and cli(["-h"])[0] == 0


# --- queries


def test_queries_against_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    rng = random.Random(0)
    for name in rng.sample(sorted(queries.ORACLE_SQL), 20):
        df = queries.QUERIES[name](spark, small)
        r = con.execute(queries.ORACLE_SQL[name])
        order = [c[0] for c in r.description]
        assert sorted(order) == sorted(df.columns), name
        assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x)) for x in df.select(*order).collect()), name


def test_batches_are_small(spark):
    """However many pages a task is given, few are held as rows at a time."""
    html = "<p>" + "x y <b>z</b> " * 8_000
    given = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([html] * 50)], names=["page_id", "html"])
    out = P.parse_pages(spark.createDataFrame([(1, "")], "page_id long, html string"))
    made = [(b.num_rows, sum(map(len, b.column("html").to_pylist()))) for b in P.parsed_batches(iter([given]), to_arrow_schema(out.schema), {})]
    assert sum(n for n, _ in made) == 50 and max(size for _, size in made) < (1 << 20) + 2 * len(html)


def test_spread(spark, tmp_path):
    """No task gets a large row group whole, and a larger table has more tasks."""
    rng = random.Random(3)
    table = spark.createDataFrame([(i, "u", rng.randbytes(10_000).hex()) for i in range(600)], "page_id long, url string, html string")
    table.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        dealt = queries.spread(queries.pages(spark, str(tmp_path)))
        held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(held) == 600 and max(held) < 300
    assert dealt.rdd.getNumPartitions() == -(-queries.stored(dealt) // queries.TASK_BYTES) > spark.sparkContext.defaultParallelism


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert U.SCALARS
