"""Queries over the `pages` table, one for each operator or group of them, with SQL that DuckDB can run where there is any.

Keys begin with the operator's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdom import cases
from sparkdom.engine import Engine
from sparkdom.functions import columns as C
from sparkdom.functions import sql as U
from sparkdom.operators import mutate as M
from sparkdom.operators import parse as P
from sparkdom.operators import select as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


#: A task parses pages of about so many bytes of files.
TASK_BYTES = 2 << 20
#: Where Spark does not know a size it takes one of this order.
UNKNOWN_BYTES = 1 << 60


def stored(df: DataFrame) -> int:
    """Bytes of the files that df reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def spread(df: DataFrame) -> DataFrame:
    """Deal pages out over all cores, in parts that do not grow with the table: parsing is what costs.

    Splits of files are no such parts. A row group is read by one task whatever it holds, so a
    table of few large row groups has many splits and few of them with pages.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-stored(df) // TASK_BYTES))
    return df.repartition(n, "page_id")


def add(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn

    return put


# --- pieces of SQL for the pages' regular markup


def decoded(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ')"


def text_of(tag: str) -> str:
    return collapsed(decoded(f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)"))


LINKS = "SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS raw, len(l) AS n FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">.*?</a></li>') AS l FROM pages)"
LINK = f"SELECT page_id, CAST(pos AS INT) AS pos, CAST(n AS INT) AS n, {decoded('''regexp_extract(raw, 'href=\"([^\"]*)\"', 1)''')} AS href, {collapsed(decoded('''regexp_extract(raw, '\">(.*?)</a>', 1)'''))} AS text FROM ({LINKS})"
HREFS = f"SELECT page_id, pos, href FROM ({LINK})"


def links_where(condition: str, columns: str = "page_id, pos, href") -> str:
    return f"SELECT {columns} FROM ({LINK}) WHERE {condition}"


# --- relational queries over the node table


def node_query(selector: str, columns: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return columns(S.query(P.parse_pages(spread(pages(spark, sf_dir))), selector))

    return run


def as_links(rows: DataFrame) -> DataFrame:
    """Number of the link's list item, and its target."""
    return S.numbered(rows).select("page_id", "pos", C.attr("href").alias("href"))


def as_items(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", F.col("elem_pos").alias("pos"))


def items_where(condition: str) -> str:
    return f"SELECT page_id, pos FROM ({LINK}) WHERE {condition}"


for _key, _selector, _condition in (
    ("SEL12_first_child", "nav li:first-child", "pos = 1"),
    ("SEL13_last_child", "nav li:last-child", "pos = n"),
    ("SEL14_only_child", "nav li:only-child", "n = 1"),
    ("SEL15_nth_child_odd", "nav li:nth-child(odd)", "pos % 2 = 1"),
    ("SEL15_nth_child_negative", "nav li:nth-child(-n+3)", "pos <= 3"),
    ("SEL16_first_of_type", "nav li:first-of-type", "pos = 1"),
    ("SEL17_last_of_type", "nav li:last-of-type", "pos = n"),
    ("SEL18_only_of_type", "nav li:only-of-type", "n = 1"),
    ("SEL19_nth_of_type", "nav li:nth-of-type(3n+2)", "pos % 3 = 2"),
    ("SEL22_not", "nav li:not(:first-child)", "pos > 1"),
    ("SEL23_compound", "nav li:not(:first-child):not(:last-child)", "pos > 1 AND pos < n"),
    ("JN3_adjacent", "li + li", "pos > 1"),
    ("JN4_sibling", "nav li ~ li", "pos > 1"),
    ("JN5_anti", "nav li:not(li + li)", "pos = 1"),
    ("SO2_except", "nav li:not(:nth-child(2))", "pos <> 2"),
):
    add(_key, items_where(_condition))(node_query(_selector, as_items))

for _key, _selector, _condition in (
    ("JN1_child", "nav > ul > li > a", "true"),
    ("JN2_descendant", "nav a", "true"),
    ("SEL5_attr_present", "a[href]", "true"),
    ("SEL25_escapes", "n\\61 v \\61[href]", "true"),
):
    add(_key, HREFS)(node_query(_selector, as_links))

for _key, _selector, _condition in (
    ("SEL6_attr_equals", "a[href='/que']", "href = '/que'"),
    ("SEL9_attr_prefix", "a[href^='/a']", "starts_with(href, '/a')"),
    ("SEL10_attr_suffix", "a[href$='.']", "ends_with(href, '.')"),
    ("SEL11_attr_contains", "a[href*='er']", "contains(href, 'er')"),
):

    @add(_key, links_where(_condition, "page_id, href, count(*) AS n") + " GROUP BY page_id, href")
    def _attr_query(spark: SparkSession, sf_dir: str, selector: str = _selector) -> DataFrame:
        rows = S.query(P.parse_pages(spread(pages(spark, sf_dir))), selector)
        return rows.groupBy("page_id", C.attr("href").alias("href")).agg(F.count("*").alias("n"))


# --- fused queries


@add("SEL2_title_text", f"SELECT page_id, {text_of('title')} AS title FROM pages")
def title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "title", ("text",)).select("page_id", F.col("text").alias("title"))


@add("SEL4_class_text", "SELECT page_id, " + collapsed(decoded("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")) + " AS ad FROM pages WHERE html LIKE '%<div class=\"ad\">%'")
def class_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "div.ad", ("text",)).select("page_id", F.col("text").alias("ad"))


@add("SEL24_list", f"SELECT page_id, 'title' AS name, {text_of('title')} AS text FROM pages UNION ALL SELECT page_id, 'h1', {text_of('h1')} FROM pages WHERE html LIKE '%<h1>%'")
def selector_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "title, h1", ("name", "text"))


@add("SEL3_id", f"SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM ({LINK}) GROUP BY page_id")
def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<nav>"), F.lit('<nav id="main">')))
    return S.select(spread(marked), "#main a", ("pos",)).groupBy("page_id").agg(F.count("*").alias("n"))


@add("SEL7_attr_word", "SELECT page_id, 'main wide' AS class FROM pages WHERE html LIKE '%<article>%'")
def attr_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<article>"), F.lit('<article class="main wide">')))
    return S.select(spread(marked), "[class~=wide]", ("attrs",)).select("page_id", F.col("attrs")["class"].alias("class"))


@add("SEL8_attr_dash", "SELECT page_id, regexp_extract(html, '<html lang=\"(.*?)\"', 1) AS lang FROM pages WHERE regexp_extract(html, '<html lang=\"(.*?)\"', 1) = 'en'")
def attr_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "html[lang|=en]", ("attrs",)).select("page_id", F.col("attrs")["lang"].alias("lang"))


@add("SEL5_meta_charset", "SELECT page_id, regexp_extract(html, '<meta charset=\"(.*?)\"', 1) AS charset FROM pages WHERE html LIKE '%<meta charset=%'")
def meta_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "meta[charset]", ("attrs",)).select("page_id", F.col("attrs")["charset"].alias("charset"))


@add("SEL21_root", "SELECT page_id, '!doctype' AS name FROM pages UNION ALL SELECT page_id, 'html' FROM pages")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.query(P.parse_pages(spread(pages(spark, sf_dir))), ":root").select("page_id", "name")


@add("SEL20_empty", "SELECT page_id, 'meta' AS name FROM pages")
def empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.query(P.parse_pages(spread(pages(spark, sf_dir))), "head > :empty").select("page_id", "name")


@add("SEL1_universal", "SELECT name, count(*) AS n FROM pages, (VALUES ('meta'), ('title'), ('style'), ('script')) AS t(name) GROUP BY name")
def universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.query(P.parse_pages(spread(pages(spark, sf_dir))), "head > *").groupBy("name").agg(F.count("*").alias("n"))


@add("QRY2_query_first", links_where("pos = 1", "page_id, href"))
def query_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.first_rows(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav a"), 1)
    return rows.select("page_id", C.attr("href").alias("href"))


@add("QRY3_matches", "SELECT page_id, CAST(sum(CASE WHEN pos > 1 THEN 1 ELSE 0 END) AS BIGINT) AS yes, CAST(sum(CASE WHEN pos = 1 THEN 1 ELSE 0 END) AS BIGINT) AS no FROM (" + LINK + ") GROUP BY page_id")
def node_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = S.flag(P.nodes(P.parse_pages(spread(pages(spark, sf_dir)))).repartition("page_id"), "nav li:not(:first-child)", "page_id")
    return flagged.where("name = 'li'").groupBy("page_id").agg(F.sum(F.col("matched").cast("long")).alias("yes"), F.sum((~F.col("matched")).cast("long")).alias("no"))


@add("QRY4_scoped", HREFS)
def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_links(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "body a", scope="nav"))


@add("PRJ1_attributes", f"SELECT page_id, pos, href, '__MISSING__' AS rel FROM ({LINK})")
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav a"))
    return rows.select("page_id", "pos", C.attr("href").alias("href"), C.attr("rel", "__MISSING__").alias("rel"))


NAV_HTML = decoded("regexp_replace(regexp_extract(html, '(?s)(<ul>.*?</ul>)', 1), 'href=\"([^\"]*)\"', 'href=\\1', 'g')").replace("'&amp;', '&')", "'&amp;', '&amp;')")


@add("PRJ2_outer_html", f"SELECT page_id, {NAV_HTML} AS outer_html FROM pages WHERE html LIKE '%<ul>%'")
def outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "nav > ul", ("outer_html",))


@add("PRJ3_inner_html", f"SELECT page_id, substring({NAV_HTML}, 5, length({NAV_HTML}) - 9) AS inner_html FROM pages WHERE html LIKE '%<ul>%'")
def inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "nav > ul", ("inner_html",))


@add("FN_T1_text_content", "SELECT page_id, " + decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + " AS raw FROM pages WHERE html LIKE '%<h1>%'")
def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.query_text(P.parse_pages(spread(pages(spark, sf_dir))), "h1").select("page_id", F.col("raw_text").alias("raw"))


@add("FN_T2_link_text", f"SELECT page_id, pos, text FROM ({LINK})")
def link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "nav a", ("pos", "text"))


@add("FN_M1_markdown_list", "SELECT page_id, string_agg('- [' || text || '](' || href || ')', chr(10) ORDER BY pos) AS markdown FROM (" + LINK + ") GROUP BY page_id")
def markdown_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "nav ul", ("markdown",))


@add("FN_M1_markdown_page")
def markdown_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), None, ("markdown",))


@add("FN_H2_pretty_page")
def pretty_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), None, ("pretty_html",))


@add("FN_H6_test_format")
def test_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(pages(spark, sf_dir)).select("page_id", U.html_test_format("html").alias("dump"))


@add("FN_E1_entities", "SELECT page_id, " + decoded("html") + " AS text FROM pages")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.html_decode_entities("html").alias("text"))


@add("FN_C1_class_list", "SELECT page_id, 'ad' AS class FROM pages WHERE html LIKE '%<div class=\"ad\">%'")
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.query(P.parse_pages(spread(pages(spark, sf_dir))), "[class]").select("page_id", F.explode(C.class_list()).alias("class"))


# --- tokens, trees, encodings


@add("TOK4_raw_script", "SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS code FROM pages")
def raw_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "script", ("raw_text",)).select("page_id", F.col("raw_text").alias("code"))


@add("ENT2_footer_text", "SELECT page_id, " + collapsed(decoded("regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|$)', 1)")) + " AS footer FROM pages WHERE html LIKE '%<footer>%'")
def footer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "footer", ("text",)).select("page_id", F.col("text").alias("footer"))


@add("TB6_footer_formatting", "SELECT page_id, CAST(least(3, len(regexp_extract_all(html, '<b>'))) AS BIGINT) AS n FROM pages WHERE html LIKE '%<footer>%' AND html LIKE '%<b>%'")
def footer_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of an open <b> at most are opened anew in the footer."""
    return S.select(spread(pages(spark, sf_dir)), "footer b", ("pos",)).groupBy("page_id").agg(F.count("*").alias("n"))


@add("EV1_start_events", "SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script></script>'), '<[a-z]')) AS BIGINT) AS starts, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script></script>'), '</[a-z]')) AS BIGINT) AS ends FROM pages")
def start_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.parse_events(spread(pages(spark, sf_dir)))
    return rows.groupBy("page_id").agg(F.count(F.when(F.col("event") == "start", 1)).alias("starts"), F.count(F.when(F.col("event") == "end", 1)).alias("ends"))


@add("EV1_comments", "SELECT page_id, regexp_extract(html, '(?s)<!--(.*?)-->', 1) AS comment FROM pages WHERE html LIKE '%<!--%'")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_events(spread(pages(spark, sf_dir))).where("event = 'comment'").select("page_id", F.col("text").alias("comment"))


@add("EV1_udtf", "SELECT page_id, 'html' AS name FROM pages")
def events_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.register(spark)
    spread(pages(spark, sf_dir)).createOrReplaceTempView("_event_pages")
    return spark.sql("SELECT page_id, e.doctype.name AS name FROM _event_pages, LATERAL html_events(html) e WHERE e.event = 'doctype'")


@add("SRC4_decode_bytes", f"SELECT page_id, {text_of('title')} AS title FROM pages")
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pages(spark, sf_dir).withColumn("html", F.col("html").cast("binary"))
    return S.select(spread(raw), "title", ("text",)).select("page_id", F.col("text").alias("title"))


@add("SRC5_sniff_encoding", "SELECT 'utf-8' AS encoding, count(*) AS n FROM pages")
def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select(U.sniff_encoding(F.col("html").cast("binary")).alias("encoding"))
    return rows.groupBy("encoding").agg(F.count("*").alias("n"))


@add("SRC3_null_page", "SELECT page_id, CAST(4 AS BIGINT) AS n FROM pages")
def null_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that is null has the four nodes of an empty document."""
    rows = pages(spark, sf_dir).withColumn("html", F.lit(None).cast("string"))
    return P.nodes(P.parse_pages(rows)).groupBy("page_id").agg(F.count("*").alias("n"))


@add("AG5_errors_by_code")
def errors_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = P.parse_pages(spread(pages(spark, sf_dir)), collect_errors=True)
    return P.errors(parsed).groupBy("phase", "code").agg(F.count("*").alias("n"))


@add("AG5_duplicate_attributes", "SELECT 'duplicate-attribute' AS code, count(*) AS n FROM pages WHERE html LIKE '%<article>%'")
def duplicate_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<article>"), F.lit("<article x x>")))
    found = P.errors(P.parse_pages(spread(marked), collect_errors=True)).where("code = 'duplicate-attribute'")
    return found.groupBy("code").agg(F.count("*").alias("n"))


@add("EV5_stream", "SELECT page_id, 'html' AS name FROM pages")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events() under its older name."""
    rows = Engine(spark).stream(spread(pages(spark, sf_dir)))
    return rows.where("event = 'doctype'").select("page_id", F.col("doctype.name").alias("name"))


# --- aggregates, windows, limits, joins


@add("ST1_document_order", f"SELECT page_id, CAST(2 * pos - 1 AS INT) AS pos, 'li' AS name FROM ({LINK}) UNION ALL SELECT page_id, CAST(2 * pos AS INT), 'a' FROM ({LINK})")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav a, nav li")).select("page_id", "pos", "name")


@add("WN4_window_functions", f"SELECT page_id, pos, lag(text) OVER (PARTITION BY page_id ORDER BY pos) AS before, sum(length(text)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two FROM (SELECT page_id, pos, text FROM ({LINK}))")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("pos")
    rows = S.select(spread(pages(spark, sf_dir)), "nav a", ("pos", "text"))
    return rows.select("page_id", "pos", F.lag("text").over(w).alias("before"), F.sum(F.length("text")).over(w.rowsBetween(-1, 0)).alias("two"))


@add("SO4_set_operators", f"SELECT page_id, pos FROM ({LINK}) WHERE pos = 1 OR pos BETWEEN 3 AND 4")
def set_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.select(spread(pages(spark, sf_dir)), "nav a", ("pos",))
    return rows.where("pos <= 4").intersect(rows.where("pos >= 3")).union(rows.where("pos <= 4").exceptAll(rows.where("pos >= 2")))


@add("FN_D1_function_libraries", f"SELECT page_id, pos, reverse(substring(text, 1, 3)) AS start, CAST(round(sqrt(length(text)), 6) AS DOUBLE) AS root, list_contains(string_split(href, '/'), text) AS named FROM ({LINK})")
def function_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.select(spread(pages(spark, sf_dir)), "nav a", ("pos", "text", "attrs"))
    return rows.select("page_id", "pos", F.reverse(F.substring("text", 1, 3)).alias("start"), F.round(F.sqrt(F.length("text")), 6).alias("root"), F.array_contains(F.split(F.col("attrs")["href"], "/"), F.col("text")).alias("named"))


@add("AG1_count", f"SELECT p.page_id, coalesce(n, 0) AS n FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM ({LINK}) WHERE pos > 4 GROUP BY page_id) c ON p.page_id = c.page_id")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav li:nth-child(n+5)")
    return S.counts(found, pages(spark, sf_dir))


@add("AG3_sibling_counts", f"SELECT page_id, CAST(max(n) AS INT) AS items FROM ({LINK}) GROUP BY page_id")
def sibling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nodes(P.parse_pages(spread(pages(spark, sf_dir)))).where("name = 'li' AND elem_pos = 1").select("page_id", F.col("elem_cnt").alias("items"))


@add("AG4_records", f"SELECT page_id, string_agg(href, ',' ORDER BY pos) AS record FROM ({LINK}) GROUP BY page_id")
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.records(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav a"), C.attr("href"), separator=",")


@add("AG6_group_by_tag", f"SELECT name, sum(n) AS n FROM (SELECT unnest(['a', 'li']) AS name, count(*) AS n FROM ({LINK}) UNION ALL SELECT 'nav', count(*) FROM pages WHERE html LIKE '%<nav>%') GROUP BY name")
def group_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.nodes(P.parse_pages(spread(pages(spark, sf_dir))))
    return nodes.where(F.col("name").isin("a", "li", "nav")).groupBy("name").agg(F.count("*").alias("n"))


@add("WN1_sibling_rank", f"SELECT page_id, pos, pos AS rank FROM ({LINK})")
def sibling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav li"), name="rank")
    return rows.select("page_id", F.col("elem_pos").alias("pos"), "rank")


@add("WN3_previous_element", f"SELECT page_id, pos, pos > 1 AS has_previous FROM ({LINK})")
def previous_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav li")
    return rows.select("page_id", F.col("elem_pos").alias("pos"), F.col("prev_elem_id").isNotNull().alias("has_previous"))


@add("LM1_first", links_where("pos = 1", "page_id, text"))
def first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_first(spread(pages(spark, sf_dir)), "nav a", ("text",))


@add("LM2_limit", links_where("pos <= 2"))
def limit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.first_rows(S.query(P.parse_pages(spread(pages(spark, sf_dir))), "nav a"), 2)
    return as_links(rows)


@add("LM4_top_k", f"SELECT page_id, count(*) AS n FROM ({LINK}) GROUP BY page_id ORDER BY n DESC, page_id LIMIT 10")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.select(spread(pages(spark, sf_dir)), "nav a", ("pos",)).groupBy("page_id").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "page_id").limit(10)


@add("JN7_equi_join", f"SELECT p.page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, {text_of('title')} AS title FROM pages p")
def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = S.select(spread(pages(spark, sf_dir)), "title", ("text",)).select("page_id", F.col("text").alias("title"))
    hosts = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return hosts.join(titles, "page_id")


# --- targeted extraction and changes of trees


@add("TS1_first_paragraph", "SELECT page_id, " + collapsed(decoded("regexp_replace(regexp_extract(html, '(?s)<article>.*?<p>(.*?)(?:<p>|</p>|</article>|$)', 1), '<[^>]*>', '', 'g')")) + " AS lead FROM pages WHERE regexp_matches(html, '(?s)<article>.*?<p>')")
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_first(spread(pages(spark, sf_dir)), "article p", ("text",)).select("page_id", F.col("text").alias("lead"))


@add("TS3_prefilter", "SELECT page_id, 'x' AS name FROM pages WHERE false")
def prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the literal, and without references that could spell it, are not parsed."""
    return S.select(spread(pages(spark, sf_dir)), "form.login", ("name",), targeted=True)


def changed_items(df: DataFrame) -> DataFrame:
    return S.query(df, "nav li").select("page_id", F.col("elem_pos").alias("pos"))


@add("MUT1_append", f"SELECT page_id, pos FROM ({LINK}) UNION ALL SELECT page_id, CAST(max(n) + 1 AS INT) FROM ({LINK}) GROUP BY page_id")
def mut_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_items(M.append(P.parse_pages(spread(pages(spark, sf_dir))), "nav ul", "<li>more</li>"))


@add("MUT2_remove", f"SELECT page_id, CAST(pos - 1 AS INT) AS pos FROM ({LINK}) WHERE pos > 1")
def mut_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_items(M.remove(P.parse_pages(spread(pages(spark, sf_dir))), "nav li:first-child"))


@add("MUT2_prune", links_where("pos > 1"))
def mut_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = M.prune(P.nodes(P.parse_pages(spread(pages(spark, sf_dir)))), "nav li:first-child")
    return S.numbered(S.matched(left, "nav li > a")).select("page_id", (F.col("pos") + 1).alias("pos"), C.attr("href").alias("href"))


@add("MUT3_insert_before", f"SELECT page_id, CAST(pos + 1 AS INT) AS pos FROM ({LINK}) UNION ALL SELECT DISTINCT page_id, 1 FROM ({LINK})")
def mut_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_items(M.insert_before(P.parse_pages(spread(pages(spark, sf_dir))), "nav li:first-child", "<li>new</li>"))


@add("MUT4_replace", f"SELECT page_id, pos, CASE WHEN pos = 1 THEN '' ELSE href END AS href FROM ({LINK})")
def mut_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_links(S.query(M.replace(P.parse_pages(spread(pages(spark, sf_dir))), "nav li:first-child > a", "<a>none</a>"), "nav a"))


@add("MUT6_clone", f"SELECT page_id, CAST(pos AS INT) AS pos FROM ({LINK}) UNION ALL SELECT page_id, CAST(max(n) + 1 AS INT) FROM ({LINK}) GROUP BY page_id")
def mut_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_items(M.clone(P.parse_pages(spread(pages(spark, sf_dir))), "nav li:last-child"))


@add("MUT5_guards", f"SELECT page_id, true AS refused, CAST(count(*) AS INT) AS items FROM ({LINK}) GROUP BY page_id")
def mut_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list cannot be moved into an item of its own; the page stays as it was."""
    left = M.move(P.parse_pages(spread(pages(spark, sf_dir))), "nav ul", "nav li")
    items = F.size(F.filter("nodes", lambda x: x["name"] == "li"))
    return left.select("page_id", F.col("mutation_error").isNotNull().alias("refused"), items.alias("items")).where("items > 0")


@add("TS9_nested_results", f"SELECT page_id, pos, text FROM ({LINK}) UNION ALL SELECT page_id, 0, string_agg(text, '' ORDER BY pos) FROM ({LINK}) GROUP BY page_id")
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match inside another is a value of its own."""
    rows = S.select(spread(pages(spark, sf_dir)), "nav ul, nav li", ("pos", "text"), targeted=True)
    return rows.select("page_id", (F.col("pos") - 1).alias("pos"), "text")


@add("TS10_all_matches", "SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n FROM pages WHERE html LIKE '%<p>%'")
def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(spread(pages(spark, sf_dir)), "body p", ("pos",), targeted=True).groupBy("page_id").agg(F.count("*").alias("n"))


# --- templates, fragments, orders, statistics


def in_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose navigation stands in a template."""
    html = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<template><nav>")), F.lit("</nav>"), F.lit("</nav></template>"))
    return pages(spark, sf_dir).withColumn("html", html)


@add("QRY5_template_content", f"SELECT page_id, CAST(count(*) AS BIGINT) AS inside, CAST(0 AS BIGINT) AS across FROM ({LINK}) GROUP BY page_id")
def template_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template content is searched, but its elements have no ancestors outside it."""
    rows = S.flag(S.flag(P.nodes(P.parse_pages(spread(in_templates(spark, sf_dir)))).repartition("page_id"), "nav a", "page_id", "inside"), "template a", "page_id", "across")
    return rows.where("name = 'a'").groupBy("page_id").agg(F.sum(F.col("inside").cast("long")).alias("inside"), F.sum(F.col("across").cast("long")).alias("across"))


@add("JN6_template_owner", "SELECT page_id, 'template' AS owner, CAST(1 AS INT) AS tree_id FROM pages WHERE html LIKE '%<nav>%'")
def template_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.owned_trees(P.parse_pages(spread(in_templates(spark, sf_dir)))).select("page_id", "owner", "tree_id")


@add("AG2_ordered_concat", f"SELECT page_id, string_agg(text, '' ORDER BY pos) AS record FROM ({LINK}) GROUP BY page_id")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes below the navigation, put together in document order."""
    rows = P.nodes(P.parse_pages(spread(pages(spark, sf_dir)))).repartition("page_id")
    return S.records(S.flag_parent(rows, "nav a", "page_id").where("kind = 'text' and matched"), C.own_text(), separator="")


@add("FN_T3_own_text", "SELECT page_id, " + decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " AS text FROM pages")
def own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.nodes(P.parse_pages(spread(pages(spark, sf_dir)))).repartition("page_id")
    return S.flag_parent(rows, "head > title", "page_id").where("matched").select("page_id", C.own_text().alias("text"))


@add("ST2_sorted_attributes", "SELECT page_id, 'a=2,b=1,z=3' AS attributes FROM pages WHERE html LIKE '%<article>%'")
def sorted_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<article>"), F.lit("<article z=3 a=2 b=1>")))
    rows = S.query(P.parse_pages(spread(marked)), "article")
    return rows.select("page_id", F.array_join(F.transform(C.sorted_attrs(), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes"))


@add("TB18_fragment", f"SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM ({LINK}) GROUP BY page_id")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, parsed as what a <div> would hold: no html, head or body is made."""
    rows = P.nodes(P.parse_pages(spread(pages(spark, sf_dir)), context=("div", "html")))
    made = rows.groupBy("page_id").agg(F.count(F.when(F.col("name") == "li", 1)).alias("n"), F.count(F.when(F.col("name").isin("html", "head", "body"), 1)).alias("implied"))
    return made.where("n > 0 and implied = 0").select("page_id", "n")


@add("TS11_read_statistics")
def read_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far into each page the first paragraph's search reads, and how many elements it makes."""
    return S.select_statistics(spread(pages(spark, sf_dir)), "article p")


QUERIES |= cases.QUERIES
ORACLE_SQL |= cases.ORACLE_SQL
