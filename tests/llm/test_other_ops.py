"""URL filter, nearest neighbours, WARC, the pipeline and the registered queries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkdom.llm import ann, common, queries, url_filter, warc  # noqa: E402

PAGES = "page_id long, url string, html string"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    (1, "http://a.example.org/en/12", "example.org/en/1", "block"), (2, "http://a.example.org/en/2", "org/", "allow"), (3, "HTTPS://A.Example.ORG/es/", "example.org/es/", "block"), (4, "http://notexample.org/es/", "org/", "allow"),
    (5, "http://com/de/x?y", "com/de/", "block"), (6, "http://x.com/fr/#a", "com/fr/", "allow"), (7, "http://x.com?/de/", None, "allow"), (8, "x.com/de/", None, "allow"), (9, None, None, "allow"), (10, "", None, "allow"),
    (11, "://org/", "org/", "allow"), (12, "a://b://c.org/", None, "allow"), (None, "http://x.net/", None, "allow"), (1, "http://a.example.org/en/12", "example.org/en/1", "block"),
]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(i, u, None) for i, u, *_ in URLS], PAGES).withColumn("host", F.lit("clash"))


def test_url_rules(spark, urls):
    want = sorted((str(i), str(r), v) for i, _, r, v in URLS)
    for rules in (RULES, [("com", "/de/", "other"), *RULES]):  # the later of two counts
        rows = url_filter.filter_urls(urls, rules, "page_id").collect()
        assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in rows) == want
    assert {r.verdict for r in url_filter.filter_urls(urls, [], "page_id", default="block").collect()} == {"block"}
    assert url_filter.filter_urls(urls.where("false"), RULES, "page_id").count() == 0


def test_many_rules_and_long_urls(spark):
    """A list of any size is one mapped file; no probe for what no rule could be."""
    rules = [(f"h{i}.net", f"/p{i % 7}/", "block" if i % 2 else "allow") for i in range(200_000)]
    long_host, long_path = "a." * 50_000 + "h5.net", "/p5/" + "x" * 500_000
    df = spark.createDataFrame([(1, f"http://{long_host}{long_path}", None), (2, "http://h199999.net/p3/", None), (3, "http://h6.net/p0/", None), (4, "http://x.h8.net/p1/a", None)], PAGES)
    found = url_filter.filter_urls(df, iter(rules), "page_id", default="none")
    assert "Join" not in found._jdf.queryExecution().sparkPlan().toString()
    rows = {r.page_id: (r.rule, r.verdict) for r in found.collect()}
    assert rows == {1: ("h5.net/p5/", "block"), 2: (None, "none") if 199_999 % 7 != 3 else ("h199999.net/p3/", "block"), 3: (None, "none"), 4: ("h8.net/p1/", "allow")}
    assert len(url_filter._candidates(long_host, long_path, [1, 4], 2)) == 4


def test_digest_array(tmp_path):
    words = [f"w{i}".encode() for i in range(1000)]

    def index(strings, values, *digest):
        (tmp_path / "a").write_bytes(b"".join(url_filter.DigestArray.pack(strings, values, *digest)))
        return url_filter.DigestArray.mapped(str(tmp_path / "a"))

    same = lambda s: 7
    for digest in ((), (same,)):  # every digest the same: the stored strings decide
        array = index([*words, b"w5"], [*range(1000), 77], *digest)
        assert len(array.keys) == 1000
        at = array.probe([b"w5", b"none", b"w999"], *digest)
        assert at[1] == -1 and [array.string(i) for i in at[[0, 2]]] == [b"w5", b"w999"] and array.values[at[[0, 2]]].tolist() == [77, 999]
    assert index([], []).probe([b"a"]).tolist() == [-1]


def exact(rows, k, asks):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    return {i: sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i)[:k] for i, q in good if asks(i)}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 8), (9003, [1.0] * 7 + [None]), (9004, [float("nan")] * 8), (9005, [float("inf")] + [0.0] * 7), (9006, [1.0] * 5), (None, [1.0] * 8), (9100, rows[0][1]), (9200, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    want = exact(rows, 10, lambda i: i % 100 == 0)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and [(s, v) for _, s, v in found] == sorted((s, v) for _, s, v in found)
        hits += len({v for *_, v in found} & {j for _, j in want[q]})
    assert hits >= 0.98 * 10 * len(want)
    assert [v for _, s, v in got[0] if s == 0][:2] == [9100, 9200]  # ties to the smaller id
    # queries in several groups give the same
    again = ann.nearest(df, F.col("vec_id") % 100 == 0, group_bytes=1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 100 == 0).collect()))
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 1)
    assert few.count() == 3
    assert ann.nearest(df.where("false"), F.col("vec_id") == 1).count() == 0


def test_neighbours_among_copies(spark):
    """Far more copies of a vector than a block ranks exactly: the smallest ids win, and what is nearer is not crowded out."""
    rng = np.random.default_rng(5)
    copy = rng.normal(size=8)
    near = [copy + s * (0.5 + 0.05 * j) * np.eye(8)[j % 8] for j in range(8) for s in (1, -1)]
    rows = [(i, copy if i % 3 == 1 else near[i % 16] + 0.01 * rng.normal(size=8) if i % 50 == 0 else 3 * rng.normal(size=8)) for i in range(4000)]
    rows += [(7, copy)] * 15 + [(100, copy)] * 15  # repeated rows, one of them under a query's id
    rows = [(i, v.astype(np.float32).tolist()) for i, v in rows]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asks = lambda i: i % 100 == 0 or i in (1, 7)
    good = [(i, np.array(v, float)) for i, v in rows]
    got: dict = {}
    for r in ann.nearest(df, (F.col("vec_id") % 100 == 0) | F.col("vec_id").isin(1, 7)).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for i in (1, 7):
        q = next(v for j, v in good if j == i)
        assert sorted(got[i]) == sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i)[:10]
    hits = total = 0
    for i, q in good:
        if asks(i) and i not in (1, 7, 100):
            want = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i)[:10]
            hits += (Counter(j for _, j in want) & Counter(j for _, j in got[i])).total()
            total += 10
    assert hits >= 0.98 * total


def test_quantizer_scores():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    aq = ann.AdditiveQuantizer(4, 16).fit(x)
    codes, norms = aq.encode(x)
    made = sum(aq.c[m, codes[:, m]] for m in range(4)).astype(float)
    q = rng.normal(size=(3, 16))
    want = ((q[:, None] - made[None]) ** 2).sum(2) - (q * q).sum(1)[:, None]
    assert np.allclose(aq.scores(q, codes, norms), want, atol=1e-3)
    greedy = ann.AdditiveQuantizer(4, 16, beam=1)
    greedy.set(aq.c)
    g = greedy.encode(x)[0]
    far = lambda c: ((x - sum(aq.c[m, c[:, m]] for m in range(4))) ** 2).sum()
    assert far(codes) <= far(g)


def test_warc_round_trip(spark):
    rng = random.Random(3)
    rows = [(1, "http://a/\r\nX: y", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (6, "u", "ünïcode\r\n\r\nWARC/1.1"), (7, "u", "".join(chr(rng.randint(32, 1000)) for _ in range(300_000))), (8, "u", "one"), (8, "u", "one")]
    df = spark.createDataFrame(rows, PAGES).withColumn("kind", F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(spark, df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    top = {"same": 3, "": 5}
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        t = top.get(h or "", i)
        revisit = i is not None and i < t
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.record_type for r in warc.round_trip(spark, df.where("page_id < 4"), min_revisit=5).collect()] == ["response"] * 3
    assert warc.round_trip(spark, df.where("false")).count() == 0


def test_warc_files(spark, tmp_path, monkeypatch):
    """Files that gzip reads too; a record of over 16 MB does not end with a zero byte."""
    monkeypatch.setattr(warc, "FILE_ROWS", 2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    rows = [(1, "a", "x" * (17 << 20)), (2, "b", "y"), (3, "c", "y" * 1000), (4, "d", None), (5, "e", "z")]
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_records(spark.createDataFrame(rows, PAGES).coalesce(1), "page_id", "html"), path)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) == 3 and not list((tmp_path / "w").glob("part*.txt"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1") for f in files) == 5
    assert sum(len(list(warc.read_records([f.read_bytes()]))) for f in files) == 5
    got = warc.read_warc(spark, path).orderBy("id").collect()
    assert [(r.id, r.payload_bytes) for r in got] == [(1, 17 << 20), (2, 1), (3, 1000), (4, 0), (5, 1)]


def test_hot_digest_is_split(spark):
    """The join on digests has no aggregate right above its exchange: Spark may split a skewed side."""
    df = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 35, "same").otherwise(F.col("id").cast("string")).alias("html"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = warc.plan_records(df, "page_id", "html")
        assert "Aggregate" not in plan._jdf.queryExecution().sparkPlan().toString()
        assert plan.where("kind = 'revisit' and refers_to = 34").count() == 34
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_can_be_deleted(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], PAGES)
    out = warc.round_trip(spark, df)
    assert out.count() == 2 and common.leftovers(spark)
    common.clean(spark)
    assert not common.leftovers(spark)


def test_warc_damage(spark, tmp_path):
    good = warc.record("response", "http://a/", b"hello", "1") + warc.record("revisit", "http://b/", b"hello", "2", "1")
    assert [(r.kind, r.http()[1]) for r in warc.read_records([good[k : k + 7] for k in range(0, len(good), 7)])] == [("response", b"hello"), ("revisit", b"")]
    for bad in (good[:-5], good[:30] + bytes([good[30] ^ 255]) + good[31:], b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records([bad]))
    whole = b"".join(warc.members([warc.record("response", "u", b"hello", "1")]))
    for a, b in ((b"hello", b"hellO"), (b"Content-Length: 8", b"Content-Length: 9"), (b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse(whole.replace(a, b, 1) if a in whole else b"")
    (tmp_path / "a.warc.gz").write_bytes(good)
    assert [r.record_type for r in warc.read_warc(spark, str(tmp_path)).orderBy("id").collect()] == ["response", "revisit"]


def test_queries_and_pipeline(spark, small):
    duckdb = pytest.importorskip("duckdb")
    assert sorted({int(k[2:].split("_")[0]) for k in queries.QUERIES}) == list(range(1, 11))
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, small)
        r = con.execute(sql)
        order = [c[0] for c in r.description]
        assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x)) for x in df.select(*order).collect())
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-copies", "repeated passages", "benchmark leaks", "encoding"]
    at, ids = docs, {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, small).cache()
        now = {r.doc_id for r in at.collect()}
        assert now <= ids
        if k < 4:
            assert at.columns == docs.columns
        ids = now
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, at.collect()))
