"""Headline queries over `pages`, timed; prints one JSON line.

    BENCH_SF_DIR  input (default /root/testdata/sf0.1)    BENCH_CPUS  cores (default: all)

Every query writes to Spark's noop sink: all rows and columns are computed, none are kept.
The figure of a query is the median of RUNS after WARM_UPS.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WARM_UPS, RUNS = 2, 5


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sparkdom.operators.parse import nodes, parse_events, parse_pages
    from sparkdom.operators.select import query, select, select_first
    from sparkdom.queries import pages, spread
    from sparkdom.ship import ship

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    source = spread(pages(spark, sf_dir)).select("page_id", "html").cache()
    n, chars = source.selectExpr("count(*)", "sum(length(html))").first()
    parsed = parse_pages(source)
    jobs = {
        "parse_nodes": lambda: nodes(parse_pages(source)),
        "events": lambda: parse_events(source),
        "select_title": lambda: select(source, "title", ("text",)),
        "select_links": lambda: select(source, "nav > ul > li > a", ("pos", "attrs", "text")),
        "select_first_paragraph": lambda: select_first(source, "article p", ("text",)),
        "markdown": lambda: select(source, None, ("markdown",)),
        "relational_child_cached": lambda: query(parsed, "nav > ul > li > a"),
        "relational_descendant_cached": lambda: query(parsed, "nav a"),
        "relational_not_cached": lambda: query(parsed, "nav li:not(:first-child)"),
    }
    took = {}
    for name, job in jobs.items():
        if name.endswith("_cached") and not parsed.is_cached:  # not sooner: Spark would serve parse_nodes from it
            parsed.cache().count()
        times = []
        for k in range(WARM_UPS + RUNS):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            if k >= WARM_UPS:
                times.append(time.perf_counter() - began)
        took[name] = round(median(times), 4)
    # pages of about a megabyte, one to a core; not part of the total
    large = source.groupBy((source.page_id % cpus).alias("page_id")).agg(F.concat_ws("", F.collect_list("html")).alias("html")).repartition(cpus).cache()
    large.count()
    large_rate = {}
    for name, job in {"parse_nodes": lambda: nodes(parse_pages(large)), "events": lambda: parse_events(large)}.items():
        times = []
        for k in range(3):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        large_rate[name] = round(chars / 1e6 / cpus / median(times), 3)
    rate = {k: round(n / v) for k, v in took.items()}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "pages": n, "characters": chars, "cpus": cpus, "pages_per_second": rate, "ms_per_page_and_core": {k: round(1000 * v * cpus / n, 3) for k, v in took.items()}, "large_pages_mb_per_second_and_core": large_rate}))
    spark.stop()


if __name__ == "__main__":
    main()
