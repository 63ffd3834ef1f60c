"""One place to reach the operators from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from sparkdom.functions.sql import register
from sparkdom.operators import parse as P
from sparkdom.operators import select as S
from sparkdom.plans.targeted import compile_targeted
from sparkdom.ship import ship
from sparkdom.sources import pages as R


class Engine:
    """Pages of one session. key and html name the columns of page tables."""

    def __init__(self, spark: SparkSession, key: str = "page_id", html: str = "html"):
        self.spark, self.key, self.html = spark, key, html
        ship(spark)

    def read(self, path: str) -> DataFrame:
        return R.read_table(self.spark, path, self.key, self.html)

    def register(self) -> Engine:
        register(self.spark)
        return self

    def parse(self, df: DataFrame, where: Column | None = None, **options) -> DataFrame:
        return P.parse_pages(df, self.key, self.html, where, **options)

    def nodes(self, pages: DataFrame) -> DataFrame:
        return P.nodes(pages, self.key)

    def trees(self, pages: DataFrame) -> DataFrame:
        return P.trees(pages, self.key)

    def errors(self, pages: DataFrame) -> DataFrame:
        return P.errors(pages, self.key)

    def events(self, df: DataFrame, **options) -> DataFrame:
        return P.parse_events(df, self.key, self.html, **options)

    #: the older name of events()
    stream = events

    def query(self, pages: DataFrame, selector: str, scope: DataFrame | str | None = None) -> DataFrame:
        return S.query(pages, selector, self.key, scope)

    def query_first(self, pages: DataFrame, selector: str) -> DataFrame:
        return S.first_rows(S.query(pages, selector, self.key), 1, self.key)

    def matches(self, node_table: DataFrame, selector: str, name: str = "matched") -> DataFrame:
        return S.flag(node_table, selector, self.key, name)

    def query_text(self, pages: DataFrame, selector: str) -> DataFrame:
        return S.query_text(pages, selector, self.key)

    def with_text(self, rows: DataFrame, pages: DataFrame) -> DataFrame:
        return S.with_text(rows, pages, self.key)

    def select(self, df: DataFrame, selector: str | None, fields: Sequence[str] = ("pos", "name", "text"), **options) -> DataFrame:
        return S.select(df, selector, fields, key=self.key, html=self.html, **options)

    def select_targeted(self, df: DataFrame, selector: str, fields: Sequence[str] = ("pos", "name", "text"), **options) -> DataFrame:
        compile_targeted(selector)
        return self.select(df, selector, fields, targeted=True, **options)

    def select_first(self, df: DataFrame, selector: str, fields: Sequence[str] = ("name", "text"), **options) -> DataFrame:
        return self.select_targeted(df, selector, fields, limit=1, **options)
