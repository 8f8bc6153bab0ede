"""Table of registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pictorium.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Inputs:
    """Given tables and views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return views.view(self.spark, self.sf_dir, name)
        if name in views.GIVEN:
            return views.given(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def query(name: str, check: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(inputs) -> DataFrame`` with its check SQL over the views it uses."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if check is not None:
            prefix = views.check_cte(uses)
            body = check.strip()
            if prefix and body.startswith("WITH RECURSIVE "):
                prefix, body = "WITH RECURSIVE " + prefix[5:], ",\n" + body[15:]
            elif prefix and body.startswith("WITH "):
                body = ",\n" + body[5:]
            CHECKS[name] = prefix + body
        return fn

    return add
