"""Registration of queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return add


def shared_sql(name: str, text: str, tables: str, spark_text: str | None = None) -> None:
    """A query that Spark SQL and the oracle state alike (spark_text: where a function is called otherwise)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
        body = spark_text or text
        for t in frames:
            body = body.replace(f"@{t}", "{" + t + "}")
        return spark.sql(body, **frames)

    QUERIES[name] = run
    ORACLES[name] = text.replace("@", "")
