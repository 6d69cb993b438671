"""The table of registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = dedent(sql).strip()
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table whose splits are fewer than the cores, dealt out before costly text work.

    Only for a bare scan, whose splits are known without running anything; a table with at least as
    many splits as cores is returned as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Added before rounding a mean of decimal values, in the query and in its SQL: such means can lie exactly
# halfway between two roundings, where the last bit of a sum would decide.
NUDGE = 0.000000033


def r6(c: Column, places: int = 6) -> Column:
    """Rounded for comparison between engines; the operators themselves never round."""
    return F.round(c, places)
