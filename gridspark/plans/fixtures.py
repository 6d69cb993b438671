"""How the given tables stand in for the engine's inputs: fields of cells, journals, readings.

Each function is a projection of one table, so every query built on it reads that whole table and
only the columns it uses. SQL fragments of the same projections sit beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.operators.ordered import FromData, lagged

from gridspark.plans.registry import table

LEVEL = 5  # the level of the fine field: 20 * 4^5 = 20480 cells
CELLS = 20480
LEGEND = ("A", "N", "R")
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

CELL_SQL = f"(1 + l_orderkey % {CELLS})"


def anc_sql(depth: int) -> str:
    return f"((l_orderkey % {CELLS}) // {4**depth} + 1)"


def fine_field(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a fine field: cell, value, weight, label, mask, time, and the total order."""
    return table(spark, sf, "lineitem").withColumn("cell", (F.lit(1) + F.pmod("l_orderkey", F.lit(CELLS))).cast("bigint"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


# one row per cell
CELL_TABLE_SQL = f"""
    SELECT {CELL_SQL} AS cell, sum(l_extendedprice) AS value, sum(l_quantity) AS weight
    FROM lineitem GROUP BY 1
"""


def cell_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cell that holds line items: summed value and summed weight."""
    return fine_field(spark, sf).groupBy("cell").agg(
        F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("weight")
    )


def seconds(col: str) -> Column:
    """A timestamp column as SI seconds."""
    return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)


# each event closes the interval its user's previous event opened
SERIES_SQL = """
    SELECT * FROM (SELECT user_id AS cell, event_id, event_type, value, epoch_us(ts) / 1e6 AS t1,
           lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS t0
    FROM events) WHERE t0 IS NOT NULL
"""


def interval_series(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one contiguous interval series per user: [previous instant, instant)."""
    df = events(spark, sf).select(F.col("user_id").alias("cell"), "event_id", "event_type", "value", seconds("ts").alias("t1"))
    return lagged(df, {"t0": "t1"}, ["t1", "event_id"], FromData(), ["cell"]).filter("t0 IS NOT NULL")


# order days as contiguous intervals, each holding the order value of its first day
DAYS_SQL = """
    SELECT d AS t0, coalesce(lead(d) OVER (ORDER BY d), d + 86400.0) AS t1, v AS value FROM (
        SELECT epoch_us(o_orderdate) / 1e6 AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)
"""


def order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct order days as contiguous half-open intervals, with the day's order value."""
    days = table(spark, sf, "orders").groupBy(seconds("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("value"))
    # read backwards, the row before a day is the day after it
    back = days.withColumn("neg", -F.col("d"))
    out = lagged(back, {"next": "d"}, ["neg"], FromData())
    return out.select(F.col("d").alias("t0"), F.coalesce("next", F.col("d") + 86400.0).alias("t1"), "value")
