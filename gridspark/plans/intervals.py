"""Interval tables built from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import intervals
from gridspark.operators.ordered import FromData
from gridspark.plans.fixtures import DAYS_SQL, SERIES_SQL, events, interval_series, order_intervals, seconds
from gridspark.plans.registry import query, r6, table



def ship_points(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", seconds("l_shipdate").alias("t"))


@query("jn2_interval_lookup", f"""
    SELECT i.t0 AS interval_t0, count(*) AS points, sum(p.l_quantity) AS quantity, round(max(i.value), 2) AS value_at
    FROM (SELECT l_quantity, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem) p
    JOIN ({DAYS_SQL}) i ON i.t0 <= p.t AND p.t < i.t1 GROUP BY 1""")
def jn2(spark, sf):
    out = intervals.interval_lookup(ship_points(spark, sf), order_intervals(spark, sf), "t", "value", FromData())
    inside = out.filter(F.col("interval_t0").isNotNull())
    return inside.groupBy("interval_t0").agg(
        F.count(F.lit(1)).alias("points"), F.sum("l_quantity").alias("quantity"), r6(F.max("value_at"), 2).alias("value_at"))


@query("jn2_outside_span", f"""
    WITH i AS ({DAYS_SQL})
    SELECT t, count(*) AS points FROM (SELECT epoch_us(l_shipdate) / 1e6 AS t FROM lineitem)
    WHERE t < (SELECT min(t0) FROM i) OR t >= (SELECT max(t1) FROM i) GROUP BY 1""")
def jn2_outside(spark, sf):
    out = intervals.interval_lookup(ship_points(spark, sf), order_intervals(spark, sf), "t", "value", FromData())
    return intervals.outside_span(out).groupBy("t").agg(F.count(F.lit(1)).alias("points"))


Q_NODES = [1.0, 10.0, 25.0, 40.0, 50.0]
T_NODES = [0.0, 0.02, 0.05, 0.08]


def _sql_bracket(x, nodes):
    lo = "CASE " + " ".join(f"WHEN {x} < {b} THEN {i}" for i, b in enumerate(nodes[1:])) + f" ELSE {len(nodes) - 2} END"
    return lo


@query("jn6_interpolate_grid", f"""
    WITH g AS (SELECT l_quantity AS q, l_tax AS t, avg(l_extendedprice) AS v FROM lineitem
               WHERE l_quantity IN (1, 10, 25, 40, 50) AND l_tax IN (0.0, 0.02, 0.05, 0.08) GROUP BY 1, 2),
         n AS (SELECT q, t, v, list_position([1.0, 10.0, 25.0, 40.0, 50.0], q) - 1 AS qi,
                      list_position([0.0, 0.02, 0.05, 0.08], t) - 1 AS ti FROM g),
         p AS (SELECT l_quantity AS q, l_tax AS t, count(*) AS points,
                      {_sql_bracket('l_quantity', Q_NODES)} AS qi, {_sql_bracket('l_tax', T_NODES)} AS ti
               FROM lineitem GROUP BY 1, 2, 4, 5),
         w AS (SELECT p.*, (p.q - [1.0, 10.0, 25.0, 40.0, 50.0][p.qi + 1])
                          / ([1.0, 10.0, 25.0, 40.0, 50.0][p.qi + 2] - [1.0, 10.0, 25.0, 40.0, 50.0][p.qi + 1]) AS fq,
                      (p.t - [0.0, 0.02, 0.05, 0.08][p.ti + 1])
                          / ([0.0, 0.02, 0.05, 0.08][p.ti + 2] - [0.0, 0.02, 0.05, 0.08][p.ti + 1]) AS ft FROM p)
    SELECT w.q, w.t, w.points, round((1 - fq) * (1 - ft) * a.v + fq * (1 - ft) * b.v
                                     + (1 - fq) * ft * c.v + fq * ft * d.v, 4) AS price
    FROM w JOIN n a ON a.qi = w.qi AND a.ti = w.ti JOIN n b ON b.qi = w.qi + 1 AND b.ti = w.ti
           JOIN n c ON c.qi = w.qi AND c.ti = w.ti + 1 JOIN n d ON d.qi = w.qi + 1 AND d.ti = w.ti + 1""")
def jn6(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), "l_extendedprice")
    grid = (df.filter(F.col("q").isin(*Q_NODES) & F.col("t").isin(*T_NODES)).groupBy("q", "t")
            .agg(F.avg("l_extendedprice").alias("price")))
    points = df.groupBy("q", "t").agg(F.count(F.lit(1)).alias("points"))
    out = intervals.interpolate_grid(points, grid, {"q": Q_NODES, "t": T_NODES}, "price")
    return out.withColumn("price", r6(F.col("price"), 4))


@query("src7_uniform_intervals", """
    WITH b AS (SELECT min(epoch_us(l_shipdate)) / 1e6 AS lo, max(epoch_us(l_shipdate)) / 1e6 AS hi FROM lineitem),
         n AS (SELECT lo, CAST(ceil((hi - lo) / 3600.0) AS BIGINT) AS n FROM b)
    SELECT i, lo + 3600.0 * i AS t0, lo + 3600.0 * (i + 1) AS t1
    FROM (SELECT lo, unnest(range(0, n)) AS i FROM n)""")
def src7(spark, sf):
    b = table(spark, sf, "lineitem").agg(F.min(seconds("l_shipdate")).alias("lo"), F.max(seconds("l_shipdate")).alias("hi")).first()
    return intervals.uniform_intervals(spark, b["lo"], 3600.0, int(-((b["lo"] - b["hi"]) // 3600.0)))


@query("win1_contiguity", """
    SELECT * FROM (SELECT l_partkey, lag(t1) OVER (PARTITION BY l_partkey ORDER BY t0, t1) AS previous_end, t0,
        CASE WHEN lag(t1) OVER (PARTITION BY l_partkey ORDER BY t0, t1) < t0 THEN 'gap' ELSE 'overlap' END AS problem
        FROM (SELECT DISTINCT l_partkey, epoch_us(l_shipdate) / 1e6 AS t0,
                     epoch_us(l_shipdate) / 1e6 + 86400 * l_quantity AS t1 FROM lineitem))
    WHERE previous_end <> t0""")
def win1(spark, sf):
    t0 = seconds("l_shipdate")
    df = table(spark, sf, "lineitem").select("l_partkey", t0.alias("t0"), (t0 + 86400 * F.col("l_quantity")).alias("t1")).distinct()
    return intervals.contiguity(df, FromData(), ["l_partkey"])


@query("win2_span", f"SELECT cell, min(t0) AS t0, max(t1) AS t1 FROM ({SERIES_SQL}) GROUP BY 1")
def win2(spark, sf):
    return intervals.span(interval_series(spark, sf), ["cell"])


@query("win5_last_records", """
    SELECT user_id, event_id, back FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back
        FROM events) WHERE back <= 5""")
def win5(spark, sf):
    out = intervals.newest_records(events(spark, sf), 5, ["ts", "event_id"], FromData(), ["user_id"])
    return out.select("user_id", "event_id", "back")


@query("win7_not_increasing", """
    SELECT l_orderkey, l_linenumber, l_partkey, t, previous FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t,
               lag(t) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS previous
        FROM (SELECT *, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem)) WHERE t <= previous""")
def win7(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                             seconds("l_shipdate").alias("t"))
    out = intervals.not_increasing(df, "t", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"],
                                   FromData(), ["l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "t", "previous")


@query("win8_sequence_numbers", """
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 999 AS sequence FROM events""")
def win8(spark, sf):
    out = intervals.sequence_numbers(events(spark, sf), ["ts", "event_id"], FromData(), 1000)
    return out.select("event_id", "sequence")


@query("top2_journal_order", """
    SELECT event_id AS sequence, row_number() OVER (ORDER BY ts, event_type, user_id, event_id, props) AS position FROM events""")
def top2(spark, sf):
    out = intervals.sequence_numbers(events(spark, sf), ["ts", "event_type", "user_id", "event_id", "props"],
                                     FromData(), 1, name="position")
    return out.select(F.col("event_id").alias("sequence"), "position")
