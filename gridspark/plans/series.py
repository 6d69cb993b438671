"""Series statistics with each user's events as one series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import series
from gridspark.operators.ordered import FromData
from gridspark.operators.reduce import segmented_median
from gridspark.plans.fixtures import events, seconds
from gridspark.plans.registry import query, r6, table

ORDER = ["ts", "event_id"]
EVENTS_SQL = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
CRITERIA = (
    series.Criterion("settled", "drift", 5, 2e-6, "value", "scale"),
    series.Criterion("balanced", "balance", 8, 0.5, "excess", "scale"),
    series.Criterion("held", "straddle", 2, 0.6, "value", "scale", "excess"),
)


def by_data():
    return FromData()


def log(spark, sf):
    """The journal as an iteration log: loop = user, level from the payload, scale from the record."""
    return events(spark, sf).select(
        "user_id", "event_id", "ts", seconds("ts").alias("t"), "value", (F.col("value") - 20.0).alias("excess"),
        (F.col("value") + 10.0).alias("scale"), (F.col("event_id") % 3).cast("int").alias("level"))


_RECENT = f"""(SELECT user_id, t, value, value - 20.0 AS excess, value + 10.0 AS scale,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
    count(*) OVER (PARTITION BY user_id) AS records FROM {EVENTS_SQL} {{where}})"""
_STATS = """
    SELECT user_id, max(records) AS records,
           abs(regr_slope(value, t) FILTER (WHERE back <= 5)) / max(scale) FILTER (WHERE back = 1) AS drift,
           abs(avg(excess) FILTER (WHERE back <= 8)) / max(scale) FILTER (WHERE back = 1) AS balance,
           abs(max(value) FILTER (WHERE back = 1) - max(value) FILTER (WHERE back = 2)) / max(scale) FILTER (WHERE back = 1) AS width,
           abs(max(excess) FILTER (WHERE back = 1)) / max(scale) FILTER (WHERE back = 1) AS over_
    FROM {recent} GROUP BY 1"""
STATS = _STATS.format(recent=_RECENT.format(where=""))


def statistics(spark, sf):
    return series.criterion_statistics(log(spark, sf), "user_id", "t", ORDER, by_data(), CRITERIA)


@query("ser1_drift", f"SELECT user_id, round(drift * 1e6, 6) AS drift_micro FROM ({STATS})")
def ser1(spark, sf):
    out = statistics(spark, sf).filter("criterion = 'settled'")
    return out.select("user_id", r6(F.col("statistic") * 1e6).alias("drift_micro"))


@query("ser2_balance_and_straddle", f"""
    SELECT user_id, round(balance, 6) AS balance, round(width, 6) AS width, round(over_, 6) AS overshoot FROM ({STATS})""")
def ser2(spark, sf):
    s = statistics(spark, sf)
    pick = lambda name, c: F.max(F.when(F.col("criterion") == name, F.col(c)))
    return s.groupBy("user_id").agg(r6(pick("balanced", "statistic")).alias("balance"), r6(pick("held", "statistic")).alias("width"),
                                    r6(pick("held", "overshoot")).alias("overshoot"))


_VERDICT = """CASE WHEN records < 10 THEN 'Refused' WHEN drift > 2e-6 OR balance > 0.5 OR width > 0.6 OR over_ > 0.6 THEN 'Refused'
    ELSE 'Converged' END"""


@query("ser3_exit_verdict", f"""
    SELECT user_id, records, {_VERDICT} AS verdict, records >= 70 AND {_VERDICT} <> 'Converged' AS exhausted FROM ({STATS})""")
def ser3(spark, sf):
    return series.exit_verdict(statistics(spark, sf), "user_id", floor=10, cap=70)


@query("ser4_final_report", f"""
    SELECT s.user_id, records, {_VERDICT} AS verdict, records >= 70 AND {_VERDICT} <> 'Converged' AS exhausted,
           round(l.cost, 6) AS open_cost
    FROM ({_STATS.format(recent=_RECENT.format(where="WHERE event_id % 3 = 2"))}) s
    JOIN (SELECT user_id, abs(excess) / scale AS cost FROM {_RECENT.format(where="WHERE event_id % 3 = 2")} WHERE back = 1) l
      ON l.user_id = s.user_id""")
def ser4(spark, sf):
    out = series.final_report(log(spark, sf), "user_id", "t", ORDER, by_data(), CRITERIA, "level", 2, 10, 70, "excess", "scale")
    return out.withColumn("open_cost", r6(F.col("open_cost")))


def ranked(spark, sf):
    df = events(spark, sf).select("user_id", "event_id", "ts", "value")
    return series.doubled_midranks(df, ["user_id"], "value", FromData())


_RANKS = """(SELECT user_id, event_id, ts, 2 * (rank() OVER (PARTITION BY user_id ORDER BY value) - 1)
    + count(*) OVER (PARTITION BY user_id, value) + 1 AS rank2 FROM events)"""


@query("win3_doubled_midranks", f"SELECT user_id, event_id, rank2 FROM {_RANKS}")
def win3(spark, sf):
    return ranked(spark, sf).select("user_id", "event_id", "rank2")


@query("win4_successive_difference", f"""
    SELECT user_id, -sum(d * d)::BIGINT AS statistic FROM (
        SELECT user_id, coalesce(rank2 - lag(rank2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS d FROM {_RANKS})
    GROUP BY 1""")
def win4(spark, sf):
    return series.successive_difference(ranked(spark, sf), ["user_id"], "rank2", ORDER, by_data())


@query("ser5_kendall_score", f"""
    SELECT a.user_id, max(n) AS n, sum(CASE WHEN b.rank2 > a.rank2 THEN 1 WHEN b.rank2 < a.rank2 THEN -1 ELSE 0 END)::BIGINT AS score
    FROM {_RANKS} a JOIN {_RANKS} b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id)
    JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) c ON c.user_id = a.user_id GROUP BY 1""")
def ser5(spark, sf):
    return series.kendall_score(ranked(spark, sf), ["user_id"], "rank2", ORDER, by_data())


# The exact tail of a score: over a period of more points than the score has values, that no tie size divides,
# the characteristic function of the inversions gives the whole distribution.
_TREND = f"""
    WITH scores AS MATERIALIZED (
           SELECT a.user_id, sum(CASE WHEN b.rank2 > a.rank2 THEN 1 WHEN b.rank2 < a.rank2 THEN -1 ELSE 0 END)::BIGINT AS score
           FROM {_RANKS} a JOIN {_RANKS} b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) GROUP BY 1),
         sizes AS MATERIALIZED (SELECT user_id, value, count(*) AS a FROM events GROUP BY 1, 2),
         series AS MATERIALIZED (
           SELECT user_id, n, coalesce(score, 0) AS score, (pairs // 840 + 1) * 840 + 1 AS period FROM (
             SELECT user_id, sum(a)::BIGINT AS n, (sum(a) * (sum(a) - 1) / 2 - sum(a * (a - 1) / 2))::BIGINT AS pairs FROM sizes GROUP BY 1)
           LEFT JOIN scores USING (user_id)),
         factors AS MATERIALIZED (
           SELECT user_id, unnest(range(2, n + 1)) AS m, 1 AS side FROM series
           UNION ALL SELECT user_id, unnest(range(2, a + 1)), -1 FROM sizes),
         waves AS (SELECT user_id, period, score, unnest(range(1, (period - 1) // 2 + 1)) AS r FROM series),
         phi AS (
           SELECT user_id, any_value(period) AS period, any_value(score) AS score, r,
                  product(pow(sin(pi() * ((m * r) % (2 * period)) / period) / (m * sin(pi() * r / period)), side)) AS f
           FROM waves JOIN factors USING (user_id) GROUP BY user_id, r),
         tails AS (
           SELECT user_id, 2 * (any_value(edge) + 0.5 - any_value(abs(score)) / 2
                  + 2 * sum(f * (sin(2 * pi() * r * edge / period) - sin(2 * pi() * r / period * (abs(score) / 2 - 0.5))) / (2 * sin(pi() * r / period)))) / any_value(period) AS p
           FROM (SELECT *, (period - abs(score) % 2) / 2 AS edge FROM phi) GROUP BY user_id)
    SELECT user_id, n, score, CASE WHEN score = 0 THEN 1.0 ELSE round(coalesce(p, 1.0), 9) END AS p_trend,
           CASE WHEN n >= 5 THEN score <> 0 AND coalesce(p, 1.0) <= 0.05 END AS trend
    FROM series LEFT JOIN tails USING (user_id)"""


@query("ser5_trend_test", _TREND)
def ser5_trend(spark, sf):
    out = series.trend_test(events(spark, sf), ["user_id"], "value", ORDER, by_data(), FromData(), 0.05)
    return out.withColumn("p_trend", r6(F.col("p_trend"), 9))


def residuals(spark, sf):
    """Each user's events as closure residuals at strictly increasing windows."""
    return events(spark, sf).select("user_id", "event_type", seconds("ts").alias("window"),
                                    (F.col("value") - 20.0).alias("residual"), F.lit(15.0).alias("tolerance"))


@query("ser6_successive_difference_test")
def ser6(spark, sf):
    return series.successive_difference_test(residuals(spark, sf), ["user_id"], "residual", ["window"], FromData(),
                                             FromData(), 0.05, 60, seed=7)


_OFFSET = """
    WITH counts AS (
           SELECT user_id, count(*) AS n, sum(CASE WHEN value - 20 > 15 THEN 1 ELSE 0 END)::BIGINT AS above,
                  sum(CASE WHEN value - 20 < -15 THEN 1 ELSE 0 END)::BIGINT AS below, bool_and(abs(value - 20) <= 15) AS within
           FROM events GROUP BY 1),
         terms AS (SELECT user_id, n, unnest(range(greatest(above, below), n + 1)) AS j FROM counts),
         tails AS (SELECT user_id, 2 * sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))) AS p FROM terms GROUP BY 1)
    SELECT user_id, n, above, below, within, round(p, 9) AS p_offset, CASE WHEN n >= 6 THEN p <= 0.05 END AS "offset"
    FROM counts JOIN tails USING (user_id)"""


@query("ser7_offset_test", _OFFSET)
def ser7(spark, sf):
    return series.offset_test(residuals(spark, sf), ["user_id"], "residual", "tolerance", 0.05).withColumn("p_offset", r6(F.col("p_offset"), 9))


@query("ser8_classify_residuals")
def ser8(spark, sf):
    return series.classify_residuals(residuals(spark, sf), ["user_id"], "window", "residual", "tolerance",
                                     FromData(), FromData(), 0.05, 60, seed=7)


@query("ser9_signatures")
def ser9(spark, sf):
    df = residuals(spark, sf).select(F.lit("atmosphere").alias("from"), F.lit("ocean").alias("to"), F.col("event_type").alias("quantity"),
                                     F.lit("operator").alias("ledger"), F.col("user_id").alias("column"), "window", "residual", "tolerance")
    return series.classify_residuals(df, ["from", "to", "quantity", "ledger", "column"], "window", "residual", "tolerance",
                                     FromData(), FromData(), 0.1, 24, seed=3)


@query("ser10_surrogate_drift")
def ser10(spark, sf):
    return series.surrogate_drift(log(spark, sf), "user_id", "t", "value", ORDER, by_data(), 16, 49, seed=11)


def compared(spark, sf):
    """Order totals as the model against line-item sums as the observation."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("observed"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("model"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey)


_COMPARED = """(SELECT o_orderpriority, o_totalprice AS m, o FROM orders
    JOIN (SELECT l_orderkey, sum(l_extendedprice) AS o FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


@query("ser12_skill", f"""
    SELECT o_orderpriority, count(*) AS n, round(avg(m - o), 3) AS bias, round(sqrt(avg((m - o) * (m - o))), 3) AS rms,
           round(regr_slope(ln(m), ln(o)), 6) AS exponent, stddev_samp(m - o) < stddev_samp(o) AS scatter_below_observed
    FROM {_COMPARED} GROUP BY 1""")
def ser12(spark, sf):
    out = series.skill(compared(spark, sf), ["o_orderpriority"], "model", "observed")
    return out.select("o_orderpriority", "n", r6(F.col("bias"), 3).alias("bias"), r6(F.col("rms"), 3).alias("rms"),
                      r6(F.col("exponent")).alias("exponent"), "scatter_below_observed")


@query("ser12_median_log_ratio", f"SELECT o_orderpriority, round(median(abs(log10(m / o))), 6) AS median FROM {_COMPARED} GROUP BY 1")
def ser12_ratio(spark, sf):
    df = compared(spark, sf).withColumn("ratio", series.log_ratio(F.col("model"), F.col("observed")))
    return segmented_median(df, ["o_orderpriority"], "ratio").withColumn("median", r6(F.col("median")))


@query("ser12_cohens_kappa", """
    WITH d AS (SELECT quality AS a, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS b FROM documents JOIN labels USING (doc_id)),
         n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM d),
         e AS (SELECT sum(x.c * y.c) / (SELECT n * n FROM n) AS pe FROM (SELECT a AS k, count(*)::DOUBLE AS c FROM d GROUP BY 1) x
               JOIN (SELECT b AS k, count(*)::DOUBLE AS c FROM d GROUP BY 1) y USING (k))
    SELECT n, round(po, 6) AS observed, round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def ser12_kappa(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 600).cast("int").alias("b"))
    df = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("a")), "doc_id")
    return series.cohens_kappa(df, "a", "b").select("n", r6(F.col("observed")).alias("observed"), r6(F.col("kappa")).alias("kappa"))
