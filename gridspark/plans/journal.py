"""Journal streams drained over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.plans.fixtures import events, seconds
from gridspark.plans.registry import NUDGE, query, r6, table
from gridspark.session import shared_dir
from gridspark.streaming import journal

KINDS = {"click": ("k",), "error": ("k",), "purchase": ("k", "amount"), "view": ("k",)}


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark, sf):
    return journal.read_files(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str1_validate_journal", """
    SELECT event_type, CASE event_type WHEN 'signup' THEN 'unknown kind' WHEN 'purchase' THEN 'missing field' END AS problem, count(*) AS n
    FROM events GROUP BY 1, 2""")
def str1(spark, sf):
    checked = journal.validate(stream(spark, sf), "event_type", "props", KINDS)
    good, bad = scratch(spark, "valid"), scratch(spark, "dead")
    journal.split_valid(checked, good, bad)
    both = spark.read.parquet(bad).select("event_type", "problem").unionByName(
        spark.read.parquet(good).select("event_type", F.lit(None).cast("string").alias("problem")))
    return both.groupBy("event_type", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("str2_journal_sink", "SELECT event_id, user_id, event_type, value, props FROM events")
def str2(spark, sf):
    out = scratch(spark, "journal")
    journal.run(stream(spark, sf).select("event_id", "user_id", "event_type", "value", "props"), out)
    return spark.read.parquet(out)


@query("str3_interval_windows", f"""
    SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts))::DOUBLE / 1e6 AS t0, event_type, round(avg(value) + {NUDGE}, 6) AS mean,
           round(sum(value), 4) AS total, max_by(value, ts) AS endpoint, count(*) AS n FROM events GROUP BY 1, 2""")
def str3(spark, sf):
    df = journal.windowed(stream(spark, sf), "ts", "6 hours", ["event_type"], "value")
    out = journal.keep_latest(df, scratch(spark, "windows"), ["t0", "t1", "event_type"])
    return out.select(seconds("t0").alias("t0"), "event_type", r6(F.col("mean") + NUDGE).alias("mean"), r6(F.col("total"), 4).alias("total"), "endpoint", "n")


@query("str4_exit_predicate", """
    WITH r AS (SELECT user_id, value - 20.0 AS x, value + 10.0 AS s, epoch_us(ts) / 1e6 AS t,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    a AS (SELECT user_id AS loop, max(n) AS records, abs(regr_slope(x, t)) / max(s) FILTER (WHERE back = 1) AS drift,
                 abs(avg(x)) / max(s) FILTER (WHERE back = 1) AS balance FROM r WHERE back <= 8 GROUP BY 1)
    SELECT loop, records, round(balance, 6) AS balance, CASE WHEN records >= 10 AND drift <= 2e-6 AND balance <= 0.5 THEN 'Converged' ELSE 'Refused' END AS verdict
    FROM a""")
def str4(spark, sf):
    df = stream(spark, sf).select("user_id", seconds("ts").alias("t"), (F.col("value") - 20.0).alias("x"), (F.col("value") + 10.0).alias("s"))
    out = journal.keep_latest(journal.exit_verdicts(df, "user_id", "t", "x", "s", 8, 10, 2e-6, 0.5), scratch(spark, "verdicts"), ["loop"])
    return out.select("loop", "records", r6(F.col("balance")).alias("balance"), "verdict")


@query("str5_one_write_per_step", """
    SELECT user_id, count(DISTINCT date_trunc('hour', ts)) AS accepted, count(*) - count(DISTINCT date_trunc('hour', ts)) AS refused FROM events GROUP BY 1""")
def str5(spark, sf):
    keyed = stream(spark, sf).select("event_id", "user_id", "ts", F.date_trunc("hour", "ts").alias("step"))
    out = scratch(spark, "writes")
    journal.run(journal.first_writes(keyed, "ts", ["user_id", "step"], "40 days"), out)
    accepted = spark.read.parquet(out)
    refused = journal.refused_writes(events(spark, sf).select("event_id", "user_id"), accepted, "event_id")
    tally = accepted.select("user_id", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(refused.select("user_id", F.lit(0).alias("a"), F.lit(1).alias("r")))
    return tally.groupBy("user_id").agg(F.sum("a").alias("accepted"), F.sum("r").alias("refused"))


def arrivals(spark, sf):
    """A stream over the events that grows by one kind of event at a time, in order of name; yields after each arrival."""
    inbox, rows = scratch(spark, "inbox"), table(spark, sf, "events")
    for (kind,) in rows.select("event_type").distinct().orderBy("event_type").collect():
        rows.filter(F.col("event_type").eqNullSafe(kind)).write.mode("append").parquet(inbox)
        yield journal.read_files(spark, inbox, "*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_ARRIVALS = """k AS (SELECT *, dense_rank() OVER (ORDER BY event_type NULLS FIRST) AS b FROM events),
    m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {} DAY AS mark FROM k GROUP BY b)"""


@query("str3_late_rows", f"""
    WITH {_ARRIVALS.format(10)}, w AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS t FROM k JOIN m USING (b))
    SELECT epoch_us(t)::DOUBLE / 1e6 AS t0, event_type, CASE WHEN t + INTERVAL 6 HOURS <= mark THEN 'late' ELSE 'on time' END AS status,
           round(sum(value), 4) AS total, count(*) AS n FROM w GROUP BY ALL""")
def str3_late(spark, sf):
    path = scratch(spark, "late-windows")
    for s in arrivals(spark, sf):
        windows, late = journal.windowed_with_late(s, path, "ts", "6 hours", ["event_type"], "value", "10 days")
    gone = late.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    both = windows.select("t0", "event_type", F.lit("on time").alias("status"), "total", "n").unionByName(
        gone.select(F.col("w.start").alias("t0"), "event_type", F.lit("late").alias("status"), "total", "n"))
    return both.withColumn("t0", seconds("t0")).withColumn("total", r6(F.col("total"), 4))


@query("str5_late_writes", f"""
    WITH {_ARRIVALS.format(10)}, r AS (SELECT *, coalesce(ts <= mark, false) AS late, date_trunc('day', ts) AS step FROM k JOIN m USING (b)),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, step, late ORDER BY b, ts, event_id) AS place FROM r)
    SELECT user_id, CASE WHEN late THEN 'late' WHEN place = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome, count(*) AS n FROM o GROUP BY ALL""")
def str5_late(spark, sf):
    path = scratch(spark, "late-writes")
    for s in arrivals(spark, sf):
        keyed = s.select("event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("step"))
        out = journal.first_writes_with_late(keyed, path, "ts", ["user_id", "step"], "event_id", "10 days")
    return out.groupBy("user_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("str6_exactly_once_reduction", """
    SELECT user_id, round(sum(value), 4) AS sum, count(*) AS cnt FROM events GROUP BY 1""")
def str6(spark, sf):
    out = journal.reduce_once(stream(spark, sf), scratch(spark, "reduced"), "event_id", ["user_id"], F.col("value"))
    return out.withColumn("sum", r6(F.col("sum"), 4))


@query("str7_skip_recorded", """
    SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')""")
def str7(spark, sf):
    recorded = events(spark, sf).filter("event_type = 'view'")
    out = scratch(spark, "unrecorded")
    journal.run(journal.unrecorded(stream(spark, sf).select("event_id"), recorded, "event_id"), out)
    return spark.read.parquet(out)


@query("str8_emitted_events")
def str8(spark, sf):
    """Topology edits of two terrain snapshots, emitted as journal rows and validated on the way in."""
    from gridspark.plans.grids import DEPTH, edits, level_of

    rows = journal.topology_events(edits(spark, sf), 0.0, level_of(spark, sf) - DEPTH)
    return journal.validate(rows).groupBy("kind", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("str9_running_tally", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str9(spark, sf):
    df = journal.pair_tally(stream(spark, sf), "user_id", "event_type")
    return journal.keep_latest(df, scratch(spark, "tally"), ["user_id", "event_type"])
