"""Roll-up, drill-down, time reduction, ledgers and vectors over the fine field."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.contracts import Refusal, declare
from gridspark.functions import cells, numeric
from gridspark.operators import fields
from gridspark.plans.fixtures import (
    CELL_SQL,
    CELL_TABLE_SQL,
    LEGEND,
    SERIES_SQL,
    anc_sql,
    cell_table,
    events,
    fine_field,
    interval_series,
)
from gridspark.plans.registry import NUDGE, query, r6, table
from gridspark.session import settled, shared_dir

DEPTH = 2
ANC = anc_sql(DEPTH)
SUPPORT = {"support_id": "level5"}


def declared(spark, sf, semantics, column="l_extendedprice"):
    return declare(fine_field(spark, sf), column, semantics=semantics, **SUPPORT)


@query("fld1_coarsen_extensive", f"""
    SELECT {ANC} AS coarse, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice
    FROM lineitem GROUP BY 1, 2""")
def fld1(spark, sf):
    out = fields.coarsen(declared(spark, sf, "Extensive"), "l_extendedprice", DEPTH, dims=["l_linestatus"])
    return out.field.withColumn("l_extendedprice", r6(F.col("l_extendedprice"), 2))


@query("fld2_coarsen_area_mean", f"""
    WITH m AS (SELECT {ANC} AS coarse, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean,
                      sum(l_quantity) AS weight FROM lineitem GROUP BY 1)
    SELECT 'cell' AS kind, coarse, round(mean + {NUDGE}, 6) AS mean, weight, CAST(NULL AS BOOLEAN) AS closed FROM m
    UNION ALL
    SELECT 'ledger', NULL, NULL, sum(weight),
           abs(sum(mean * weight) - (SELECT sum(l_extendedprice * l_quantity) FROM lineitem))
           <= (SELECT count(*) * pow(2, -52) * sum(abs(l_extendedprice * l_quantity)) FROM lineitem) FROM m""")
def fld2(spark, sf):
    out = fields.coarsen(declared(spark, sf, "Intensive"), "l_extendedprice", DEPTH, measure="l_quantity", rule="area_mean")
    cell = out.field.select(F.lit("cell").alias("kind"), "coarse", r6(F.col("l_extendedprice") + NUDGE).alias("mean"),
                            F.col("l_quantity").alias("weight"), F.lit(None).cast("boolean").alias("closed"))
    weights = fine_field(spark, sf).agg(F.sum("l_quantity"))
    total = out.ledger.withColumn("weight", weights.scalar()).select(F.lit("ledger").alias("kind"), F.lit(None).cast("bigint").alias("coarse"),
                       F.lit(None).cast("double").alias("mean"), "weight", "closed")
    return cell.unionByName(total)


@query("fld3_coarsen_quantiles", f"""
    SELECT {ANC} AS coarse, quantile_disc(l_extendedprice, 0.0) AS p0, quantile_disc(l_extendedprice, 0.5) AS p1,
           quantile_disc(l_extendedprice, 1.0) AS p2 FROM lineitem GROUP BY 1""")
def fld3(spark, sf):
    return fields.coarsen(declared(spark, sf, "Intensive"), "l_extendedprice", DEPTH, rule="quantiles",
                          probabilities=[0.0, 0.5, 1.0]).field


@query("fld4_coarsen_label", f"""
    WITH g AS (SELECT {ANC} AS coarse, l_returnflag AS class, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
         t AS (SELECT coarse, sum(w) AS w FROM g GROUP BY 1),
         l AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(class))
    SELECT t.coarse, l.class, coalesce(g.w, 0) AS amount, round(coalesce(g.w, 0) / t.w, 6) AS share
    FROM t CROSS JOIN l LEFT JOIN g ON g.coarse = t.coarse AND g.class = l.class""")
def fld4(spark, sf):
    df = declared(spark, sf, "CategoricalLabel", "l_returnflag")
    out = fields.coarsen(df, "l_returnflag", DEPTH, measure="l_quantity", legend=LEGEND)
    return out.field.withColumn("share", r6(F.col("share")))


_FRACTIONS_SQL = f"""
    WITH f AS (SELECT {CELL_SQL} AS cell, l_returnflag AS class, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2),
         t AS (SELECT cell, sum(amount) AS area FROM f GROUP BY 1)"""


def cell_fractions(spark, sf):
    df = fine_field(spark, sf)
    shares = fields.coarsen_label(df, "l_returnflag", "l_quantity", 0, LEGEND).field
    area = df.groupBy("cell").agg(F.sum("l_quantity").alias("area"))
    return shares.withColumnRenamed("coarse", "cell").join(area, "cell")


@query("fld5_coarsen_fraction", f"""{_FRACTIONS_SQL}
    SELECT (t.cell - 1) // 16 + 1 AS coarse, l.class,
           round(sum(coalesce(f.amount, 0) / t.area * t.area) / sum(t.area) + {NUDGE}, 6) AS share
    FROM t CROSS JOIN (VALUES ('A'), ('N'), ('R')) l(class)
    LEFT JOIN f ON f.cell = t.cell AND f.class = l.class GROUP BY 1, 2""")
def fld5(spark, sf):
    df = declare(cell_fractions(spark, sf), "share", semantics="CategoricalFraction", **SUPPORT)
    out = fields.coarsen(df, "share", DEPTH, measure="area")
    return out.field.select("coarse", "class", r6(F.col("share") + NUDGE).alias("share"))


def coarse_table(spark, sf):
    """One row per coarse cell: the amount to drill down."""
    return (fine_field(spark, sf).groupBy(cells.ancestor(F.col("cell"), DEPTH).alias("cell"))
            .agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("area")))


@query("fld6_refine_extensive", f"""
    WITH f AS ({CELL_TABLE_SQL}),
         c AS (SELECT (cell - 1) // 16 + 1 AS anc, sum(value) AS value, sum(weight) AS w FROM f GROUP BY 1)
    SELECT f.cell, round(c.value * (f.weight / c.w) + 0.0000033, 4) AS value
    FROM f JOIN c ON c.anc = (f.cell - 1) // 16 + 1""")
def fld6(spark, sf):
    coarse = declare(coarse_table(spark, sf), "value", semantics="Extensive", **SUPPORT)
    out = fields.refine(coarse, "value", cell_table(spark, sf), DEPTH, measure="weight")
    # moved off exact decimal ties, which the two engines round differently
    return out.field.withColumn("value", r6(F.col("value") + 0.0000033, 4))


@query("fld7_refine_flux_density", f"""
    WITH f AS ({CELL_TABLE_SQL}),
         c AS (SELECT (cell - 1) // 16 + 1 AS anc, sum(value) / sum(weight) AS value FROM f GROUP BY 1)
    SELECT f.cell, round(c.value + {NUDGE}, 6) AS value, f.weight FROM f JOIN c ON c.anc = (f.cell - 1) // 16 + 1""")
def fld7(spark, sf):
    coarse = coarse_table(spark, sf).withColumn("value", F.col("value") / F.col("area"))
    coarse = declare(coarse, "value", semantics="FluxDensity", **SUPPORT)
    out = fields.refine(coarse, "value", cell_table(spark, sf), DEPTH, measure="weight", coarse_measure="area")
    return out.field.withColumn("value", r6(F.col("value") + NUDGE))


@query("fld10_masked_mean", f"""
    SELECT {ANC} AS coarse, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + {NUDGE}, 6) AS l_extendedprice,
           sum(l_quantity) AS l_quantity FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def fld10(spark, sf):
    out = fields.coarsen(declared(spark, sf, "Intensive"), "l_extendedprice", DEPTH, measure="l_quantity",
                         rule="masked_mean", mask=F.col("l_linestatus") == "O")
    return out.field.withColumn("l_extendedprice", r6(F.col("l_extendedprice") + NUDGE))


@query("jn1_spread", """
    SELECT (c.cell - 1) * 16 + g.k AS cell, c.n FROM (
        SELECT (l_orderkey % 20480) + 1 AS cell, count(*) AS n FROM lineitem GROUP BY 1) c
    CROSS JOIN (SELECT unnest(generate_series(1, 16)) AS k) g""")
def jn1(spark, sf):
    coarse = fine_field(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return fields.spread(coarse, 2)


@query("win9_share_within_ancestor", f"""
    WITH f AS ({CELL_TABLE_SQL})
    SELECT cell, round(weight / sum(weight) OVER (PARTITION BY (cell - 1) // 16), 6) AS share FROM f""")
def win9(spark, sf):
    out = fields.share_within_ancestor(cell_table(spark, sf), "weight", DEPTH)
    return out.select("cell", r6(F.col("share")).alias("share"))


def series(spark, sf, time_semantics):
    return declare(interval_series(spark, sf), "value", semantics="Intensive", time_semantics=time_semantics)


@query("tim1_interval_mean", f"""
    SELECT cell, round(sum(value * (t1 - t0)) / sum(t1 - t0), 6) AS value, round(sum(t1 - t0), 3) AS duration
    FROM ({SERIES_SQL}) GROUP BY 1""")
def tim1(spark, sf):
    out = fields.time_reduce(series(spark, sf, "IntervalMean"), "value")
    return out.select("cell", r6(F.col("value")).alias("value"), r6(F.col("duration"), 3).alias("duration"))


@query("tim2_interval_accumulation", f"SELECT cell, round(sum(value), 4) AS value FROM ({SERIES_SQL}) GROUP BY 1")
def tim2(spark, sf):
    out = fields.time_reduce(series(spark, sf, "IntervalAccumulation"), "value")
    return out.withColumn("value", r6(F.col("value"), 4))


@query("tim3_endpoint_state", f"SELECT cell, max_by(value, t1) AS value FROM ({SERIES_SQL}) GROUP BY 1")
def tim3(spark, sf):
    return fields.time_reduce(series(spark, sf, "EndpointState"), "value")


@query("jn4_combine", """
    SELECT l.k AS cell, round(l.v - o.v, 2) AS value
    FROM (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) l
    JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) o ON l.k = o.k""")
def jn4(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum("l_extendedprice").alias("value"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("value"))
    a, b = (declare(d, "value", semantics="Extensive", **SUPPORT) for d in (a, b))
    out = fields.combine(a, b, "value", -1)
    return out.withColumn("value", r6(F.col("value"), 2))


@query("jn4_unmatched_cells", """
    SELECT k AS cell, CASE WHEN l IS NULL THEN 'right' ELSE 'left' END AS side FROM (
        SELECT coalesce(a.k, b.k) AS k, a.k AS l, b.k AS r
        FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) a
        FULL JOIN (SELECT o_orderkey AS k FROM orders) b ON a.k = b.k) WHERE l IS NULL OR r IS NULL""")
def jn4_unmatched(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell")).distinct()
    return fields.unmatched(a, table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell")))


@query("jn5_reconcile", """
    SELECT status, count(*) AS cells, round(sum(sent), 2) AS sent, round(sum(received), 2) AS received FROM (
        SELECT s.v AS sent, r.v AS received,
               CASE WHEN s.k IS NULL THEN 'unsent' WHEN r.k IS NULL THEN 'lost'
                    WHEN abs(s.v - r.v) <= 20000 THEN 'equal' ELSE 'differs' END AS status
        FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) s
        FULL JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) r ON s.k = r.k)
    GROUP BY 1""")
def jn5(spark, sf):
    sent = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("v"))
    got = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum("l_extendedprice").alias("v"))
    out = fields.reconcile(sent, got, "v", tolerance=20000.0)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("cells"), r6(F.sum("sent"), 2).alias("sent"),
                                     r6(F.sum("received"), 2).alias("received"))


@query("led1_ledger", """
    SELECT 'value' AS quantity, l_returnflag, round(after_ - before_ - flux + tax, 2) AS residual,
           abs(after_ - before_ - flux + tax) <= n * pow(2, -52) * mag AS closed, round(tax, 2) AS lost_tax
    FROM (SELECT l_returnflag, sum(l_extendedprice) AS before_, sum(l_extendedprice * (1 - l_tax)) AS after_,
                 0.0 AS flux, sum(l_extendedprice * l_tax) AS tax, count(*) AS n, sum(l_extendedprice) AS mag
          FROM lineitem GROUP BY 1)""")
def led1(spark, sf):
    p, t = F.col("l_extendedprice"), F.col("l_tax")
    totals = fine_field(spark, sf).groupBy("l_returnflag").agg(
        F.sum(p).alias("before"), F.sum(p * (1 - t)).alias("after"), F.lit(0.0).alias("flux"),
        F.sum(p * t).alias("tax"), F.count(p).alias("n"), F.sum(F.abs(p)).alias("magnitude"))
    out = fields.ledger(totals, "value", ["l_returnflag"], losses={"tax": "tax"}, reservoir=True)
    return out.select("quantity", "l_returnflag", F.abs(r6(F.col("residual"), 2)).alias("residual"), "closed",
                      r6(F.element_at("losses", "tax"), 2).alias("lost_tax"))


def ledger_rows(rows, *keys):
    return rows.select("quantity", *keys, F.abs(r6(F.col("residual"), 1)).alias("residual"),
                       r6(F.col("tolerance"), 8).alias("tolerance"), "closed")


@query("led2_total_ledger", """
    SELECT 'total' AS quantity, l_linestatus, 0.0::DOUBLE AS residual,
           round(count(*) * pow(2, -52) * sum(l_extendedprice), 8) AS tolerance, true AS closed
    FROM lineitem GROUP BY 2""")
def led2(spark, sf):
    out = fields.coarsen(declared(spark, sf, "Extensive"), "l_extendedprice", DEPTH, dims=["l_linestatus"], reservoir=True)
    return ledger_rows(out.ledger, "l_linestatus")


@query("led3_integral_ledger", """
    SELECT 'primal_cell_area_integral' AS quantity, 0.0::DOUBLE AS residual,
           round(count(*) * pow(2, -52) * sum(l_extendedprice * l_quantity), 3) AS tolerance, true AS closed
    FROM lineitem""")
def led3(spark, sf):
    out = fields.coarsen(declared(spark, sf, "FluxDensity"), "l_extendedprice", DEPTH, measure="l_quantity")
    return ledger_rows(out.ledger).withColumn("tolerance", r6(F.col("tolerance"), 3))


@query("led4_class_ledger", """
    SELECT 'primal_cell_area_integral' AS quantity, l_returnflag AS class, 0.0::DOUBLE AS residual,
           round(count(*) * pow(2, -52) * sum(l_quantity), 8) AS tolerance, true AS closed
    FROM lineitem GROUP BY 2""")
def led4(spark, sf):
    df = declared(spark, sf, "CategoricalLabel", "l_returnflag")
    out = fields.coarsen(df, "l_returnflag", DEPTH, measure="l_quantity", legend=LEGEND)
    return ledger_rows(out.ledger, "class")


def crossing_ledgers(spark, sf):
    """Fine amounts rolled up, handed over, and held by a reader that drops line status F."""
    fine = declared(spark, sf, "Extensive")
    sent = fields.coarsen(fine, "l_extendedprice", DEPTH).field
    held = fields.coarsen(fine.filter("l_linestatus = 'O'"), "l_extendedprice", DEPTH).field
    good = fields.exchange_ledgers(fine, sent, sent, "l_extendedprice", "price", ["energy", "water"])
    bad = fields.exchange_ledgers(fine, sent, held, "l_extendedprice", "open_price", ["water"])
    return good.unionByName(bad)


_LED5 = """
    SELECT * FROM (VALUES ('price', 'operator', 0.0::DOUBLE, true), ('price', 'receipt', 0.0, true),
        ('open_price', 'operator', 0.0, true)) v(crossing, kind, residual, closed)
    UNION ALL
    SELECT 'open_price', 'receipt', round(-sum(l_extendedprice), 1), false FROM lineitem WHERE l_linestatus = 'F'"""


@query("led5_exchange", _LED5)
def led5(spark, sf):
    return crossing_ledgers(spark, sf).select(
        "crossing", "kind", F.when(F.col("closed"), F.lit(0.0)).otherwise(r6(F.col("residual"), 1)).alias("residual"), "closed")


@query("led5_open_events", """
    SELECT 'open_price receipt total' AS ledger, round(-sum(l_extendedprice), 1) AS imbalance, 'fine -> coarse' AS exchange,
           'surface' AS tier, 7 AS sequence FROM lineitem WHERE l_linestatus = 'F'""")
def led5_events(spark, sf):
    """Two quantities cross, and the reader loses line status F of one: the journal holds that ledger alone."""
    fine = declared(spark, sf, "Extensive")
    sent = settled(fields.coarsen(fine, "l_extendedprice", DEPTH).field)
    short = settled(fields.coarsen(fine.filter("l_linestatus = 'O'"), "l_extendedprice", DEPTH).field)
    journal = f"{shared_dir(spark)}/gridspark/{uuid.uuid4().hex}"
    crossings = [fields.Crossing(q, "l_extendedprice", fine, sent, ["water"]) for q in ("price", "open_price")]
    try:
        fields.exchange(crossings, "fine -> coarse", lambda q, df: short if q == "open_price" else df, journal, 7, 60.0, "surface")
    except Refusal:
        pass
    event = spark.read.parquet(journal)
    of = lambda k: F.get_json_object("payload", f"$.{k}")
    return event.select(of("ledger").alias("ledger"), r6(of("imbalance").cast("double"), 1).alias("imbalance"), of("exchange").alias("exchange"),
                        "tier", F.col("sequence").cast("int").alias("sequence"))


@query("led6_conserved_ledgers", """
    SELECT * FROM (VALUES ('price', 'operator'), ('price', 'receipt')) v(crossing, kind)""")
def led6(spark, sf):
    return fields.conserved_ledgers(crossing_ledgers(spark, sf), "energy").select("crossing", "kind")


_LATLON = """radians(CAST(l_suppkey % 181 - 90 AS DOUBLE)) AS lat, radians(CAST(l_partkey % 360 - 180 AS DOUBLE)) AS lon"""


def vectors(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_discount", "l_tax",
        F.radians((F.col("l_suppkey") % 181 - 90).cast("double")).alias("lat"),
        F.radians((F.col("l_partkey") % 360 - 180).cast("double")).alias("lon"))


@query("vec1_lift", f"""
    SELECT l_suppkey, round(sum(e * -sin(lon) + n * -sin(lat) * cos(lon)), 6) AS x,
           round(sum(e * cos(lon) + n * -sin(lat) * sin(lon)), 6) AS y, round(sum(n * cos(lat)), 6) AS z
    FROM (SELECT l_suppkey, l_discount AS e, l_tax AS n, {_LATLON} FROM lineitem) GROUP BY 1""")
def vec1(spark, sf):
    out = fields.lift_columns(vectors(spark, sf), "l_discount", "l_tax", "lat", "lon")
    return out.groupBy("l_suppkey").agg(*[r6(F.sum(c)).alias(c) for c in "xyz"])


@query("vec1_round_trip", """
    SELECT count(*) AS n, round(max(abs(l_discount) + abs(l_tax)), 6) AS largest, true AS lossless FROM lineitem""")
def vec1_round_trip(spark, sf):
    out = fields.round_trip(vectors(spark, sf), "l_discount", "l_tax", "lat", "lon")
    return out.select("n", r6(F.col("largest")).alias("largest"), "lossless")


@query("vec2_east_north_frame", f"""
    SELECT l_suppkey, round(sum(-sin(lon)), 6) AS ex, round(sum(cos(lon)), 6) AS ey,
           round(sum(-sin(lat) * cos(lon)), 6) AS nx, round(sum(-sin(lat) * sin(lon)), 6) AS ny,
           round(sum(cos(lat)), 6) AS nz
    FROM (SELECT l_suppkey, {_LATLON} FROM lineitem) GROUP BY 1""")
def vec2(spark, sf):
    (ex, ey, _), (nx, ny, nz) = numeric.east_north_frame(F.col("lat"), F.col("lon"))
    return vectors(spark, sf).groupBy("l_suppkey").agg(
        *[r6(F.sum(c)).alias(n) for n, c in (("ex", ex), ("ey", ey), ("nx", nx), ("ny", ny), ("nz", nz))])


@query("ser11_divergence", """
    SELECT round(sum(abs(l.v - o.v)), 2) AS divergence, count(*) AS sites
    FROM (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) l
    JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) o ON l.k = o.k""")
def ser11(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum("l_extendedprice").alias("a"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("b"))
    return a.join(b, "cell").agg(r6(F.sum(F.abs(F.col("a") - F.col("b"))), 2).alias("divergence"),
                                 F.count(F.lit(1)).alias("sites"))


# cells below a threshold of value are "wet": the coarse share that is, per band of bodies
@query("prj8_class_by_sign", f"""
    SELECT {ANC} AS coarse, sum(CASE WHEN l_extendedprice - 50000 < 0 THEN 1 ELSE 0 END)::BIGINT AS ocean,
           sum(CASE WHEN l_extendedprice - 50000 < 0 THEN 0 ELSE 1 END)::BIGINT AS land FROM lineitem GROUP BY 1""")
def prj8(spark, sf):
    from gridspark.operators.graph import class_by_sign

    df = fine_field(spark, sf).withColumn("class", class_by_sign(F.col("l_extendedprice") - 50000.0, 0.0))
    return df.groupBy(cells.ancestor(F.col("cell"), DEPTH).alias("coarse")).agg(
        F.sum((F.col("class") == "ocean").cast("bigint")).alias("ocean"),
        F.sum((F.col("class") == "land").cast("bigint")).alias("land"))


@query("win6_value_at_step_start", """
    SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lagged FROM events""")
def win6(spark, sf):
    from gridspark.operators.intervals import value_at_step_start
    from gridspark.operators.ordered import FromData

    out = value_at_step_start(events(spark, sf), "value", ["ts", "event_id"], FromData(), ["user_id"])
    return out.select("event_id", "lagged")
