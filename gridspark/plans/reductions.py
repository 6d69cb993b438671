"""Reductions over the fine field."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import cells, numeric
from gridspark.operators import reduce
from gridspark.operators.ordered import FromData, numbered
from gridspark.plans.fixtures import CELL_SQL, LEGEND, ORDER, anc_sql, events, fine_field
from gridspark.plans.registry import NUDGE, query, r6, table

DEPTH = 2
ANC = anc_sql(DEPTH)


def coarse(spark, sf):
    return fine_field(spark, sf).withColumn("coarse", cells.ancestor(F.col("cell"), DEPTH))


@query("agg1_pairwise_sum", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def agg1(spark, sf):
    df = fine_field(spark, sf).select(*ORDER)
    out = reduce.ordered_sum(df, "l_extendedprice", ORDER, FromData())
    return out.select(r6(F.col("total"), 2).alias("total"))


@query("agg2_ordered_fold", f"""
    SELECT {ANC} AS coarse, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1""")
def agg2(spark, sf):
    df = coarse(spark, sf).select("coarse", *ORDER)
    out = reduce.ordered_sum(df, "l_extendedprice", ORDER, FromData(), ["coarse"])
    return out.select("coarse", r6(F.col("total"), 2).alias("total"))


@query("agg3_compensated_sum", """
    SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1""")
def agg3(spark, sf):
    df = numbered(fine_field(spark, sf).select("l_returnflag", *ORDER), ORDER,
                  FromData(), ["l_returnflag"])
    out = reduce.compensated_sum(df, "l_extendedprice", "idx", ["l_returnflag"])
    return out.select("l_returnflag", r6(F.col("total"), 2).alias("total"))


@query("agg4_segmented_sum", f"""
    SELECT {ANC} AS coarse, l_returnflag, round(sum(l_extendedprice), 2) AS total
    FROM lineitem GROUP BY 1, 2""")
def agg4(spark, sf):
    out = reduce.segmented_sum(coarse(spark, sf), ["coarse", "l_returnflag"], F.col("l_extendedprice"))
    return out.select("coarse", "l_returnflag", r6(F.col("total"), 2).alias("total"))


@query("agg5_segmented_weighted_sum", f"""
    SELECT {ANC} AS coarse, l_returnflag, round(sum(l_extendedprice * l_quantity), 2) AS total
    FROM lineitem GROUP BY 1, 2""")
def agg5(spark, sf):
    out = reduce.segmented_weighted_sum(coarse(spark, sf), ["coarse", "l_returnflag"],
                                        F.col("l_extendedprice"), F.col("l_quantity"))
    return out.select("coarse", "l_returnflag", r6(F.col("total"), 2).alias("total"))


@query("agg6_segmented_mean", f"""
    SELECT {ANC} AS coarse, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + {NUDGE}, 6) AS mean,
           sum(l_quantity) AS weight
    FROM lineitem GROUP BY 1""")
def agg6(spark, sf):
    out = reduce.segmented_mean(coarse(spark, sf), ["coarse"], F.col("l_extendedprice"), F.col("l_quantity"))
    return out.select("coarse", r6(F.col("mean") + NUDGE).alias("mean"), "weight")


_SHARES = ", ".join(
    f"round(sum(CASE WHEN l_returnflag = '{c}' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share_{c}"
    for c in LEGEND
)


@query("agg7_class_share", f"""
    WITH g AS (SELECT {ANC} AS coarse, l_returnflag AS class, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
         t AS (SELECT coarse, sum(w) AS w FROM g GROUP BY 1),
         l AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(class))
    SELECT t.coarse, l.class, round(coalesce(g.w, 0) / t.w, 6) AS share
    FROM t CROSS JOIN l LEFT JOIN g ON g.coarse = t.coarse AND g.class = l.class""")
def agg7(spark, sf):
    out = reduce.class_shares(coarse(spark, sf), ["coarse"], "l_returnflag", F.col("l_quantity"), LEGEND)
    return out.select("coarse", "class", r6(F.col("share")).alias("share"))


@query("agg7_class_share_wide", f"SELECT {ANC} AS coarse, {_SHARES} FROM lineitem GROUP BY 1")
def agg7_wide(spark, sf):
    out = reduce.class_shares_wide(coarse(spark, sf), ["coarse"], "l_returnflag", F.col("l_quantity"), LEGEND)
    return out.select("coarse", *[r6(F.col(f"share_{c}")).alias(f"share_{c}") for c in LEGEND])


@query("agg8_class_magnitude", f"""
    SELECT {ANC} AS coarse, l_returnflag AS class, round(sum(abs(l_extendedprice - 50000.0)), 2) AS amount
    FROM lineitem GROUP BY 1, 2""")
def agg8(spark, sf):
    out = reduce.class_shares(coarse(spark, sf), ["coarse"], "l_returnflag",
                              F.col("l_extendedprice") - 50000.0, LEGEND, magnitude=True)
    return out.filter(F.col("amount") > 0).select("coarse", "class", r6(F.col("amount"), 2).alias("amount"))


@query("agg9_segmented_quantile", " UNION ALL ".join(f"""
    SELECT {ANC} AS coarse, CAST({q} AS DOUBLE) AS q, quantile_disc(l_extendedprice, {q}) AS value
    FROM lineitem GROUP BY 1""" for q in (0.1, 0.5, 0.9)))
def agg9(spark, sf):
    return reduce.segmented_quantile(coarse(spark, sf), ["coarse"], "l_extendedprice", [0.1, 0.5, 0.9])


@query("agg10_area_weighted_sum", f"""
    SELECT {ANC} AS coarse, sum(CASE WHEN l_extendedprice >= 50000 THEN l_quantity ELSE 0 END) AS area_above
    FROM lineitem GROUP BY 1""")
def agg10(spark, sf):
    return reduce.area_weighted_sum(coarse(spark, sf), ["coarse"], F.col("l_extendedprice"), F.col("l_quantity"), 50000.0)


@query("agg11_area_fraction_above", " UNION ALL ".join(f"""
    SELECT {ANC} AS coarse, CAST({t} AS DOUBLE) AS threshold,
           round(sum(CASE WHEN l_extendedprice >= {t} THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS fraction
    FROM lineitem GROUP BY 1""" for t in (20000, 50000, 80000)))
def agg11(spark, sf):
    out = reduce.area_fraction_above(coarse(spark, sf), ["coarse"], F.col("l_extendedprice"), F.col("l_quantity"),
                                     [20000.0, 50000.0, 80000.0])
    return out.select("coarse", "threshold", r6(F.col("fraction")).alias("fraction"))


@query("agg12_error_bound", f"""
    SELECT {ANC} AS coarse, count(*) AS n, round(sum(abs(l_extendedprice)), 2) AS magnitude,
           round(count(*) * pow(2, -52) * sum(abs(l_extendedprice)) * 1e9, 6) AS bound_nano
    FROM lineitem GROUP BY 1""")
def agg12(spark, sf):
    out = reduce.sum_with_bound(coarse(spark, sf), ["coarse"], F.col("l_extendedprice"))
    return out.select("coarse", "n", r6(F.col("magnitude"), 2).alias("magnitude"),
                      r6(F.col("bound") * 1e9).alias("bound_nano"))


@query("agg21_pair_tally", """
    SELECT event_type AS kind, user_id AS component, count(*) AS n FROM events
    GROUP BY GROUPING SETS ((event_type, user_id), ())""")
def agg21(spark, sf):
    df = events(spark, sf).select(F.col("event_type").alias("kind"), F.col("user_id").alias("component"))
    return reduce.pair_tally(df, "kind", "component")


@query("agg23_digest_set")
def agg23(spark, sf):
    return reduce.digest_set(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("agg25_region_reduction", f"""
    WITH f AS (SELECT CAST(floor({CELL_SQL} / 5120) AS INT) AS band, l_linestatus AS surface,
                      CAST(month(l_shipdate) AS INT) AS month, l_extendedprice AS x, l_quantity AS w FROM lineitem)
    SELECT band, surface, month, CAST(grouping(band) AS INT) AS all_band,
           CAST(grouping(surface) AS INT) AS all_surface, CAST(grouping(month) AS INT) AS all_month,
           sum(w) AS weight, round(sum(x * w) / sum(w) + {NUDGE}, 6) AS mean
    FROM f GROUP BY CUBE (band, surface, month)""")
def agg25(spark, sf):
    df = fine_field(spark, sf).select(
        F.floor(F.col("cell") / 5120).cast("int").alias("band"), F.col("l_linestatus").alias("surface"),
        F.month("l_shipdate").alias("month"), "l_extendedprice", "l_quantity")
    out = reduce.region_reduction(df, ["band", "surface", "month"], F.col("l_extendedprice"), F.col("l_quantity"))
    return out.withColumn("mean", r6(F.col("mean") + NUDGE))


@query("jn10_legend_encode", """
    SELECT position, count(*) AS n FROM (
        SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
               WHEN '5-LOW' THEN 4 END AS position FROM orders) GROUP BY 1""")
def jn10(spark, sf):
    legend = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    out = reduce.legend_encode(table(spark, sf, "orders"), "o_orderpriority", legend)
    return out.groupBy("position").agg(F.count(F.lit(1)).alias("n"))


@query("jn10_outside_legend", """
    SELECT o_orderpriority, count(*) AS rows FROM orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY 1""")
def jn10_outside(spark, sf):
    return reduce.outside_legend(table(spark, sf, "orders"), "o_orderpriority",
                                 ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))


@query("top1_seeded_sample", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, draw_key FROM (
        SELECT *, sha256(concat_ws(':', '20260910', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS draw_key
        FROM lineitem) ORDER BY draw_key LIMIT 459""")
def top1(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    m = reduce.ensemble_members(100, 100)
    return reduce.seeded_sample(df, df.columns, m, 20260910)


@query("sca8_quantile_rank", f"""
    SELECT coarse, greatest(1, least(n, CAST(ceil(CAST(0.37 AS DOUBLE) * n) AS BIGINT))) AS rank FROM (
        SELECT {ANC} AS coarse, count(*) AS n FROM lineitem GROUP BY 1)""")
def sca8(spark, sf):
    n = coarse(spark, sf).groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
    return n.select("coarse", numeric.quantile_rank(F.col("n"), F.lit(0.37)).alias("rank"))
