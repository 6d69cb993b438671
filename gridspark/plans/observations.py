"""Observation recipes with line items as readings, orders as granules, suppliers and parts as sites."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.operators import observations as obs
from gridspark.plans.fixtures import events
from gridspark.plans.registry import NUDGE, query, r6, table
from gridspark.session import shared_dir


def readings(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.floor(F.col("l_extendedprice") / 3).cast("int").alias("raw"), F.col("l_linenumber").alias("qa"),
        F.round(F.col("l_tax") * 100).cast("int").alias("snow"), F.month("l_shipdate").alias("month"),
        F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("day"), "l_linestatus", "l_returnflag", "l_suppkey",
        (F.col("l_partkey") % 20).alias("row"), (F.col("l_suppkey") % 20).alias("col"))


READ = """(SELECT CAST(floor(l_extendedprice / 3) AS INT) AS raw, l_linenumber AS qa, CAST(round(l_tax * 100) AS INT) AS snow,
      CAST(month(l_shipdate) AS INT) AS month, CAST(year(l_shipdate) AS INT) AS year, CAST(l_shipdate AS DATE) AS day, l_linestatus, l_returnflag, l_suppkey,
      l_partkey % 20 AS row, l_suppkey % 20 AS col FROM lineitem)"""
MASKED = f"""(SELECT *, raw * 0.001::DOUBLE AS value FROM (
      SELECT 'all' AS variant, * FROM {READ} WHERE qa <= 5 UNION ALL
      SELECT 'snowfree', * FROM {READ} WHERE qa <= 3 AND snow = 0) WHERE qa <> 7 AND raw BETWEEN 0 AND 32766)"""
KEYS = ["variant", "month", "row", "col"]
ACC = f"(SELECT variant, month, row, col, sum(value) AS sum, count(*) AS cnt FROM {MASKED} GROUP BY ALL)"


def masked(spark, sf):
    return obs.mask_observations(readings(spark, sf), "raw", "qa", "snow", qa_fill=7, qa_all=5, qa_snowfree=3)


def accumulators(spark, sf):
    return obs.monthly_accumulate(masked(spark, sf), KEYS)


@query("prj1_mask_observations", f"SELECT variant, count(*) AS n, round(sum(value), 3) AS total FROM {MASKED} GROUP BY 1")
def prj1(spark, sf):
    return masked(spark, sf).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 3).alias("total"))


@query("agg14_monthly_accumulate", f"SELECT variant, month, row, col, round(sum, 3) AS sum, cnt FROM {ACC}")
def agg14(spark, sf):
    return accumulators(spark, sf).withColumn("sum", r6(F.col("sum"), 3))


@query("agg13_block_mean_sums", f"""
    SELECT month, row // 5 AS block_row, col // 5 AS block_col,
           round(sum(CASE WHEN raw <= 32766 THEN raw * 0.001::DOUBLE ELSE 0 END), 3) AS sum,
           sum(CASE WHEN raw <= 32766 THEN 1 ELSE 0 END)::BIGINT AS cnt FROM {READ} GROUP BY ALL""")
def agg13(spark, sf):
    df = readings(spark, sf).withColumn("value", F.col("raw") * 0.001)
    out = obs.block_sums(df, ["month"], "row", "col", "value", F.col("raw") <= 32766)
    return out.withColumn("sum", r6(F.col("sum"), 3))


@query("agg15_climatology", f"SELECT variant, month, row, col, cnt, round(sum / cnt + {NUDGE}, 6) AS mean FROM {ACC}")
def agg15(spark, sf):
    return obs.climatology(accumulators(spark, sf)).select(*KEYS, "cnt", r6(F.col("mean") + NUDGE).alias("mean"))


@query("agg16_count_ceiling", f"""
    SELECT variant, a.month, count(*) AS cells, max(cnt) AS largest, max(n) AS ceiling FROM {ACC} a
    JOIN (SELECT CAST(month(l_shipdate) AS INT) AS month, count(DISTINCT year(l_shipdate)) AS n FROM lineitem GROUP BY 1) g
    ON a.month = g.month WHERE cnt > n GROUP BY ALL""")
def agg16(spark, sf):
    granules = readings(spark, sf).groupBy("month").agg(F.countDistinct("year").alias("n"))
    return obs.over_ceiling(accumulators(spark, sf), granules, ["variant", "month"])


@query("agg17_retract", f"""
    SELECT a.variant, a.month, a.row, a.col, a.cnt - coalesce(d.cnt, 0) AS cnt, false AS refused,
           CASE WHEN a.cnt = coalesce(d.cnt, 0) THEN 0.0::DOUBLE ELSE round(a.sum - coalesce(d.sum, 0), 3) END AS sum
    FROM {ACC} a LEFT JOIN (SELECT variant, month, row, col, sum(value) AS sum, count(*) AS cnt FROM {MASKED}
         WHERE l_linestatus = 'F' GROUP BY ALL) d USING (variant, month, row, col)""")
def agg17(spark, sf):
    delta = obs.monthly_accumulate(masked(spark, sf).filter("l_linestatus = 'F'"), KEYS)
    return obs.retract(accumulators(spark, sf), delta, KEYS).withColumn("sum", r6(F.col("sum"), 3))


@query("agg18_modal_class", f"""
    WITH c AS (SELECT row, col, l_returnflag, count(*) AS n FROM {READ} GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, l_returnflag) AS r,
                      sum(n) OVER (PARTITION BY row, col) AS valid FROM c)
    SELECT row, col, l_returnflag AS modal, valid::BIGINT AS valid FROM k WHERE r = 1""")
def agg18(spark, sf):
    return obs.modal_class(readings(spark, sf), ["row", "col"], "l_returnflag")


@query("agg19_qa_histogram", f"""
    SELECT CAST(day AS VARCHAR) AS day, {', '.join(f"sum(CASE WHEN qa = {c} THEN 1 ELSE 0 END)::BIGINT AS qa_{c}" for c in range(1, 7))},
           round(avg(CASE WHEN snow = 0 THEN 1.0 ELSE 0.0 END), 6) AS snow_zero_frac FROM {READ} GROUP BY 1""")
def agg19(spark, sf):
    out = obs.qa_histogram(readings(spark, sf), "day", "qa", "snow", 7, range(1, 7))
    return out.withColumn("day", F.col("day").cast("string")).withColumn("snow_zero_frac", r6(F.col("snow_zero_frac")))


_SITE = """
    SELECT l_suppkey, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last,
           round(avg(l_extendedprice) + 0.0000033, 4) AS mean, round(median(l_extendedprice) + 0.0003, 3) AS median, round({sd}(l_extendedprice), 4) AS sd,
           round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS frac_good,
           sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS n_a,
           sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS n_n FROM lineitem GROUP BY 1"""


def _site(spark, sf, ddof):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", F.to_date("l_shipdate").cast("string").alias("day"),
                                             "l_linestatus", "l_returnflag")
    out = obs.site_statistics(df, "l_suppkey", "l_extendedprice", "day", F.col("l_linestatus") == "O", "l_returnflag", ddof)
    by = lambda c: F.coalesce(F.element_at("n_by_datum", c), F.lit(0))
    return out.select("l_suppkey", "n", "first", "last", r6(F.col("mean") + 0.0000033, 4).alias("mean"),
                      r6(F.col("median") + 0.0003, 3).alias("median"),
                      r6(F.col("sd"), 4).alias("sd"), r6(F.col("frac_good")).alias("frac_good"),
                      by("A").alias("n_a"), by("N").alias("n_n"))


@query("agg20_site_statistics_sample", _SITE.format(sd="stddev_samp"))
def agg20_sample(spark, sf):
    return _site(spark, sf, 1)


@query("agg20_site_statistics_population", _SITE.format(sd="stddev_pop"))
def agg20_population(spark, sf):
    return _site(spark, sf, 0)


@query("prj2_normalise_datum", """
    SELECT l_suppkey, round(sum(CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'N' THEN l_quantity * 100 - l_extendedprice
           ELSE l_extendedprice - (l_quantity * 101 - l_quantity * 100) END), 2) AS depth FROM lineitem GROUP BY 1""")
def prj2(spark, sf):
    code = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "DTW", "N", "RSWL", "R", "SWL")]), F.col("l_returnflag"))
    depth = obs.normalise_datum(F.col("l_extendedprice"), code, F.col("l_quantity") * 100, F.col("l_quantity") * 101)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(F.sum(depth), 2).alias("depth"))


@query("prj3_sanity_window", """
    SELECT l_returnflag, count(*) AS raw, sum(CASE WHEN l_extendedprice > 2000 AND l_extendedprice < 90000 THEN 1 ELSE 0 END)::BIGINT AS usable
    FROM lineitem GROUP BY 1""")
def prj3(spark, sf):
    return obs.window_counts(table(spark, sf, "lineitem"), "l_extendedprice", 2000.0, 90000.0, ["l_returnflag"])


@query("prj4_unit_filter_convert", """
    SELECT user_id, count(*) AS n, round(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.3048), 6) AS metres
    FROM events WHERE event_type = 'view' AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL GROUP BY 1""")
def prj4(spark, sf):
    df = events(spark, sf).select("user_id", "event_type", F.get_json_object("props", "$.k").alias("reading"))
    out = obs.unit_filter_convert(df, "reading", F.col("event_type"), "view")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("metres")).alias("metres"))


def granules(spark, sf):
    day = F.to_date("o_orderdate")
    name = F.concat(F.lit("G.A"), F.year(day), F.lpad(F.dayofyear(day).cast("string"), 3, "0"), F.lit(".h"), F.col("o_orderkey"))
    return table(spark, sf, "orders").select(name.alias("granule"), "o_orderstatus").withColumn("day", obs.nominal_date(F.col("granule")))


@query("prj5_nominal_date", """
    SELECT 'G.A' || year(o_orderdate) || lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') || '.h' || o_orderkey AS granule,
           strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(month(o_orderdate) AS INT) AS month FROM orders""")
def prj5(spark, sf):
    return granules(spark, sf).select("granule", F.col("day").cast("string").alias("day"), F.month("day").alias("month"))


@query("prj6_declared_window", """
    SELECT CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1999-10-31' AND month(o_orderdate) IN (3, 4, 9) GROUP BY 1""")
def prj6(spark, sf):
    kept = obs.declared_window(granules(spark, sf), "day", "1996-03-01", "1999-10-31", [3, 4, 9])
    return kept.groupBy(F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("jn11_site_attributes", """
    SELECT p.p_brand, count(*) AS n, sum(CASE WHEN p.p_partkey IS NULL THEN 1 ELSE 0 END)::BIGINT AS unplaced,
           round(sum(l_quantity), 2) AS quantity
    FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def jn11(spark, sf):
    sites = table(spark, sf, "part").filter("p_size > 25").select("p_partkey", "p_brand")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    joined = rows.join(sites, rows.l_partkey == sites.p_partkey, "left")
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_partkey").isNull().cast("bigint")).alias("unplaced"),
                                         r6(F.sum("l_quantity"), 2).alias("quantity"))


@query("set1_union_sites", """
    SELECT c_custkey AS site, c_nationkey AS nation, c_mktsegment AS purpose FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier""")
def set1(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("nation"),
                                            F.col("c_mktsegment").alias("purpose"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("nation"))
    return obs.union_sites([a, b])


@query("set2_names_difference", """
    SELECT name, 'undeclared' AS problem FROM (SELECT l_partkey AS name FROM lineitem EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT name, 'unread' FROM (SELECT o_custkey AS name FROM orders EXCEPT SELECT l_partkey FROM lineitem)""")
def set2(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"))
    return obs.names_difference(used, table(spark, sf, "orders").select(F.col("o_custkey").alias("name")), "name")


@query("set3_compare_manifests", """
    SELECT coalesce(a.k, b.k) AS name, CASE WHEN b.k IS NULL THEN 'absent' WHEN a.k IS NULL THEN 'extra'
           WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status
    FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a FULL JOIN (SELECT p_partkey AS k, p_size AS n FROM part) b ON a.k = b.k""")
def set3(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("bytes"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("bytes"))
    return obs.compare_manifests(a, b, "name", ["bytes"])


@query("set4_payload_hits", """
    SELECT p_brand, count(DISTINCT sha256(CAST(p_partkey AS VARCHAR))) AS hits FROM part
    WHERE sha256(CAST(p_partkey AS VARCHAR)) IN (SELECT sha256(CAST(l_suppkey AS VARCHAR)) FROM lineitem) GROUP BY 1""")
def set4(spark, sf):
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("digest")
    return obs.payload_hits(table(spark, sf, "lineitem").select(digest("l_suppkey")),
                            table(spark, sf, "part").select("p_brand", digest("p_partkey")), "digest", "p_brand")


@query("set5_repeated_names", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def set5(spark, sf):
    return obs.repeated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("set6_outside_not_excluded", """
    SELECT o_orderkey AS name FROM orders WHERE NOT (CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def set6(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.to_date("o_orderdate").alias("day"))
    gone = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("name"))
    return obs.outside_not_excluded(days, "day", "1996-01-01", "1999-12-31", gone, "name").select("name")


@query("set7_calendar_gaps", """
    SELECT CAST(d AS VARCHAR) AS day FROM (SELECT CAST(unnest(generate_series(DATE '1994-06-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS d)
    WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def set7(spark, sf):
    out = obs.calendar_gaps(granules(spark, sf), "day", "1994-06-01", "2002-01-01")
    return out.select(F.col("day").cast("string").alias("day"))


@query("snk4_replace_periods", f"""
    SELECT variant, month, row, col, round(sum, 3) AS sum, cnt FROM {ACC} WHERE month NOT IN (2, 3)
    UNION ALL SELECT variant, month, row, col, round(sum(value), 3), count(*) FROM {MASKED}
    WHERE month IN (2, 3) AND l_linestatus = 'O' GROUP BY ALL""")
def snk4(spark, sf):
    root = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    obs.write_periods(accumulators(spark, sf), root)
    fresh = obs.monthly_accumulate(masked(spark, sf).filter("month IN (2, 3) AND l_linestatus = 'O'"), KEYS)
    name = F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    lines = table(spark, sf, "lineitem").select(
        name.alias("granule"), F.length(name).alias("bytes"), F.sha2(name, 256).alias("sha256"), F.to_date("l_shipdate").alias("day"))
    rules = {"window": ["1990-01-01", "2010-12-31"], "all_variant": "qa <= 5", "snowfree_variant": "qa <= 3"}
    out = obs.replace_periods(root, fresh, rules, rules | {"months": [2, 3]}, lines, lines.filter(F.month("day").isin(2, 3)), ["variant"])
    return out.withColumn("sum", r6(F.col("sum"), 3))
