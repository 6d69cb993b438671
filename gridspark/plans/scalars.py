"""Scalar expressions over whole tables, aggregated to small results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import cells, numeric
from gridspark.plans.fixtures import CELL_SQL, events, fine_field, seconds
from gridspark.plans.registry import query, r6, table


@query("sca1_hierarchy", f"""
    SELECT (c - 1) // 64 + 1 AS anc, count(*) AS n, min((c - 1) // 4 + 1) AS lowest_parent,
           min((c - 1) * 16 + 1) AS first_desc, max(c * 16) AS last_desc
    FROM (SELECT {CELL_SQL} AS c FROM lineitem) GROUP BY 1""")
def sca1(spark, sf):
    c = F.col("cell")
    return fine_field(spark, sf).groupBy(cells.ancestor(c, 3).alias("anc")).agg(
        F.count(F.lit(1)).alias("n"), F.min(cells.parent(c)).alias("lowest_parent"),
        F.min(cells.first_descendant(c, 2)).alias("first_desc"), F.max(cells.last_descendant(c, 2)).alias("last_desc"))


@query("sca2_index_base", """
    SELECT bool_and(c BETWEEN 1 AND 20480) AS in_range, min(c - 1) AS first_disk, max(c - 1) AS last_disk, count(*) AS n
    FROM (SELECT 1 + l_orderkey % 20480 AS c FROM lineitem)""")
def sca2(spark, sf):
    c = F.col("cell")
    return fine_field(spark, sf).agg(F.bool_and(cells.in_level(c, 5)).alias("in_range"),
                                     F.min(cells.disk_id(c)).alias("first_disk"), F.max(cells.disk_id(c)).alias("last_disk"),
                                     F.count(cells.memory_id(cells.disk_id(c))).alias("n"))


def _points(spark, sf):
    """Supplier and part ids as three points of the unit sphere per line item."""
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity")

    def at(lat, lon):
        return (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))

    lat = F.radians((F.col("l_suppkey") % 160 - 80).cast("double"))
    lon = F.radians((F.col("l_partkey") % 350 - 175).cast("double"))
    step = F.radians(F.col("l_quantity") / 10.0 + 1.0)
    a, b, c = at(lat, lon), at(lat, lon + step), at(lat + step / 2.0, lon)
    return df.withColumns({f"{n}{k}": v for n, p in (("a", a), ("b", b), ("c", c)) for k, v in zip("xyz", p)})


_POINTS_SQL = """
    SELECT l_suppkey, cos(lat) * cos(lon) AS ax, cos(lat) * sin(lon) AS ay, sin(lat) AS az,
           cos(lat) * cos(lon + st) AS bx, cos(lat) * sin(lon + st) AS by_, sin(lat) AS bz,
           cos(lat + st / 2) * cos(lon) AS cx, cos(lat + st / 2) * sin(lon) AS cy, sin(lat + st / 2) AS cz
    FROM (SELECT l_suppkey, radians(CAST(l_suppkey % 160 - 80 AS DOUBLE)) AS lat,
                 radians(CAST(l_partkey % 350 - 175 AS DOUBLE)) AS lon, radians(l_quantity / 10.0 + 1.0) AS st FROM lineitem)"""


def triple(n):
    return tuple(F.col(n + k) for k in "xyz")


@query("sca3_lat_lon", f"""
    SELECT l_suppkey, round(sum(atan2(az, sqrt(ax * ax + ay * ay))), 6) AS lat, round(sum(atan2(ay + 0.0, ax)), 6) AS lon
    FROM ({_POINTS_SQL}) GROUP BY 1""")
def sca3(spark, sf):
    p = triple("a")
    return _points(spark, sf).groupBy("l_suppkey").agg(r6(F.sum(numeric.latitude(p))).alias("lat"),
                                                       r6(F.sum(numeric.longitude(p))).alias("lon"))


_TRIPLE = "(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx))"


@query("sca4_spherical_geometry", f"""
    SELECT l_suppkey,
           round(sum(atan2(sqrt(pow(ay * bz - az * by_, 2) + pow(az * bx - ax * bz, 2) + pow(ax * by_ - ay * bx, 2)),
                           ax * bx + ay * by_ + az * bz)), 6) AS arc,
           round(sum(2 * atan2(abs({_TRIPLE}), 1 + ax * bx + ay * by_ + az * bz + bx * cx + by_ * cy + bz * cz
                               + cx * ax + cy * ay + cz * az)), 6) AS area,
           round(sum((az + bz) / sqrt(pow(ax + bx, 2) + pow(ay + by_, 2) + pow(az + bz, 2))), 6) AS mid_z,
           true AS formulas_agree
    FROM ({_POINTS_SQL}) GROUP BY 1""")
def sca4(spark, sf):
    a, b, c = triple("a"), triple("b"), triple("c")
    area, other = numeric.triangle_area(a, b, c), numeric.triangle_area_by_sides(a, b, c)
    return _points(spark, sf).groupBy("l_suppkey").agg(
        r6(F.sum(numeric.arc_length(a, b))).alias("arc"), r6(F.sum(area)).alias("area"),
        r6(F.sum(numeric.midpoint(a, b)[2])).alias("mid_z"),
        F.bool_and(F.abs(area - other) < 1e-9).alias("formulas_agree"))


@query("sca5_at_radius", """
    SELECT l_returnflag, round(sum(l_tax * pow(6371.0, 2)), 4) AS area, round(sum(l_discount * 6371.0), 4) AS length
    FROM lineitem GROUP BY 1""")
def sca5(spark, sf):
    return fine_field(spark, sf).groupBy("l_returnflag").agg(
        r6(F.sum(cells.at_radius(F.col("l_tax"), 6371.0, 2)), 4).alias("area"),
        r6(F.sum(cells.at_radius(F.col("l_discount"), 6371.0, 1)), 4).alias("length"))


@query("sca6_time_encoding", """
    SELECT event_type, sum(CAST(floor(t) AS BIGINT))::BIGINT AS whole, round(sum(t - floor(t)), 4) AS fraction, true AS exact
    FROM (SELECT event_type, epoch_us(ts) / 1e6 AS t FROM events) GROUP BY 1""")
def sca6(spark, sf):
    whole, fraction = numeric.encode_time(F.col("t"))
    df = events(spark, sf).select("event_type", seconds("ts").alias("t")).withColumns({"w": whole, "f": fraction})
    return df.groupBy("event_type").agg(F.sum("w").alias("whole"), r6(F.sum("f"), 4).alias("fraction"),
                                        F.bool_and(numeric.decode_time(F.col("w"), F.col("f")) == F.col("t")).alias("exact"))


@query("sca7_damping", """
    SELECT user_id, round(sum(exp(-value / 50.0)), 6) AS in_seconds, round(sum(exp(-value / (2.0 * 40.0))), 6) AS in_rotations
    FROM events GROUP BY 1""")
def sca7(spark, sf):
    v = F.col("value")
    return events(spark, sf).groupBy("user_id").agg(
        r6(F.sum(numeric.damping(v, F.lit(50.0)))).alias("in_seconds"),
        r6(F.sum(numeric.damping_in_rotations(v, F.lit(2.0), F.lit(40.0)))).alias("in_rotations"))


@query("sca9_two_sum", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (a - (s - (s - a))) + (b - (s - a)) AS error
    FROM (SELECT *, a + b AS s FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          l_extendedprice * 1e12 AS a, l_quantity * 0.1 AS b FROM lineitem))""")
def sca9(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             (F.col("l_extendedprice") * 1e12).alias("a"), (F.col("l_quantity") * 0.1).alias("b"))
    e = numeric.two_sum_error(F.col("a"), F.col("b"), F.col("a") + F.col("b"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", e.alias("error"))


@query("sca12_dot_cross", """
    SELECT l_linenumber, round(sum(q * d + t * q + p * t), 4) AS dot, round(sum(t * t - p * q), 4) AS cx,
           round(sum(p * d - q * t), 4) AS cy, round(sum(q * q - t * d), 4) AS cz
    FROM (SELECT l_linenumber, l_quantity AS q, l_tax AS t, l_discount AS d, l_extendedprice / 1e4 AS p FROM lineitem) GROUP BY 1""")
def sca12(spark, sf):
    q, t, d, p = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice") / 1e4
    a, b = (q, t, p), (d, q, t)
    c = numeric.cross(a, b)
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        r6(F.sum(numeric.dot(a, b)), 4).alias("dot"), *[r6(F.sum(c[i]), 4).alias(f"c{k}") for i, k in enumerate("xyz")])


@query("sca13_hanging_flux", """
    SELECT l_suppkey, round(sum(l_discount * l_quantity + l_tax * l_extendedprice), 4) AS flux FROM lineitem GROUP BY 1""")
def sca13(spark, sf):
    f = cells.hanging_flux(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(F.sum(f), 4).alias("flux"))


@query("prj10_ratio_to_unit", """
    SELECT o_orderpriority, round(avg(o_totalprice / 86400.0), 6) AS days FROM orders GROUP BY 1""")
def prj10(spark, sf):
    ratio = numeric.ratio_to_unit(F.col("o_totalprice"), F.lit(numeric.DAY_SECONDS))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(r6(F.avg(ratio)).alias("days"))
