"""Reductions: fixed-order and fast sums, means, class shares, order statistics, exceedance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridspark.contracts import raise_if_any, require
from gridspark.functions import numeric
from gridspark.operators.ordered import PARTS, FromData, match, numbered, order_statistics

BLOCK = 256  # fixed value: terms folded in order before block sums are combined
FAN = 2048  # block sums combined per task and stage
_STAGES = 5  # FAN^5 blocks are more than a 64-bit index can number, so one row per key is always left


@F.pandas_udf(T.DoubleType())
def _halving_sum(parts: pd.Series) -> pd.Series:
    """Sum each array by recursive halving of its index range."""

    def fold(a, lo, n):
        if n == 1:
            return a[lo]
        half = n // 2
        return fold(a, lo, half) + fold(a, lo + half, n - half)

    return parts.map(lambda a: fold(a, 0, len(a)) if len(a) else 0.0)


def _subtree(block: Column, blocks: Column) -> Column:
    """The node of the halving tree over `blocks` leaves that holds leaf `block`, at the first depth
    where every node has at most FAN leaves: its left-to-right position."""
    depth = F.greatest(F.lit(0), F.ceil(F.log2(blocks / F.lit(FAN)))).cast("int")
    start = F.struct(F.lit(0).cast("bigint").alias("lo"), blocks.cast("bigint").alias("n"),
                     F.lit(0).cast("bigint").alias("path"))

    def step(node, _):
        half = F.floor(node["n"] / 2).cast("bigint")
        left = block < node["lo"] + half
        return F.when(
            left, F.struct(node["lo"].alias("lo"), half.alias("n"), (node["path"] * 2).alias("path"))
        ).otherwise(
            F.struct((node["lo"] + half).alias("lo"), (node["n"] - half).alias("n"),
                     (node["path"] * 2 + 1).alias("path"))
        )

    walk = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(walk, start, step)["path"]


def _in_order(name: str, by: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), F.col(name)))), lambda s: s[name])


def pairwise_sum(df: DataFrame, x: str, idx: str = "idx", keys: Sequence[str] = (),
                 blocksize: int = BLOCK, kind: str = "f64", name: str = "total",
                 counts: DataFrame | None = None) -> DataFrame:
    """The fixed-order sum of `x` per key over a dense 1-based `idx`.

    Blocks of `blocksize` consecutive indices are folded in index order, and the block sums are
    added along the halving tree of the block range. The result depends on the values, the count
    and the block size only, never on how rows are partitioned. No task holds more than
    `blocksize` rows or FAN block sums of a group. `counts` (keys, n) spares finding the largest
    index again where the caller can count its rows more cheaply.
    """
    keys = list(keys)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.max(idx).alias("n"))
    rows = df.select(*keys, F.col(idx).alias("_i"), numeric.accumulator(F.col(x), kind).alias("_x"),
                     F.floor((F.col(idx) - 1) / blocksize).cast("bigint").alias("_b"))
    if kind == "f32":
        # a float sum is widened by the engine, so the fold in f32 is written out
        fold = F.aggregate(_in_order("_x", "_i"), F.lit(0.0).cast("float"), lambda acc, v: (acc + v).cast("float"))
        blocks = rows.groupBy(*keys, "_b").agg(fold.cast("double").alias("_s"))
    else:
        # a window over a whole block adds its rows one by one in the declared order
        block = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.pmod(F.col("_i") - 1, F.lit(blocksize)) == 0
        blocks = rows.withColumn("_s", F.sum("_x").over(block)).filter(first).select(*keys, "_b", "_s")
    sizes = counts.select(*keys, (F.floor((F.col("n") - 1) / blocksize) + 1).cast("bigint").alias("_nb"))
    placed = match(blocks, sizes, keys) if keys else blocks.withColumn("_nb", sizes.scalar())
    placed = placed.withColumn("_p", _subtree(F.col("_b"), F.col("_nb")))
    out = placed.groupBy(*keys, "_p").agg(_in_order("_s", "_b").alias("_a"))
    for _ in range(_STAGES - 1):
        out = (
            out.select(*keys, F.col("_p"), _halving_sum("_a").alias("_s"))
            .groupBy(*keys, F.floor(F.col("_p") / FAN).cast("bigint").alias("_p2"))
            .agg(_in_order("_s", "_p").alias("_a"))
            .withColumnRenamed("_p2", "_p")
        )
    total = _halving_sum("_a")
    return out.select(*keys, (total.cast("float").cast("double") if kind == "f32" else total).alias(name))


def compensated_sum(df: DataFrame, x: str, idx: str = "idx", keys: Sequence[str] = (),
                    blocksize: int = BLOCK, name: str = "total") -> DataFrame:
    """The two-sum compensated sum of `x` per key in index order, in f64 whatever the input type.

    Each block carries (hi, lo); block pairs are carried through the same error-free step, in
    block order, FAN to a group.
    """
    keys = list(keys)

    def fold(pairs: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"))

        def step(acc, p):
            s = acc["hi"] + p["hi"]
            e = numeric.two_sum_error(acc["hi"], p["hi"], s)
            return F.struct(s.alias("hi"), (acc["lo"] + p["lo"] + e).alias("lo"))

        return F.aggregate(pairs, start, step)

    level = df.select(*keys, F.col(idx).alias("_i"), F.col(x).cast("double").alias("hi"),
                      F.lit(0.0).alias("lo"), F.floor((F.col(idx) - 1) / blocksize).cast("bigint").alias("_b"))
    for _ in range(_STAGES + 1):
        level = (
            level.groupBy(*keys, "_b")
            .agg(fold(F.array_sort(F.collect_list(F.struct("_i", "hi", "lo")))).alias("_f"))
            .select(*keys, F.col("_b").alias("_i"), F.col("_f.hi").alias("hi"), F.col("_f.lo").alias("lo"),
                    F.floor(F.col("_b") / FAN).cast("bigint").alias("_b"))
        )
    # after the last stage one row per key remains
    return level.select(*keys, (F.col("hi") + F.col("lo")).alias(name))


def ordered_sum(df: DataFrame, x: str, order: Sequence[str], slice_by: Column | FromData | None, keys: Sequence[str] = (),
                kind: str = "f64", name: str = "total") -> DataFrame:
    """`pairwise_sum` over rows numbered by a declared total order within each key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return pairwise_sum(numbered(df, order, slice_by, keys), x, "idx", keys, kind=kind, name=name, counts=counts)


TIER = 8  # binary exponents that are summed together, as integers of 53 to 61 bits


def exact_sum(df: DataFrame, keys: Sequence[str], x: Column, name: str = "total", **others: Column) -> DataFrame:
    """The sum of `x` per key without rounding until the end, whatever the order or number of rows.

    Numbers of like exponent are integers of one unit, which add up exactly as decimals; the few totals by
    exponent are then added, largest last. Infinite and undefined values give what they give in a plain sum.
    `others` are further counts or sums by name, of `_x` or any column of `df`.
    """
    keys = list(keys)
    given = df.withColumn("_x", x.cast("double"))
    size = F.abs("_x")
    finite = (size > 0) & (size < float("inf"))
    rows = given.withColumn("_tier", F.when(finite, F.floor(F.log2(size) / TIER)).cast("int"))
    # two factors, since one alone may overflow
    up = lambda c, e: c * F.pow(F.lit(2.0), F.floor(e / 2)) * F.pow(F.lit(2.0), e - F.floor(e / 2))
    unit = F.lit(53) - F.col("_tier") * TIER
    whole = up(F.col("_x"), unit).cast("bigint").cast("decimal(19,0)")
    tiers = rows.groupBy(*keys, "_tier").agg(
        F.sum(whole).alias("_w"), F.sum(F.when(~finite, F.col("_x"))).alias("_odd"), *[c.alias(k) for k, c in others.items()])
    part = F.coalesce(up(F.col("_w").cast("double"), -unit), F.col("_odd"))
    parts = F.array_sort(F.collect_list(F.struct(F.abs(part).alias("size"), part.alias("part"))))  # at most 263 tiers
    total = F.aggregate(F.transform(F.filter(parts, lambda p: p["part"].isNotNull()), lambda p: p["part"]), F.lit(0.0), lambda a, p: a + p)
    some = F.count(part) > 0
    return tiers.groupBy(*keys).agg(F.when(some, total).alias(name), *[F.sum(k).alias(k) for k in others])


# Segmented reductions: one result per group. The fast form is Spark's own partial + final sum.


def segmented_sum(df: DataFrame, keys: Sequence[str], x: Column, name: str = "total",
                  kind: str = "f64") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(numeric.accumulator(x, kind)).alias(name))


def segmented_weighted_sum(df: DataFrame, keys: Sequence[str], x: Column, w: Column,
                           name: str = "total", kind: str = "f64") -> DataFrame:
    """Both operands are cast to the accumulator type before the product."""
    p = numeric.accumulator(x, kind) * numeric.accumulator(w, kind)
    return df.groupBy(*keys).agg(F.sum(p).alias(name))


def segmented_mean(df: DataFrame, keys: Sequence[str], x: Column, w: Column, name: str = "mean",
                   weight_name: str = "weight", check: bool = False) -> DataFrame:
    """Weighted mean per group; a group of zero weight is null, or refused when `check`."""
    x, w = numeric.accumulator(x), numeric.accumulator(w)
    out = (
        df.groupBy(*keys)
        .agg(F.sum(x * w).alias("_xw"), F.sum(w).alias(weight_name))
        .withColumn(name, F.when(F.col(weight_name) != 0, F.col("_xw") / F.col(weight_name)))
        .drop("_xw")
    )
    if check:
        raise_if_any(zero_weight_groups(out, weight_name), "segment weight", "segmented_mean")
    return out


def zero_weight_groups(means: DataFrame, weight_name: str = "weight") -> DataFrame:
    """The groups `segmented_mean` has no mean for."""
    return means.filter(F.coalesce(F.col(weight_name), F.lit(0.0)) == 0)


def legend_encode(df: DataFrame, label: str, legend: Sequence[str], name: str = "position") -> DataFrame:
    """Label -> legend position; null marks a label outside the legend."""
    table = F.create_map(*[F.lit(v) for i, c in enumerate(legend) for v in (c, i + 1)])
    return df.withColumn(name, F.element_at(table, F.col(label)))


def outside_legend(df: DataFrame, label: str, legend: Sequence[str]) -> DataFrame:
    """Each label the legend does not name, with its row count."""
    bad = df.filter(~F.coalesce(F.col(label).isin(*legend), F.lit(False)))
    return bad.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def class_shares(df: DataFrame, keys: Sequence[str], label: str, w: Column, legend: Sequence[str],
                 magnitude: bool = False) -> DataFrame:
    """Share of the group's weight held by each class of the legend, zero shares included.

    One pass: a conditional sum per class (the legend is declared and short), then one row per
    class by explode. `magnitude` uses |w|, for bounds.
    """
    w = F.abs(w) if magnitude else w
    w = numeric.accumulator(w)
    sums = [F.sum(F.when(F.col(label) == c, w).otherwise(0.0)).alias(f"_c{i}") for i, c in enumerate(legend)]
    wide = df.groupBy(*keys).agg(F.sum(w).alias("_w"), *sums)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_c{i}").alias("amount"))
                     for i, c in enumerate(legend)])
    return (
        wide.select(*keys, "_w", F.explode(rows).alias("_e"))
        .select(*keys, F.col("_e.class").alias("class"), F.col("_e.amount").alias("amount"),
                F.when(F.col("_w") != 0, F.col("_e.amount") / F.col("_w")).alias("share"))
    )


def class_shares_wide(df: DataFrame, keys: Sequence[str], label: str, w: Column,
                      legend: Sequence[str]) -> DataFrame:
    """`class_shares` as one column per class."""
    w = numeric.accumulator(w)
    out = df.groupBy(*keys).agg(
        F.sum(w).alias("_w"),
        *[F.sum(F.when(F.col(label) == c, w).otherwise(0.0)).alias(f"share_{c}") for c in legend],
    )
    return out.select(*keys, *[(F.col(f"share_{c}") / F.col("_w")).alias(f"share_{c}") for c in legend])


def segmented_quantile(df: DataFrame, keys: Sequence[str], x: str, probabilities: Sequence[float],
                       parts: int = PARTS) -> DataFrame:
    """The element at rank clamp(ceil(q n), 1, n) of each group, for every probability: (keys, q, value)."""
    for q in probabilities:
        require(0.0 <= q <= 1.0, "probability", "segmented_quantile", f"{q} is outside [0, 1]")

    def ranks(n):
        return F.array(*[F.struct(F.lit(float(q)).alias("tag"), numeric.quantile_rank(n, F.lit(float(q))).alias("rank"))
                         for q in probabilities])

    return order_statistics(df, keys, x, ranks, parts).select(*keys, F.col("tag").alias("q"), "value")


def segmented_median(df: DataFrame, keys: Sequence[str], x: str, name: str = "median",
                     parts: int = PARTS) -> DataFrame:
    """The median that averages the middle pair of an even count."""

    def ranks(n):
        low = F.floor((n + 1) / 2).cast("bigint")
        high = F.floor(n / 2).cast("bigint") + 1
        return F.array(F.struct(F.lit(0.0).alias("tag"), low.alias("rank")),
                       F.struct(F.lit(1.0).alias("tag"), high.alias("rank")))

    return order_statistics(df, keys, x, ranks, parts).groupBy(*keys).agg(
        (F.sum(F.col("value").cast("double")) / F.count(F.lit(1))).alias(name)
    )


def area_weighted_sum(df: DataFrame, keys: Sequence[str], x: Column, area: Column, threshold: float,
                      name: str = "area_above") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.when(x >= threshold, area).otherwise(0.0)).alias(name))


def area_fraction_above(df: DataFrame, keys: Sequence[str], x: Column, area: Column,
                        thresholds: Sequence[float], check: bool = False) -> DataFrame:
    """Share of the area at or above each threshold, all thresholds from one pass."""
    sums = [F.sum(F.when(x >= t, area).otherwise(0.0)).alias(f"_t{i}") for i, t in enumerate(thresholds)]
    wide = df.groupBy(*keys).agg(F.sum(area).alias("total_area"), *sums)
    if check:
        raise_if_any(wide.filter(~(F.col("total_area") > 0)), "total area", "area_fraction_above")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("above"))
                     for i, t in enumerate(thresholds)])
    return wide.select(*keys, "total_area", F.explode(rows).alias("_e")).select(
        *keys, F.col("_e.threshold").alias("threshold"),
        F.when(F.col("total_area") > 0, F.col("_e.above") / F.col("total_area")).alias("fraction"),
    )


def sum_with_bound(df: DataFrame, keys: Sequence[str], x: Column, kind: str = "f64") -> DataFrame:
    """Sum, count, magnitude and the rounding bound a comparison of the sum must allow."""
    t = numeric.accumulator(x, kind)
    return (
        df.groupBy(*keys)
        .agg(F.sum(t).alias("total"), F.count(t).alias("n"), F.sum(F.abs(t)).alias("magnitude"))
        .withColumn("bound", numeric.error_bound(F.col("n"), F.col("magnitude"), kind))
    )


def pair_tally(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ordered pair with the grand total as the row of two nulls."""
    return df.groupingSets([[a, b], []], a, b).agg(F.count(F.lit(1)).alias("n"))


def digest_set(df: DataFrame, columns: Sequence[str], name: str = "digest") -> DataFrame:
    """One order-free digest of the distinct rows of `df`.

    Row hashes are de-duplicated and folded up a tree of hash prefixes, in sorted order at every
    node; three hex digits a level keep every node at 4096 children or fewer whatever the table.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    level = df.select(row.alias("p")).distinct().select("p", F.col("p").alias("d"))
    for width in (12, 9, 6, 3, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]), "")
        level = (
            level.groupBy(F.substring("p", 1, width).alias("_q"))
            .agg(F.sha2(joined, 256).alias("d"))
            .select(F.col("_q").alias("p"), "d")
        )
    return level.select(F.col("d").alias(name))


def ensemble_members(miss_rate_reciprocal: int, confidence_reciprocal: int) -> int:
    """The smallest m with (1-p)^m <= alpha."""
    return math.ceil(math.log(1.0 / confidence_reciprocal) / math.log(1.0 - 1.0 / miss_rate_reciprocal))


def seeded_sample(df: DataFrame, columns: Sequence[str], m: int, seed: int) -> DataFrame:
    """The m rows with the smallest sha-256 of (seed, columns): the same draw in any row order."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)
    return df.withColumn("draw_key", key).orderBy("draw_key", *columns).limit(m)


def region_reduction(df: DataFrame, dims: Sequence[str], x: Column, w: Column) -> DataFrame:
    """Weighted mean over every combination of the region columns, totals included (cube)."""
    return (
        df.cube(*dims)
        .agg(F.sum(x * w).alias("_xw"), F.sum(w).alias("weight"),
             *[F.grouping(d).cast("int").alias(f"all_{d}") for d in dims])
        .withColumn("mean", F.col("_xw") / F.col("weight"))
        .drop("_xw")
    )
