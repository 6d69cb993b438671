"""Reductions: partition independence bit for bit, adversarial sums, order statistics, controls."""

import math
import operator
import struct
from functools import reduce as fold

import pytest
from pyspark.sql import functions as F

from gridspark.contracts import Refusal
from gridspark.operators import reduce


def frame(spark, xs, parts):
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(xs)], "idx bigint, x double").repartition(parts, "x")


CANCELLING = [1e16, 1.0, -1e16, -1.0] * 5000
SEEDED = [((i * 7919 + 13) % 251) / 50 - 2.5 for i in range(1, 4097)]


def halving(blocks):
    n = len(blocks)
    return blocks[0] if n == 1 else halving(blocks[: n // 2]) + halving(blocks[n // 2:])


def twin(xs, size):
    """The naive path: blocks folded in order, block sums added by halving."""
    # not sum(), which compensates
    return halving([fold(operator.add, xs[i:i + size], 0.0) for i in range(0, len(xs), size)])


@pytest.mark.parametrize("size", [4, 256])
def test_pairwise_sum_is_partition_independent(spark, size):
    for xs in (SEEDED, CANCELLING, SEEDED[:1], SEEDED[:257]):
        got = {struct.pack("d", reduce.pairwise_sum(frame(spark, xs, p), "x", blocksize=size).first()["total"]) for p in (1, 4, 16)}
        assert got == {struct.pack("d", twin(xs, size))}


def test_pairwise_sum_deep_tree(spark):
    xs = [math.sin(i) * 10.0 ** (i % 9) for i in range(9001)]
    got = reduce.pairwise_sum(frame(spark, xs, 5), "x", blocksize=2).first()["total"]  # 4501 blocks: two tree stages
    assert got == twin(xs, 2)


def test_plain_sum_is_the_control(spark):
    """The plain sum of the cancelling pattern does depend on partitions; that is why the other exists."""
    got = {frame(spark, CANCELLING, p).agg(F.sum("x")).first()[0] for p in (1, 3, 7, 16)}
    assert got != {0.0}


def test_compensated_sum(spark):
    xs = [1e8] + [1e-9] * 3000
    got = {reduce.compensated_sum(frame(spark, xs, p), "x").first()["total"] for p in (1, 4, 16)}
    assert got == {math.fsum(xs)}
    assert reduce.compensated_sum(frame(spark, CANCELLING, 4), "x").first()["total"] == 0.0


def test_quantiles_at_the_ends(spark):
    df = spark.createDataFrame([(i % 7, float(i * i % 101)) for i in range(700)], "g int, x double")
    got = {(r["g"], r["q"]): r["value"] for r in reduce.segmented_quantile(df, ["g"], "x", [0.0, 0.37, 1.0]).collect()}
    for g in range(7):
        xs = sorted(float(i * i % 101) for i in range(700) if i % 7 == g)
        for q in (0.0, 0.37, 1.0):
            assert got[g, q] == xs[min(max(math.ceil(q * len(xs)), 1), len(xs)) - 1]
    with pytest.raises(Refusal):
        reduce.segmented_quantile(df, ["g"], "x", [1.5])


def test_zero_weight_is_refused(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 3.0, 1.0)], "g int, x double, w double")
    with pytest.raises(Refusal):
        reduce.segmented_mean(df, ["g"], F.col("x"), F.col("w"), check=True)
    assert reduce.zero_weight_groups(reduce.segmented_mean(df, ["g"], F.col("x"), F.col("w"))).count() == 1


def test_digest_set_ignores_order_and_repeats(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    a = reduce.digest_set(df, ["id", "v"]).first()[0]
    assert a == reduce.digest_set(df.union(df).repartition(9, "v"), ["id", "v"]).first()[0]
    assert a != reduce.digest_set(df.filter("id <> 3"), ["id", "v"]).first()[0]


def test_members():
    m = reduce.ensemble_members(100, 100)
    assert 0.99**m <= 0.01 < 0.99 ** (m - 1)


def test_exact_sum_does_not_depend_on_order(spark):
    xs = CANCELLING + [((i * 7919) % 1009) * 10.0 ** (i % 40 - 20) * (-1) ** i for i in range(3000)] + [5e-324, 2.0**1000, -(2.0**1000)]
    for parts in (1, 7):
        assert reduce.exact_sum(frame(spark, xs, parts), [], F.col("x")).first()["total"] == pytest.approx(math.fsum(xs), rel=1e-15)
    odd = spark.createDataFrame([(1, 1.0), (1, None), (2, None), (3, float("inf")), (3, 1.0), (4, float("nan")), (5, 0.0)], "k int, x double")
    got = dict(reduce.exact_sum(odd, ["k"], F.col("x")).collect())
    assert got[1] == 1.0 and got[2] is None and got[3] == math.inf and math.isnan(got[4]) and got[5] == 0.0
    assert reduce.exact_sum(odd.limit(0), [], F.col("x")).first()["total"] is None


def test_ledger_totals_are_exact(spark):
    """A plain sum loses 1 a row beside 2^53, so the balance of the same rows in another order would be off by thousands."""
    from gridspark.operators import fields

    rows = spark.range(1, 20001).select(F.col("id").alias("cell"), F.when(F.col("id") == 1, F.lit(2.0**53)).otherwise(1.0).alias("v")).coalesce(1)
    row = fields.total_ledger(rows, rows.orderBy(F.desc("cell")).coalesce(1), "v").first()
    assert row["residual"] == 0.0 and row["closed"]
    assert fields.total_ledger(rows.limit(0), rows.limit(0), "v").first()["closed"]
