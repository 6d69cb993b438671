"""Sliced ordered operators against plain windows, with one key holding most rows."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from gridspark.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.6 else rng.randrange(1, 20), rng.randrange(500), i, rng.choice([None, 1.0, 2.5, 7.0]))
            for i in range(3000)]
    return spark.createDataFrame(data, "k int, t int, id int, v double").repartition(6)


SLICES = {"coarse": lambda: F.floor(F.col("t") / 100), "fine": lambda: F.floor(F.col("t") / 3), "one": lambda: F.lit(0), "ranged": lambda: None,
          "data": lambda: ordered.FromData(8, 20), "whole": lambda: ordered.FromData()}


@pytest.mark.parametrize("cut", SLICES)
def test_against_windows(rows, cut):
    w = Window.partitionBy("k").orderBy("t", "id")
    order, s = ["t", "id"], SLICES[cut]()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.row_number().over(w).cast("bigint").alias("n"), F.lag("v").over(w).alias("p"),
                       F.last("v", True).over(upto).alias("l"), F.coalesce(F.sum("v").over(upto), F.lit(0.0)).alias("r"))
    want = sorted(map(tuple, want.collect()))
    n = dict(ordered.numbered(rows, order, s, ["k"]).select("id", "idx").collect())
    p = dict(ordered.lagged(rows, {"p": "v"}, order, s, ["k"]).select("id", "p").collect())
    last = dict(ordered.last_known(rows, "v", order, s, ["k"]).select("id", "last").collect())
    r = dict(ordered.running_sum(rows.fillna(0.0, ["v"]), "v", order, s, ["k"]).select("id", "running").collect())
    assert want == sorted((i, n[i], p[i], last[i], r[i]) for i in n)


def test_no_key(rows):
    got = ordered.numbered(rows, ["t", "id"], F.floor(F.col("t") / 50)).select("id", "idx").collect()
    want = rows.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("n")).collect()
    assert dict(got) == dict(want)


def test_last_records_and_top_k(rows):
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc())
    want = sorted(map(tuple, rows.withColumn("b", F.row_number().over(w)).filter("b <= 4").select("id", "b").collect()))
    got = ordered.last_records(rows, 4, ["t", "id"], F.floor(F.col("t") / 10), ["k"]).select("id", "back").collect()
    assert sorted(map(tuple, got)) == want
    top = ordered.top_k(rows, 4, [F.col("t").desc(), F.col("id").desc()], ["k"]).select("id", "rank").collect()
    assert sorted(map(tuple, top)) == want


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, None)], "k int, t int")
    assert ordered.numbered(df, ["t"], F.lit(0), ["k"]).count() == 4
    got = ordered.numbered(df, ["t"], ordered.FromData(4, 1), ["k"]).collect()
    assert sorted((r["k"] or 0, r["t"] or 0, r["idx"]) for r in got) == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 3, 2)]


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp", "date"])
@pytest.mark.parametrize("n", [300, 3000, 30000])
def test_slices_follow_the_data(spark, n, kind):
    """A key with half of all rows, nearly all of them in one burst: no slice is much over its share at any size."""
    t = F.when(F.col("id") % 10 == 0, F.col("id") * 100_000).otherwise(F.col("id")) if kind != "date" else F.col("id")
    made = F.timestamp_seconds(t) if kind == "timestamp" else F.date_add(F.lit("1990-01-01").cast("date"), t.cast("int")) if kind == "date" else t.cast(kind)
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), made.alias("t"), "id")
    sliced, group = ordered._sliced(df, ordered.FromData(16, 50), ["k"], ["t", "id"])
    per = sliced.groupBy(*group, ordered.SLICE).agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in per) <= max(50, 2 * (n / 2) / 16) and max(r[ordered.SLICE] for r in per) < 16
    w = Window.partitionBy("k").orderBy("t", "id")
    want = dict(df.select("id", F.row_number().over(w)).collect())
    assert dict(ordered.numbered(df, ["t", "id"], ordered.FromData(16, 50), ["k"]).select("id", "idx").collect()) == want


@pytest.mark.parametrize("parts, bound", [(2, 1), (4, 1), (64, 1 << 16)])
def test_order_statistics(rows, parts, bound):
    def ranks(n):
        return F.array(*[F.struct(F.lit(float(r)).alias("tag"), F.least(n, F.lit(r)).cast("bigint").alias("rank")) for r in (1, 7, 10**6)])

    got = {(r["k"], r["tag"]): r["value"] for r in ordered.order_statistics(rows, ["k"], "v", ranks, parts, bound).collect()}
    by = {}
    for r in rows.collect():
        if r["v"] is not None:
            by.setdefault(r["k"], []).append(r["v"])
    for k, vs in by.items():
        vs.sort()
        for tag in (1, 7, 10**6):
            assert got[k, float(tag)] == vs[min(tag, len(vs)) - 1]


def test_null_keys_of_every_kind(spark):
    rows = [(i, None if i % 3 == 0 else i % 2, None if i % 5 == 0 else "ab"[i % 2], None if i % 4 == 0 else [i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, n int, s string, a array<int>")
    for keys in (["n"], ["s"], ["n", "s"], ["a"]):
        w = Window.partitionBy(*keys).orderBy("id")
        want = dict(df.select("id", F.row_number().over(w).alias("r")).collect())
        assert dict(ordered.numbered(df, ["id"], F.col("id") % 1, keys).select("id", "idx").collect()) == want
        one = lambda n: F.array(F.struct(F.lit(0.0).alias("tag"), F.lit(1).cast("bigint").alias("rank")))
        got = {tuple(map(str, r[:-1])): r[-1] for r in ordered.order_statistics(df, keys, "id", one, 4).select(*keys, "value").collect()}
        assert got == {tuple(map(str, r[:-1])): r[-1] for r in df.groupBy(*keys).agg(F.min("id")).collect()}


def skewed(spark, n):
    """A hot key with one far outlier, a heavy value, a dense cluster and a heavy tail, and a small key."""
    rng = random.Random(n)
    values = [1e12, -1e15] + [7.0] * (n // 2) + [7.0 + i * 1e-9 for i in range(n // 2)] + [rng.paretovariate(0.3) for _ in range(n // 2)]
    rows = [("hot", v) for v in values] + [("cold", float(i)) for i in range(5)] + [(None, float("inf")), (None, float("nan")), (None, 2.0), ("hot", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(7)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("n, bound", [(400, 10), (4000, 100), (20000, 1 << 16)])
def test_order_statistics_of_any_distribution(spark, n, bound, keys):
    rows, df = skewed(spark, n)
    tags = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)

    def ranks(m):
        return F.array(*[F.struct(F.lit(q).alias("tag"), F.greatest(F.lit(1), F.ceil(m * q)).cast("bigint").alias("rank")) for q in tags])

    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault((k,) if keys else (), []).append(v)
    got = ordered.order_statistics(df, keys, "v", ranks, 16, bound).collect()
    found = {(tuple(r[k] for k in keys), r["tag"]): r["value"] for r in got}
    assert len(got) == len(groups) * len(tags)
    for g, vs in groups.items():
        vs.sort(key=lambda v: (math.isnan(v), v))
        for q in tags:
            want = vs[max(1, math.ceil(len(vs) * q)) - 1]
            assert found[g, q] == want or math.isnan(want) and math.isnan(found[g, q])


@pytest.mark.parametrize("n", [400, 4000, 40000])
def test_no_slice_is_large(spark, n):
    """Cut points follow the values: neither an outlier nor a cluster leaves a slice with much more than its share."""
    _, df = skewed(spark, n)
    values = df.filter("k = 'hot' and v is not null").select(F.lit("hot").alias("k"), "v").distinct()
    d = values.count()
    per = ordered.cut_by_value(values, ["k"], "v", "s", 64, 50).groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()
    assert max(r["n"] for r in per) <= 2 * d / 64 + 2 and len(per) > 32
    assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]))


def test_cuts_deal_no_rows_out_by_key(spark):
    """A few keys with many rows each are not one task each; keys that need no cut meet nothing at all."""
    from gridspark.operators.ordered import cut_by_value

    df = spark.range(3000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 3001).alias("v"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    cut = cut_by_value(df, ["k"], "v", "s", parts=16, bound=100)
    assert "hashpartitioning" not in plan(cut)
    spans = cut.groupBy("k", "s").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("k", "s").collect()
    assert len(spans) == 48 and max(r.n for r in spans) < 80 and sum(r.n for r in spans) == 3000
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]) if a.k == b.k)
    whole = cut_by_value(df, ["k"], "v", "s", parts=16, bound=1000)
    assert "Exchange" not in plan(whole) and whole.filter("s <> 0").isEmpty()


def test_history_is_ordered_once(spark):
    from gridspark.operators import audit

    v = spark.createDataFrame([(1, 1, 0.1, "report"), (1, 2, 0.2, "fail_bar"), (1, 3, 0.3, "fail_bar"), (2, 1, None, "report"), (2, 2, 0.1, "report")],
                              "id int, merge int, threshold double, verdict_kind string")
    touched = spark.createDataFrame([(2, "src/a"), (3, "src/b"), (3, "docs/b")], "merge int, path string")
    held = spark.createDataFrame([(1, 3), (2, 2)], "id int, merge int")
    out = audit.history_problems(v, touched, held, ["merge"], ordered.FromData())
    assert sorted(map(tuple, out.collect())) == [
        (1, 2, "a bar set after a report"), (1, 2, "threshold changes together with code"), (2, 2, "a stale exception")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
