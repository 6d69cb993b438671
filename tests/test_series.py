"""Series tests against enumeration."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.contracts import Refusal
from gridspark.functions import nulls
from gridspark.operators import series
from gridspark.operators.ordered import FromData, value_slice


def score(x):
    return sum((b > a) - (b < a) for a, b in itertools.combinations(x, 2))


@pytest.mark.parametrize("values", [(1, 2, 3, 4, 5), (1, 1, 2, 3), (2, 2, 2), (1, 1, 2, 2, 3, 3), (4,)])
def test_exact_tail(values):
    sizes = tuple(sorted(values.count(v) for v in set(values)))
    orders = set(itertools.permutations(values))
    for s in {score(o) for o in orders}:
        hits, total = series.trend_tail(s, sizes)
        assert total == len(orders) and hits == sum(abs(score(o)) >= abs(s) for o in orders)


def test_minimum_lengths():
    assert series.exchangeable_minimum_length(0.05) == 5 and series.offset_minimum_length(0.05) == 6
    assert series.random_permutation_minimum(0.05) == 20
    assert series._offset_tail(10, 8) == float(Fraction(2 * sum(math.comb(10, j) for j in (8, 9, 10)), 1024))


def spread(sizes):
    return tuple(sorted(Counter(sizes).items()))


def test_tails_of_short_series_equal_enumeration():
    rng = random.Random(6)
    for _ in range(150):
        sizes = tuple(sorted(Counter(rng.randrange(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 36))).values()))
        pairs = nulls.unequal_pairs(spread(sizes))
        for s in {pairs, pairs - 2 * rng.randrange(pairs + 1), pairs % 2}:
            hits, total = series.trend_tail(s, sizes)
            p, error = nulls.trend_p(abs(s), spread(sizes))
            assert abs(p - hits / total) <= error < 1e-11
            assert nulls.trend_rejects(s, spread(sizes), hits / total) == (Fraction(hits, total) <= Fraction(hits / total))


@pytest.mark.parametrize("sizes", [(1,) * 120, (1,) * 60 + (3,) * 20, (1,) * 90 + (30,), (60, 60), (1, 119)])
def test_tails_of_middling_series_equal_enumeration(sizes):
    ties, spreadout = spread(sizes), math.sqrt(nulls.inversion_variance(spread(sizes)))
    pairs = nulls.unequal_pairs(ties)
    for z in (0.3, 1.6, 3.1, 5.0):
        s = min(pairs, int(2 * z * spreadout))
        s -= (pairs - s) % 2
        hits, total = series.trend_tail(s, sizes)
        p, error = nulls.trend_p(s, ties)
        assert abs(p - float(Fraction(hits, total))) <= error < 1e-11


@pytest.mark.parametrize("sizes", [(1,) * 256, (1,) * 257, (1,) * 1000, (1,) * 200 + (4,) * 14, (1,) * 100 + (200,)])
def test_tails_hold_between_few_and_all_frequencies(monkeypatch, sizes):
    """At lengths beyond enumeration the short sum equals the one over every frequency of the period."""
    ties = spread(sizes)
    pairs, wide = nulls.unequal_pairs(ties), 2 * math.sqrt(nulls.inversion_variance(ties))
    scores = [int(z * wide) - (pairs - int(z * wide)) % 2 for z in (1.96, 4.9)]
    few = [nulls.trend_p(s, ties) for s in scores]
    monkeypatch.setattr(nulls, "DEPTH", 1e9)
    nulls.trend_p.cache_clear()
    every = [nulls.trend_p(s, ties) for s in scores]
    nulls.trend_p.cache_clear()
    for (p, e), (q, f) in zip(few, every):
        assert abs(p - q) <= e + f < 1e-10
    # No step between lengths: the tail at a fixed depth is smooth in n and tends to the normal one.
    assert few[0][0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=0.05)


def test_the_verdict_is_exact_where_a_normal_limit_is_not():
    # n = 180 at one in a million: the exact critical score is 3914, that of the normal limit 3956.
    ties = ((1, 180),)
    critical = min(s for s in range(3800, 4000, 2) if nulls.trend_rejects(s, ties, 1e-6))
    hits, total = series.trend_tail(critical, (1,) * 180)
    assert critical == 3914 and hits <= Fraction(1e-6) * total
    hits, total = series.trend_tail(critical - 2, (1,) * 180)
    assert hits > Fraction(1e-6) * total


def test_long_series_are_judged(spark):
    rng = random.Random(9)
    groups = {f"n{n}": [0.002 * i + rng.gauss(0, 1) for i in range(n)] for n in (256, 257, 1000)} | {"flat": [rng.gauss(0, 1) for _ in range(1000)], "same": [1.0] * 300}
    out = series.trend_test(frame(spark, groups), ["g"], "r", ["w"], value_slice("w", 100.0), value_slice("r", 1.0), 0.01)
    for r in out.collect():
        s = score(groups[r["g"]])
        p, _ = nulls.trend_p(abs(s), spread(Counter(groups[r["g"]]).values()))
        assert r["score"] == s and r["p_trend"] == p and r["trend"] == (p <= 0.01)
    assert {r["g"] for r in out.filter("trend").collect()} >= {"n1000"} and not out.filter("g in ('flat', 'same') and trend").count()


def test_fair_signs_decide_exact_ties():
    for n in range(6, 60, 7):
        for k in range(n // 2, n + 1):
            exact = Fraction(2 * sum(math.comb(n, j) for j in range(k, n + 1)), 2**n)
            if exact <= 1:
                assert float(nulls.fair_tail(n, k)) == float(exact)
                assert nulls.offset_rejects(n, k, float(exact)) == (exact <= Fraction(float(exact)))
                assert not nulls.offset_rejects(n, k, math.nextafter(float(exact), 0.0)) or exact <= Fraction(math.nextafter(float(exact), 0.0))


def frame(spark, groups):
    rows = [(g, float(i), float(x), 1.0) for g, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g string, w double, r double, tol double").repartition(5)


@pytest.mark.parametrize("cut", [1.0, 7.0, 1000.0])
def test_kendall_and_ranks(spark, cut):
    rng = random.Random(4)
    groups = {"long": [rng.randrange(12) for _ in range(237)], "up": list(range(33)), "tied": [3] * 8, "one": [5]}
    df = frame(spark, groups)
    ranked = series.doubled_midranks(df, ["g"], "r", value_slice("r", cut))
    for r in ranked.collect():
        xs = groups[r["g"]]
        assert r["rank2"] == 2 * sum(x < r["r"] for x in xs) + sum(x == r["r"] for x in xs) + 1
    got = series.kendall_score(ranked, ["g"], "rank2", ["w"], value_slice("w", cut), rank_width=5)
    assert {r["g"]: r["score"] for r in got.collect()} == {g: score(xs) for g, xs in groups.items()}
    stat = series.successive_difference(ranked, ["g"], "rank2", ["w"], value_slice("w", cut))
    ranks = {g: [2 * sum(y < x for y in xs) + xs.count(x) + 1 for x in xs] for g, xs in groups.items()}
    assert dict(stat.collect()) == {g: -sum((b - a) ** 2 for a, b in zip(r, r[1:])) for g, r in ranks.items()}


@pytest.mark.parametrize("long", [8, 64])
def test_scores_of_short_and_long_series_are_the_same(spark, monkeypatch, long):
    """Series on either side of LONG, values that are null, not numbers and of both zeros, an order that is null first."""
    monkeypatch.setattr(series, "LONG", long)
    rng = random.Random(12)
    groups = {f"n{n}": [rng.randrange(9) for _ in range(n)] for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200)}
    odd = [None, 1.0, float("nan"), 0.0, -0.0, None, float("-inf"), float("nan"), 2.0]
    rows = [(g, float(i) if i else None, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)]
    rows += [("odd", float(i), x) for i, x in enumerate(odd)] + [(None, float(i), float(-i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, w double, r double").repartition(5)
    groups |= {"odd": [0, 3, 5, 2, 2, 0, 1, 5, 4], None: [-i for i in range(12)]}
    for row in series.trend_test(df, ["g"], "r", ["w"], value_slice("w", 10.0), FromData(), 0.05).collect():
        xs = groups.pop(row["g"])
        p, _ = nulls.trend_p(abs(score(xs)), spread(Counter(xs).values()))
        assert (row["n"], row["score"], row["p_trend"]) == (len(xs), score(xs), p)
        assert row["trend"] == (p <= 0.05 if len(xs) >= 5 else None)
    assert not groups


def test_scores_of_many_series_at_once(monkeypatch):
    rng = random.Random(3)
    many = [[rng.randrange(rng.choice((2, 30, 1000))) for _ in range(rng.randrange(1, 90))] for _ in range(300)]
    monkeypatch.setattr(series, "CHUNK", 500)
    scores, ties = series._scored_in_chunks([np.array(x) for x in many])
    assert list(scores) == [score(x) for x in many] and ties == [spread(Counter(x).values()) for x in many]


def test_a_short_series_is_dealt_out_once(spark):
    """No row a value and digit, and one shuffle of the values."""
    df = spark.range(4000).select((F.col("id") % 60).alias("g"), F.col("id").alias("w"), (F.col("id") * 37 % 101).alias("r"))
    plan = series.trend_test(df, ["g"], "r", ["w"], FromData(), FromData(), 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Join" not in plan


def test_signatures(spark):
    rng = random.Random(8)
    groups = {
        "leak": [2.0 + 0.5 * i for i in range(30)], "rounding": [rng.uniform(-0.9, 0.9) for _ in range(30)],
        "omission": [5.0 + rng.uniform(-0.5, 0.5) for _ in range(30)], "short": [5.0, 5.1],
        "wave": [0.8 * math.sin(i / 5) for i in range(30)], "tiny": [0.1, 0.5, 0.2],
    }
    out = series.classify_residuals(frame(spark, groups), ["g"], "w", "r", "tol", value_slice("w", 7.0), value_slice("r", 3.0), 0.05, 200, seed=5)
    got = {r["g"]: (r["signature"], r["refused"]) for r in out.collect()}
    assert got["leak"] == ("Leak", None) and got["rounding"] == ("Rounding", None)
    assert got["omission"] == ("StockOmission", None) and got["wave"] == ("Unexplained", None)
    assert got["short"] == (None, "trend") and got["tiny"] == (None, "successive-difference")


def test_exhaustive_equals_enumeration(spark):
    groups = {"a": [1, 2, 3, 4, 5], "b": [2, 5, 1, 4, 3], "c": [1, 1, 2, 3, 3]}
    out = series.successive_difference_test(frame(spark, groups), ["g"], "r", ["w"], value_slice("w", 2.0), value_slice("r", 2.0), 0.05, 120)
    stat = lambda p: -sum((b - a) ** 2 for a, b in zip(p, p[1:]))
    for r in out.collect():
        xs = groups[r["g"]]
        ranks = [2 * sum(y < x for y in xs) + xs.count(x) + 1 for x in xs]
        hits = sum(stat(p) >= stat(ranks) for p in itertools.permutations(ranks))
        assert r["dependent"] == (hits <= 0.05 * 120)


def test_verdicts(spark):
    rows = [("settled", i, float(i), 5.0, 10.0) for i in range(12)] + [("drifting", i, float(i), 5.0 * i, 10.0) for i in range(12)]
    rows += [("short", 0, 0.0, 1.0, 10.0), ("dead", 0, 0.0, 1.0, 0.0), ("dead", 1, 1.0, 1.0, 0.0), ("dead", 2, 2.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "loop string, i int, t double, x double, s double")
    criteria = [series.Criterion("slope", "drift", 3, 0.01, "x", "s")]
    stats = series.criterion_statistics(df, "loop", "t", ["i"], F.col("i"), criteria)
    out = {r["loop"]: (r["verdict"], r["exhausted"]) for r in series.exit_verdict(stats, "loop", floor=2, cap=12).collect()}
    assert out == {"settled": ("Converged", False), "drifting": ("Refused", True), "short": ("Refused", False), "dead": ("NotEvaluable", False)}
    with pytest.raises(Refusal):
        series.Criterion("slope", "drift", 1, 0.01, "x", "s")


def test_surrogates_keep_the_spectrum(spark):
    rows = [("ramp", i, float(i), float(i)) for i in range(32)] + [("noise", i, float(i), float((i * 7919) % 31)) for i in range(32)]
    df = spark.createDataFrame(rows, "loop string, i int, t double, x double")
    out = {r["loop"]: r for r in series.surrogate_drift(df, "loop", "t", "x", ["i"], F.lit(0), 32, 99).collect()}
    assert out["ramp"]["drift"] == pytest.approx(1.0) and out["ramp"]["exceeding"] <= 0.05
    assert out["noise"]["exceeding"] > 0.05


def test_offset_tail_is_exact_on_both_sides_of_any_length():
    import math
    from fractions import Fraction

    for n in (1, 2, 15, 16, 255, 4096, 4097, 6001):
        for k in {0, 1, n // 2, n // 2 + 1, (n + int(2 * n**0.5)) // 2, n}:
            exact = float(Fraction(2 * sum(math.comb(n, j) for j in range(k, n + 1)), 2**n))
            assert abs(series._offset_tail(n, k) - exact) <= 1e-12 * exact


def test_short_loops_are_returned(spark):
    rows = [(1, i, float(i % 3)) for i in range(20)] + [(2, i, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "loop bigint, t bigint, v double")
    got = {r.loop: r for r in series.surrogate_drift(df, "loop", "t", "v", ["t"], None, 16, 9).collect()}
    assert got[2].verdict == "NotEvaluable" and got[2].drift is None and got[1].verdict == "Evaluated"


def test_short_and_long_series_have_the_same_random_orders(spark, monkeypatch):
    """Series held as one row give the verdicts of those whose orders are rows, and no row per value and order."""
    rng = random.Random(8)
    rows = [(k, i, float(rng.randrange(9) if k % 2 else i)) for k in range(12) for i in range(9 + 3 * k)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v double")
    args = (["k"], "v", ["t"], series.FromData(), series.FromData(), 0.1, 40, 5)
    as_rows = []
    monkeypatch.setattr(series, "successive_difference", lambda d, *a, keep=series.successive_difference: as_rows.append(d) or keep(d, *a))
    short = series.successive_difference_test(df, *args)
    assert as_rows[0].isEmpty()
    short = sorted(map(tuple, short.collect()))
    monkeypatch.setattr(series, "LONG", 0)
    assert short == sorted(map(tuple, series.successive_difference_test(df, *args).collect()))
    assert len(short) == 12 and {r[2] for r in short} == {True, False}
