"""Statistics of many series at once: exit predicates, trend and permutation tests, skill."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.contracts import require
from gridspark.functions import nulls
from gridspark.functions.nulls import inversion_counts, trend_tail  # noqa: F401
from gridspark.operators.ordered import FromData, lagged, last_records, match, numbered, running_sum
from gridspark.session import settled

# Exit predicates over an iteration log


@dataclass(frozen=True)
class Criterion:
    """One exit criterion: `kind` drift, balance or straddle, over the last `span` records."""

    name: str
    kind: str
    span: int
    tolerance: float
    quantity: str
    divisor: str
    overshoot: str | None = None

    def __post_init__(self):
        least = {"drift": 2, "balance": 1, "straddle": 2}
        require(self.kind in least, self.name, "Criterion", f"{self.kind!r} is not a kind of criterion")
        require(self.span >= least[self.kind], self.name, "Criterion", f"a span of {self.span} is too short")


def criterion_statistics(records: DataFrame, loop: str, instant: str, order: Sequence[str], slice_by: Column | FromData | None,
                         criteria: Sequence[Criterion]) -> DataFrame:
    """One row per (loop, criterion): statistic, overshoot, divisor and verdict, all criteria in one pass.

    Only the last max(span) records of a loop are ever ordered; every statistic is then one
    conditional aggregate over those.
    """
    widest = max(c.span for c in criteria)
    counts = records.groupBy(loop).agg(F.count(F.lit(1)).alias("records"))
    recent = last_records(records, widest, order, slice_by, [loop])
    aggs = []
    for i, c in enumerate(criteria):
        near = F.col("back") <= c.span
        x, t = F.when(near, F.col(c.quantity)), F.when(near, F.col(instant))
        newest = F.col("back") == 1
        if c.kind == "drift":
            stat = F.abs(F.regr_slope(x, t))
        elif c.kind == "balance":
            stat = F.abs(F.avg(x))
        else:
            stat = F.abs(F.max(F.when(newest, x)) - F.max(F.when(F.col("back") == 2, x)))
        over = F.max(F.when(newest, F.abs(F.col(c.overshoot)))) if c.overshoot else F.lit(0.0)
        aggs += [stat.alias(f"_s{i}"), over.alias(f"_o{i}"), F.max(F.when(newest, F.col(c.divisor))).alias(f"_d{i}"),
                 F.sum((near & F.col(c.quantity).isNull()).cast("int")).alias(f"_u{i}")]
    wide = match(recent.groupBy(loop).agg(*aggs), counts, [loop])
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("criterion"), F.lit(c.kind).alias("kind"), F.lit(float(c.tolerance)).alias("tolerance"),
                 F.lit(c.span).alias("span"), F.col(f"_s{i}").alias("raw"), F.col(f"_o{i}").alias("over"),
                 F.col(f"_d{i}").alias("divisor"), (F.col(f"_u{i}") == 0).alias("sampled"))
        for i, c in enumerate(criteria)])
    tall = wide.select(loop, "records", F.explode(rows).alias("c")).select(loop, "records", "c.*")
    usable = (F.col("records") >= F.col("span")) & F.col("sampled") & (F.col("divisor") > 0)
    stat, over = F.col("raw") / F.col("divisor"), F.col("over") / F.col("divisor")
    passed = (stat <= F.col("tolerance")) & (over <= F.col("tolerance"))
    verdict = (
        F.when(~F.coalesce(usable, F.lit(False)), "NotEvaluable")
        .when(F.coalesce(passed, F.lit(False)), F.when(F.col("kind") == "straddle", "Bracketed").otherwise("Converged"))
        .otherwise("Refused"))
    ok = F.coalesce(usable, F.lit(False))
    return tall.select(loop, "records", "criterion", "tolerance", F.when(ok, stat).alias("statistic"),
                       F.when(ok, over).alias("overshoot"), verdict.alias("verdict"))


def exit_verdict(statistics: DataFrame, loop: str, floor: int, cap: int, bracketing: bool = False) -> DataFrame:
    """One verdict per loop: refused below the floor; any unevaluable criterion, then any refused one,
    decides; otherwise the loop passes. A loop at its cap that does not pass has spent its budget."""
    none, no = F.max((F.col("verdict") == "NotEvaluable").cast("int")), F.max((F.col("verdict") == "Refused").cast("int"))
    out = statistics.groupBy(loop).agg(F.max("records").alias("records"), none.alias("_n"), no.alias("_r"))
    verdict = (
        F.when(F.col("records") < floor, "Refused").when(F.col("_n") == 1, "NotEvaluable")
        .when(F.col("_r") == 1, "Refused").otherwise("Bracketed" if bracketing else "Converged"))
    out = out.withColumn("verdict", verdict).withColumn(
        "exhausted", (F.col("records") >= cap) & ~F.col("verdict").isin("Converged", "Bracketed"))
    return out.drop("_n", "_r")


def final_report(records: DataFrame, loop: str, instant: str, order: Sequence[str], slice_by: Column | FromData | None,
                 criteria: Sequence[Criterion], level: str, finest: int, floor: int, cap: int, cost: str, scale: str) -> DataFrame:
    """Every loop re-evaluated on its records at the finest level, with the cost fraction of an open loop."""
    kept = records.filter(F.col(level) == finest)
    verdicts = exit_verdict(criterion_statistics(kept, loop, instant, order, slice_by, criteria), loop, floor, cap)
    last = kept.groupBy(loop).agg(F.max_by(F.struct(cost, scale), F.struct(*order)).alias("_l"))
    fraction = F.when(F.col(f"_l.{scale}") > 0, F.abs(F.col(f"_l.{cost}")) / F.col(f"_l.{scale}"))
    return match(verdicts, last, [loop]).withColumn("open_cost", fraction).drop("_l")


# Ranks and trend

LONG = 4096     # values of a series that are held as one row, a power of two
CHUNK = 1 << 20  # values that are scored in one array pass


def doubled_midranks(df: DataFrame, keys: Sequence[str], value: str, slice_by: Column, name: str = "rank2") -> DataFrame:
    """2 * (values below) + (values equal) + 1 within each series; ties are counted once per distinct value."""
    tied = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    below = running_sum(tied, "_t", [value], slice_by, keys, "_upto")
    ranks = below.select(*keys, value, (2 * (F.col("_upto") - F.col("_t")) + F.col("_t") + 1).alias(name))
    return match(df, ranks, [*keys, value])


def successive_difference(df: DataFrame, keys: Sequence[str], rank: str, order: Sequence[str], slice_by: Column | FromData | None,
                          name: str = "statistic") -> DataFrame:
    """-sum of squared steps of the ranks along the series."""
    steps = lagged(df, {"_prev_rank": rank}, order, slice_by, keys)
    step = F.coalesce(F.col(rank) - F.col("_prev_rank"), F.lit(0))
    return steps.groupBy(*keys).agg((-F.sum(step * step)).alias(name))


def _long_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of series of more than LONG values, which are few; None without any."""
    found = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LONG).select(*keys))
    return None if found.isEmpty() else found


def _in_order(order: Sequence[str], rank: str) -> Column:
    """The ranks of a short series along its order, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(rank).alias("r")))), lambda x: x["r"])


def _scored(series: Sequence[np.ndarray]) -> tuple[np.ndarray, list[nulls.Ties]]:
    """The Kendall score and the sizes of ties of each of many series, all in one pass over their ranks.

    Positions are split by binary digits as in `kendall_score`: rows stay sorted by (block, rank) as blocks are halved.
    """
    sizes = np.fromiter((len(x) for x in series), dtype=np.int64, count=len(series))
    begin = np.cumsum(sizes) - sizes
    which, n = np.repeat(np.arange(len(sizes)), sizes), int(sizes.sum())
    p, rank = np.arange(n) - begin[which], np.concatenate(series)
    by = np.lexsort((rank, which))
    p, rank = p[by], rank[by]
    fresh = lambda new: np.concatenate(([True], new))
    tied = np.flatnonzero(fresh((which[1:] != which[:-1]) | (rank[1:] != rank[:-1])))
    pairs, times = np.unique(np.stack([which[tied], np.diff(tied, append=n)]), axis=1, return_counts=True)
    ties: list[list] = [[] for _ in sizes]
    for k, size, t in zip(pairs[0].tolist(), pairs[1].tolist(), times.tolist()):
        ties[k].append((size, t))
    scores = np.zeros(len(sizes), dtype=np.int64)
    for digit in range(int(sizes.max() - 1).bit_length() - 1, -1, -1):
        block = p >> (digit + 1)
        new = fresh((which[1:] != which[:-1]) | (block[1:] != block[:-1]))
        tie = new | fresh(rank[1:] != rank[:-1])
        b, t = np.flatnonzero(new), np.flatnonzero(tie)
        in_b, in_t = np.cumsum(new) - 1, np.cumsum(tie) - 1
        left = ((p >> digit) & 1) == 0
        upto = np.concatenate(([0], np.cumsum(left)))  # rows of the left halves before each row
        first, every = upto[b][in_b], np.diff(upto[np.append(b, n)])[in_b]
        below, reached = upto[t][in_t] - first, upto[np.append(t[1:], n)][in_t] - first
        scores += np.add.reduceat(np.where(left, 0, below + reached - every), begin)
        lefts = upto[:-1] - first
        to = b[in_b] + np.where(left, lefts, every + np.arange(n) - b[in_b] - lefts)
        p[to], rank[to] = p.copy(), rank.copy()
    return scores, [tuple(x) for x in ties]


def _scored_in_chunks(series: Sequence[np.ndarray]) -> tuple[np.ndarray, list[nulls.Ties]]:
    scores, ties, lo = [np.zeros(0, dtype=np.int64)], [], 0
    while lo < len(series):
        hi, n = lo + 1, len(series[lo])
        while hi < len(series) and n + len(series[hi]) <= CHUNK:
            n, hi = n + len(series[hi]), hi + 1
        part = _scored(series[lo:hi])
        scores.append(part[0])
        ties += part[1]
        lo = hi
    return np.concatenate(scores), ties


def _score_udf():
    @F.pandas_udf("bigint")
    def score(ranks: pd.Series) -> pd.Series:
        return pd.Series(_scored_in_chunks(list(ranks))[0])

    return score


def kendall_score(df: DataFrame, keys: Sequence[str], rank: str, order: Sequence[str], slice_by: Column | FromData | None,
                  rank_width: int = 1 << 16, name: str = "score") -> DataFrame:
    """Increasing pairs less decreasing pairs of each series, without forming pairs.

    Positions are split by their binary digits: two positions first differ at exactly one digit, so
    summing over digits the comparisons between the halves of every block counts each pair once.
    A series of at most LONG values is one row, and its digits are passes over an array; so are the low digits
    of longer ones. Each higher digit is one row per position and one running count along the ranks of each block.
    """
    keys = list(keys)
    # Written, as it is read several times.
    rows = settled(df.select(*keys, rank, *[c for c in order if c not in (*keys, rank)]))
    hot = _long_keys(rows, keys)
    short = rows if hot is None else match(rows, hot, keys, "left_anti")
    packed = short.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _in_order(order, rank).alias("_r"))
    out = packed.select(*keys, "n", _score_udf()("_r").alias(name))
    return out if hot is None else out.unionByName(_long_scores(match(rows, hot, keys, "left_semi"), keys, rank, order, slice_by, rank_width, name))


def _long_scores(rows: DataFrame, keys: list[str], rank: str, order: Sequence[str], slice_by: Column | FromData | None, rank_width: int, name: str) -> DataFrame:
    """`kendall_score` of series of more than LONG values."""
    low = LONG.bit_length() - 1
    placed = settled(numbered(rows, order, slice_by, keys, "_p", 0).select(*keys, rank, "_p"))
    n = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    inside = placed.groupBy(*keys, F.call_function("shiftright", F.col("_p"), F.lit(low)).alias("_block")).agg(_in_order(["_p"], rank).alias("_r"))
    levels = F.sequence(F.lit(low), F.greatest(F.lit(low), F.ceil(F.log2(F.col("n").cast("double"))).cast("int") - 1))
    split = (
        match(placed, n, keys)
        .select(*keys, rank, "_p", F.explode(levels).alias("_lv"))
        .withColumn("_half", F.call_function("shiftright", F.col("_p"), F.col("_lv")))
        .select(*keys, rank, "_lv", F.floor(F.col("_half") / 2).cast("bigint").alias("_block"), (F.col("_half") % 2).alias("_side"))
    )
    group = [*keys, "_lv", "_block"]
    counted = split.groupBy(*group, rank).agg(
        F.sum(1 - F.col("_side")).alias("_left"), F.sum("_side").alias("_right"))
    lefts = counted.groupBy(*group).agg(F.sum("_left").alias("_all"))
    ran = running_sum(counted, "_left", [rank], F.floor(F.col(rank) / rank_width).cast("bigint"), group, "_upto")
    term = F.col("_right") * (2 * F.col("_upto") - F.col("_left") - F.col("_all"))
    between = match(ran, lefts, group).select(*keys, term.cast("bigint").alias("_s"))
    scores = between.unionByName(inside.select(*keys, _score_udf()("_r").alias("_s"))).groupBy(*keys).agg(F.sum("_s").alias(name))
    return match(n, scores, keys)


def exchangeable_minimum_length(false_alarm: float) -> int:
    a, n = Fraction(false_alarm), 2
    while math.factorial(n) * a < 2:
        n += 1
    return n


def offset_minimum_length(false_alarm: float) -> int:
    a, n = Fraction(false_alarm), 1
    while 2**n * a < 2:
        n += 1
    return n


def random_permutation_minimum(false_alarm: float) -> int:
    return math.ceil(1 / Fraction(false_alarm))


def _trend_udf(false_alarm: float):
    @F.pandas_udf("p_trend double, trend boolean")
    def judged(score: pd.Series, ties: pd.Series) -> pd.DataFrame:
        keys = [nulls.tie_key(t) for t in ties]
        return pd.DataFrame({
            "p_trend": [nulls.trend_p(abs(int(s)), k)[0] for s, k in zip(score, keys)],
            "trend": [nulls.trend_rejects(int(s), k, false_alarm) for s, k in zip(score, keys)]})

    return judged


def _short_trend_udf(false_alarm: float):
    @F.pandas_udf("score bigint, p_trend double, trend boolean")
    def judged(ranks: pd.Series) -> pd.DataFrame:
        scores, ties = _scored_in_chunks(list(ranks))
        return pd.DataFrame({
            "score": scores, "p_trend": [nulls.trend_p(abs(int(s)), k)[0] for s, k in zip(scores, ties)],
            "trend": [nulls.trend_rejects(int(s), k, false_alarm) for s, k in zip(scores, ties)]})

    return judged


def tie_sizes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each multiplicity occurs among a series' values: one entry per (size, how many values have it).

    Different sizes of n values number some sqrt(2 n) at most, so the array is short however long the series.
    """
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_m"))
    return per.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_t").alias("size"), F.col("_m").alias("times"))).alias("ties"))


def trend_test(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], slice_by: Column | FromData | None,
               value_slice: Column | FromData | None, false_alarm: float) -> DataFrame:
    """Kendall score of each series, its two-sided tail, and whether that is at or under `false_alarm`.

    `trend` is null where the series is too short for any ordering to be that unlikely. A series of at most LONG
    values is dealt out once, ranked by a window and judged as one row.
    """
    keys = list(keys)
    rows = df.select(*dict.fromkeys([*keys, value, *order]))
    hot = _long_keys(rows, keys)
    short = rows if hot is None else match(rows, hot, keys, "left_anti")
    ranks = short.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)))
    packed = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _in_order(order, "_r").alias("_r"))
    out = packed.withColumn("_t", _short_trend_udf(false_alarm)("_r")).select(*keys, "n", "_t.*")
    if hot is not None:
        long = settled(match(rows, hot, keys, "left_semi"))
        scores = kendall_score(doubled_midranks(long, keys, value, value_slice), keys, "rank2", order, slice_by)
        both = match(scores, tie_sizes(long, keys, value), keys).withColumn("_t", _trend_udf(false_alarm)("score", "ties"))
        out = out.unionByName(both.select(*keys, "n", "score", "_t.*"))
    need = exchangeable_minimum_length(false_alarm)
    return out.select(*keys, "n", "score", "p_trend", F.when(F.col("n") >= need, F.col("trend")).alias("trend"))


def _exhaustive_udf():
    @F.pandas_udf("bigint")
    def hits(ranks: pd.Series) -> pd.Series:
        def one(r):
            r = [int(x) for x in r]
            stat = lambda p: -sum((b - a) ** 2 for a, b in zip(p, p[1:]))
            seen = stat(r)
            return sum(stat(p) >= seen for p in itertools.permutations(r))

        return ranks.map(one)

    return hits


def successive_difference_test(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], slice_by: Column | FromData | None,
                               value_slice: Column | FromData | None, false_alarm: float, permutations: int, seed: int = 0) -> DataFrame:
    """Whether ranks move less between neighbours than reorderings do, per series.

    With n! <= permutations every ordering of the (at most a dozen) values is tried; otherwise
    `permutations - 1` random orders, each a sort of the series by a random word that is a pure
    function of (seed, series, permutation, position). A series of at most LONG values is one row and its
    orders are sorts of its array. The random orders of longer ones are ordinary rows: they are sorted in
    slices of the word, so neither a long series nor a hot one meets in one task.
    """
    keys = list(keys)
    few = max(n for n in range(1, 14) if math.factorial(n) <= permutations)
    ranked = settled(numbered(settled(doubled_midranks(df, keys, value, value_slice)), order, slice_by, keys, "_p", 1))
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = match(ranked.select(*keys, "rank2", "_p"), sizes, keys)

    tiny = rows.filter(F.col("n") <= few).groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "rank2"))), lambda s: s["rank2"]).alias("_r"))
    total = F.factorial(F.col("n").cast("int")).cast("double")
    shortest = exchangeable_minimum_length(false_alarm)
    exact = tiny.select(*keys, "n", F.when(F.col("n") >= shortest, _exhaustive_udf()("_r") <= F.lit(false_alarm) * total).alias("dependent"))

    enough = permutations >= random_permutation_minimum(false_alarm)
    verdict = F.when(F.lit(enough), F.col("_d") <= F.lit(false_alarm * permutations)).alias("dependent")
    word = lambda perm, p: F.when(perm == 0, p).otherwise(F.xxhash64(F.lit(seed), *keys, perm, p))

    # a series of at most LONG values is one row, and its random orders are sorts of its array
    short = rows.filter((F.col("n") > few) & (F.col("n") <= LONG)).groupBy(*keys, "n").agg(F.collect_list(F.struct("_p", "rank2")).alias("_r"))

    def statistic(perm: Column) -> Column:
        put = F.sort_array(F.transform("_r", lambda x: F.struct(word(perm, x["_p"]).alias("w"), x["_p"].alias("p"), x["rank2"].alias("r"))))
        start = F.struct(F.lit(None).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("s"))

        def step(a, x):
            d = F.coalesce(x["r"].cast("bigint") - a["r"], F.lit(0).cast("bigint"))
            return F.struct(x["r"].cast("bigint").alias("r"), (a["s"] - d * d).alias("s"))

        return F.aggregate(put, start, step, lambda a: a["s"])

    tried = short.select(*keys, "n", F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), statistic).alias("_s"))
    short_out = tried.withColumn("_d", F.size(F.filter("_s", lambda s: s >= F.get("_s", F.lit(0))))).select(*keys, "n", verdict)

    many = rows.filter(F.col("n") > LONG)
    drawn = many.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    drawn = drawn.withColumn("_w", word(F.col("_perm"), F.col("_p")))
    # the series' own order keeps its positions; random words are spread over 64 slices
    cut = F.when(F.col("_perm") == 0, F.floor(F.col("_p") / 65536)).otherwise(F.shiftright("_w", 58)).cast("bigint")
    stats = successive_difference(drawn.select(*keys, "_perm", "_w", "_p", "rank2"), [*keys, "_perm"], "rank2", ["_w", "_p"], cut)
    seen = stats.filter("_perm = 0").select(*keys, F.col("statistic").alias("_seen"))
    against = match(stats, seen, keys)
    random = against.groupBy(*keys).agg(F.sum((F.col("statistic") >= F.col("_seen")).cast("bigint")).alias("_d"))
    drawn_out = match(random, sizes, keys).select(*keys, "n", verdict)
    return exact.unionByName(short_out).unionByName(drawn_out)


def offset_counts(df: DataFrame, keys: Sequence[str], residual: str, tolerance: str) -> DataFrame:
    r, t = F.col(residual), F.col(tolerance)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((r > t).cast("bigint")).alias("above"), F.sum((r < -t).cast("bigint")).alias("below"),
        F.bool_and(F.abs(r) <= t).alias("within"))


def _offset_tail(n: int, k: int) -> float:
    """2 * P(at least k of n fair signs agree), correctly rounded at every length."""
    return float(nulls.fair_tail(n, k))


def _offset_udf(false_alarm: float):
    @F.pandas_udf("p_offset double, offset boolean")
    def judged(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        pairs = [(int(a), int(b)) for a, b in zip(n, k)]
        return pd.DataFrame({"p_offset": [_offset_tail(*x) for x in pairs], "offset": [nulls.offset_rejects(*x, false_alarm) for x in pairs]})

    return judged


def offset_test(df: DataFrame, keys: Sequence[str], residual: str, tolerance: str, false_alarm: float) -> DataFrame:
    """Whether more residuals lie beyond their tolerance on one side than fair signs allow."""
    counts = offset_counts(df, keys, residual, tolerance)
    judged = counts.withColumn("_o", _offset_udf(false_alarm)("n", F.greatest("above", "below")))
    need = offset_minimum_length(false_alarm)
    return judged.select(*counts.columns, F.col("_o.p_offset").alias("p_offset"), F.when(F.col("n") >= need, F.col("_o.offset")).alias("offset"))


def classify_residuals(df: DataFrame, keys: Sequence[str], window: str, residual: str, tolerance: str,
                       slice_by: Column | FromData | None, residual_slice: Column | FromData | None, false_alarm: float, permutations: int,
                       seed: int = 0) -> DataFrame:
    """Leak, StockOmission, Rounding or Unexplained for every residual series.

    Within tolerance throughout: Rounding, or Unexplained when neighbours are dependent. Otherwise a
    trend is a Leak; dependence without trend is Unexplained; a one-sided offset is a StockOmission.
    `refused` names the first test reached that the series is too short for.
    """
    keys = list(keys)
    base = df.select(*keys, window, residual, tolerance)
    trend = trend_test(base, keys, residual, [window], slice_by, residual_slice, false_alarm)
    dep = successive_difference_test(base, keys, residual, [window], slice_by, residual_slice, false_alarm, permutations, seed)
    off = offset_test(base, keys, residual, tolerance, false_alarm)
    both = match(match(off, trend.select(*keys, "score", "trend"), keys), dep.select(*keys, "dependent"), keys)
    within, t, d, o = F.col("within"), F.col("trend"), F.col("dependent"), F.col("offset")
    signature = (
        F.when(within & d, "Unexplained").when(within & ~d, "Rounding").when(within, None)
        .when(t, "Leak").when(t.isNull(), None).when(d, "Unexplained").when(d.isNull(), None)
        .when(o, "StockOmission").when(o.isNull(), None).otherwise("Unexplained"))
    refused = (
        F.when(within & d.isNull(), "successive-difference").when(within, None).when(t.isNull(), "trend").when(t, None)
        .when(d.isNull(), "successive-difference").when(d, None).when(o.isNull(), "offset"))
    return both.select(*keys, "n", "score", "above", "below", signature.alias("signature"), refused.alias("refused"))


# Surrogates


def _surrogate_udf(seed: int):
    @F.pandas_udf("double")
    def drift(values: pd.Series, instants: pd.Series, key: pd.Series, surrogate: pd.Series) -> pd.Series:
        out = []
        for v, t, k, s in zip(values, instants, key, surrogate):
            v, t = np.asarray(v, float), np.asarray(t, float)
            if s > 0:
                n = len(v)
                spectrum = np.fft.rfft(v)
                free = (n + 1) // 2 - 1  # frequencies with a phase: not the mean, not the fold
                rng = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(k) & (2**64 - 1)], counter=[0, 0, 0, int(s)]))
                spectrum[1 : free + 1] *= np.exp(2j * np.pi * rng.random(free))
                v = np.fft.irfft(spectrum, n)
            d = t - t.mean()
            out.append(abs(float(d @ (v - v.mean()) / (d @ d))))
        return pd.Series(out)

    return drift


def surrogate_drift(records: DataFrame, loop: str, instant: str, value: str, order: Sequence[str], slice_by: Column | FromData | None,
                    span: int, surrogates: int, seed: int = 0) -> DataFrame:
    """Share of phase-randomised copies of the last `span` records that drift more than the record does.

    A copy is a row; its arrays hold `span` numbers whatever the length of the log. A loop with fewer
    records is returned as NotEvaluable, without numbers.
    """
    recent = last_records(records, span, order, slice_by, [loop])
    packed = recent.groupBy(loop).agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), F.col(instant).alias("t"),
                                                                           F.col(value).alias("v")))).alias("_a"))
    short = packed.filter(F.size("_a") < span).select(loop, F.lit(None).cast("double").alias("drift"), F.lit(None).cast("double").alias("exceeding"), F.lit("NotEvaluable").alias("verdict"))
    packed = packed.filter(F.size("_a") == span)
    rows = packed.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(surrogates))))
    drift = _surrogate_udf(seed)(F.transform("_a", lambda s: s["v"]), F.transform("_a", lambda s: s["t"]), F.xxhash64(loop), "surrogate")
    drifts = rows.select(loop, "surrogate", drift.alias("drift"))
    own = drifts.filter("surrogate = 0").select(loop, F.col("drift").alias("_own"))
    judged = match(drifts, own, [loop]).groupBy(loop).agg(
        F.max("_own").alias("drift"),
        (F.sum(((F.col("surrogate") > 0) & (F.col("drift") > F.col("_own"))).cast("bigint")) / F.lit(surrogates)).alias("exceeding"))
    return judged.withColumn("verdict", F.lit("Evaluated")).unionByName(short)


# Skill of a model column against an observed column


def skill(df: DataFrame, keys: Sequence[str], model: str, observed: str) -> DataFrame:
    """Bias, RMS, log-log exponent, and whether the residual scatter is below the observed scatter."""
    m, o = F.col(model), F.col(observed)
    positive = (m > 0) & (o > 0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m - o).alias("bias"), F.sqrt(F.avg((m - o) * (m - o))).alias("rms"),
        F.regr_slope(F.when(positive, F.log(m)), F.when(positive, F.log(o))).alias("exponent"),
        (F.stddev_samp(m - o) < F.stddev_samp(o)).alias("scatter_below_observed"))


def log_ratio(model: Column, observed: Column) -> Column:
    return F.abs(F.log10(model / observed))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement beyond chance of two labels, from their confusion matrix (classes squared rows)."""
    cells_ = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    n = cells_.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("agree"))
    rows = cells_.groupBy(F.col(a).alias("k")).agg(F.sum("c").alias("ra"))
    cols = cells_.groupBy(F.col(b).alias("k")).agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("ra") * F.col("cb")))
    po = F.col("agree") / F.col("n")
    pe = F.coalesce(F.col("by_chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    return n.withColumn("by_chance", chance.scalar()).select("n", po.alias("observed"), ((po - pe) / (1 - pe)).alias("kappa"))
