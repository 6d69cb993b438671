"""Mixing sources to target token weights by entropy balancing, with built-in functions.

Every document gets a rate w. Among all rates in [0, 2] whose token sums meet the target of each
source, the balance takes those nearest to 1 in entropy: minimise sum(w log w - w + 1). The dual has
one multiplier per source, and w = min(2, exp(lambda * size / mean size)). Newton steps on the dual
run over (source, size) cells, each a grouped sum; a document's rate depends on its cell alone.

Rates become copies cell by cell: a running sum over falling sizes is rounded, what a source is then
short of or over is settled in the largest cells that fit and by a part of one document, and a cell's
odd copies go to its documents in a hashed order, in slices of bounded size. Everything is a function of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.llm.common import WORD, row_key
from gridspark.session import settled

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
CLOSE = 1e-9
STEPS, ROUNDS = 5, 24
SLICE = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): weights by source order, caps at `most` sizes, excess reshared.

    One row per source; the water level is found from two sums a round.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    rows = settled(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")))
    level, budget = 0.0, None
    while True:
        full = F.col("cap") <= F.col("weight") * level
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not got["all"] or not got["free"]:
            level = float("inf") if got["all"] else 0.0
            break
        budget = share * got["all"]
        new = (budget - (got["capped"] or 0.0)) / got["free"]
        if new <= level:
            break
        level = new
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.col("weight") * level)
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def _near(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe keys, keeping the left names."""
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [a[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    out = a.join(right, on[0] if len(on) == 1 else on[0] & on[1] if len(on) == 2 else on[0] & on[1] & on[2], how)
    return out.drop(*[f"_r_{k}" for k in keys])


def _rate(most: int) -> Column:
    return F.when(F.col("full"), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0)))))


def balance(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, lambda, mean, full): the dual solution of each source, by guarded Newton steps.

    The token sum grows with lambda, so a step that leaves the bracket of known signs is replaced by
    halving (or doubling while the bracket is open). A source whose target is its cap takes the limit.
    """
    start = targets.filter("source_size > 0").select(
        "source", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), (F.col("target") >= most * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lambda"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("gap"))
    state = settled(start)
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            # The state has one row per source, so it rides along as grouping columns and a step is one join.
            now = _near(cells, state, ["source"])
            tokens, z = F.col("n") * F.col("size"), F.col("size") / F.col("mean")
            rate = _rate(most)
            s = now.groupBy(*start.columns).agg(F.sum(tokens * rate).alias("got"), F.sum(F.when(rate < most, tokens * z * rate).otherwise(0.0)).alias("slope"))
            off = F.col("got") - F.col("target")
            s = s.withColumn("gap", F.when(F.col("full"), 0.0).otherwise(F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))))
            s = s.withColumn("lo", F.when(off < 0, F.col("lambda")).otherwise(F.col("lo"))).withColumn("hi", F.when(off >= 0, F.col("lambda")).otherwise(F.col("hi")))
            step = F.col("lambda") - off / F.col("slope")
            inside = (F.col("slope") > 0) & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
            bounded = F.col("lo").isNotNull() & F.col("hi").isNotNull()
            other = F.when(bounded, (F.col("lo") + F.col("hi")) / 2).when(F.col("lo").isNotNull(), F.col("lo") * 2 + 1).otherwise(F.col("hi") * 2 - 1)
            # An open bracket may not be left by more than doubling, or one flat slope throws the step far out.
            wild = ~bounded & (F.abs(step) > F.abs(F.col("lambda")) * 4 + 4)
            s = s.withColumn("lambda", F.when((F.col("gap") <= CLOSE) | F.col("full"), F.col("lambda")).when(inside & ~wild, step).otherwise(other))
            state = s.select(*start.columns)
        state = settled(state)
        if state.filter(F.col("gap") > CLOSE).isEmpty():
            break
    return state.select("source", "lambda", "mean", "full")


def cell_copies(cells: DataFrame, solution: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, copies, part): whole copies of each cell, and what one document of it gives or lacks of a copy.

    After the loop every cell that could still change has larger documents than the words left over,
    so a part of one copy of one document settles the source.
    """
    rated = _near(cells.filter("size > 0"), solution, ["source"]).withColumn("want", F.col("n") * _rate(most))
    run = F.sum("want").over(W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0))
    upto = rated.withColumn("_run", run)
    copies = F.floor(F.col("_run") + 0.5) - F.floor(F.col("_run") - F.col("want") + 0.5)
    now = settled(upto.select("source", "size", "n", F.least(F.greatest(copies, F.lit(0)), most * F.col("n")).cast("long").alias("copies")))
    for _ in range(ROUNDS):
        open_ = _open_cells(now, targets, most).filter(F.col("size") <= F.abs("gap"))
        # The largest cells first, as many whole ones as fit, and as much of the next one as fits.
        whole = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        rest = F.abs("gap") - (F.sum(F.col("room") * F.col("size")).over(whole) - F.col("room") * F.col("size"))
        pick = open_.withColumn("fit", F.least(F.floor(rest / F.col("size")), F.col("room"))).filter("fit > 0")
        pick = settled(pick.select("source", "size", (F.signum("gap").cast("long") * F.col("fit")).alias("more")))
        if pick.isEmpty():
            break
        now = settled(_near(now, pick, ["source", "size"], "left").select("source", "size", "n", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies")))
    left = _open_cells(now, targets, most).filter("gap <> 0").groupBy("source").agg(F.min(F.struct("size", "gap")).alias("p"))
    left = settled(left.select("source", F.col("p.size").alias("size"), F.col("p.gap").alias("part")).filter(F.col("p.size") > F.abs("p.gap")))
    return _near(now, left, ["source", "size"], "left").withColumn("part", F.coalesce("part", F.lit(0)).cast("long"))


def _open_cells(now: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """The cells with room for what their source is short of (gap > 0) or over by (gap < 0)."""
    short = _near(now.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got")), targets.select("source", "target"), ["source"])
    short = short.select("source", (F.col("target") - F.col("got")).cast("long").alias("gap"))
    room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    return _near(now, short, ["source"]).withColumn("room", room).filter("room > 0")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows (doc_id, k, source, size, source_size, target, copies, taken): how often each document is taken.

    `k` is the row's key. `taken` is copies * size but for one document of a source, which is taken in part
    so that the source meets its target. A null text has size 0, is kept once and takes no words. A null source is a
    source, last in order. Null or repeated ids are ordinary rows: equal rows of one cell may differ in
    copies. Extra columns are left behind; an empty table gives an empty table.
    """
    sized = settled(docs.select("doc_id", row_key("doc_id", "text").alias("k"), "source", word_count(F.col("text")).alias("size")))
    cells = settled(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = settled(source_targets(sources, weights, share, most))
    copies = cell_copies(cells, balance(cells, targets, most), targets, most)
    facts = _near(_near(cells, copies.select("source", "size", "copies", "part"), ["source", "size"], "left"), targets.select("source", "source_size", "target"), ["source"])
    facts = facts.withColumn("copies", F.coalesce("copies", "n")).withColumn("part", F.coalesce("part", F.lit(0))).withColumn("slices", F.ceil(F.col("n") / SLICE))
    placed = _near(sized, facts, ["source", "size"]).withColumn("_h", F.xxhash64("doc_id", "k")).withColumn("_slice", F.pmod("_h", "slices"))
    counts = placed.groupBy("source", "size", "_slice").agg(F.count("*").alias("_m"), F.first("n").alias("n"), F.first("copies").alias("copies"), F.first("part").alias("part"))
    run = F.sum("_m").over(W.partitionBy("source", "size").orderBy("_slice").rowsBetween(W.unboundedPreceding, 0))
    odd = F.col("copies") % F.col("n")
    share_of = lambda c: F.floor(odd * c / F.col("n"))
    counts = counts.withColumn("_run", run).withColumn("_odd", share_of(F.col("_run")) - share_of(F.col("_run") - F.col("_m")))
    # The part goes to one document of the first slice that has one to take it from or to add it to.
    able = F.when(F.col("part") > 0, F.col("_odd") < F.col("_m")).otherwise((F.col("copies") >= F.col("n")) | (F.col("_odd") > 0))
    first = F.min(F.when(able, F.col("_slice"))).over(W.partitionBy("source", "size"))
    at = F.when(F.col("_slice") == first, F.when(F.col("part") > 0, F.col("_odd") + 1).otherwise(F.lit(1)))
    dealt = _near(placed, counts.select("source", "size", "_slice", "_odd", at.alias("_at")), ["source", "size", "_slice"])
    turn = F.row_number().over(W.partitionBy("source", "size", "_slice").orderBy("_h", "doc_id"))
    each = F.floor(F.col("copies") / F.col("n")) + F.when(turn <= F.col("_odd"), 1).otherwise(0)
    part = F.when(turn == F.col("_at"), F.col("part")).otherwise(0)
    return dealt.withColumn("_part", part).withColumn("copies", each.cast("long")).select(
        "doc_id", "k", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + F.col("_part")).alias("taken"))
