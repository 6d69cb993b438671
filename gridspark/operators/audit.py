"""Registry, lineage and declaration audits: every check returns all its problems as rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import partial, reduce as fold
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions import numeric
from gridspark.operators.graph import degrees, levels_by_degree, lineage_levels, lineage_runs, strong_parts
from gridspark.operators.ordered import FromData, lagged, last_known, match
from gridspark.session import settled, shared_dir

# The closed sets of a registry row.
TIERS = (1, 2, 3)
VERDICT_KINDS = ("fail_bar", "report")
COMMIT_ID = "^[0-9a-f]{40}$"


def rule_check(rows: DataFrame, required: Sequence[str], source_kinds: Sequence[str]) -> DataFrame:
    """(site, reason) for every rule a registry row breaks; rows are never skipped after a first problem.

    An absent tier, source_kind or verdict_kind is outside its closed set, and absent anchors are none.
    """
    c = F.col
    absent_or = lambda broken: F.coalesce(broken, F.lit(True))
    tier1 = (c("tier") == 1) & F.startswith("id", F.lit("system.")) & (F.coalesce(F.size("instances"), F.lit(0)) <= 0)
    rules = [*[(c(k).isNull(), f"carries no {k}") for k in required],
             (absent_or(~c("tier").isin(*TIERS)), "tier is outside the closed set"),
             (absent_or(~c("source_kind").isin(*source_kinds)), "source_kind is outside the closed set"),
             (absent_or(~c("verdict_kind").isin(*VERDICT_KINDS)), "verdict_kind is outside the closed set"),
             ((c("registered_at") != "") & ~c("registered_at").rlike(COMMIT_ID), "registered_at is no commit id"),
             (tier1, "a tier 1 system entry names no instances"),
             ((c("tier") == 3) & c("protocol").isNull(), "a tier 3 entry names no protocol"),
             (c("tier").isin(2, 3) & (F.coalesce(F.size("anchors"), F.lit(0)) <= 0), "a tier 2 or 3 entry with no anchors"),
             (c("bar_half_width").isNull() != c("observation_uncertainty").isNull(), "bar and uncertainty are not stated together"),
             (c("bar_half_width") <= 0, "bar_half_width is not positive"),
             (c("observation_uncertainty") <= 0, "observation_uncertainty is not positive"),
             (c("bar_half_width") < c("observation_uncertainty"), "a bar narrower than its uncertainty")]
    found = F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for broken, reason in rules]))
    return rows.select(c("id").alias("site"), F.explode(found).alias("reason"))


def sorted_problems(problems: DataFrame) -> DataFrame:
    return problems.orderBy("site", "reason")


def judge(results: DataFrame, registry: DataFrame, id_: str = "id") -> DataFrame:
    """REPORT, PASS or FAIL from value, reference and bar, and the distance in units of the uncertainty."""
    both = results.join(registry, id_)
    distance = F.abs(F.col("value") - F.col("reference"))
    barred = (F.col("verdict_kind") != "report") & F.col("bar_half_width").isNotNull()
    verdict = F.when(~barred, "REPORT").when(distance <= F.col("bar_half_width"), "PASS").otherwise("FAIL")
    return both.select(id_, "value", "reference", distance.alias("distance"), (distance / F.col("observation_uncertainty")).alias("in_uncertainty"),
                       verdict.alias("verdict"))


def distance_report(judged: DataFrame, id_: str = "id") -> DataFrame:
    """One printable line per result."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    return judged.select(id_, F.concat_ws("  ", F.col(id_).cast("string"), text("value"), text("reference"), text("in_uncertainty"), "verdict").alias("line"))


def admissible(results: DataFrame, versions: DataFrame, id_: str, at: str, order: Sequence[str], fixed: Sequence[str], slice_by: Column | FromData | None) -> DataFrame:
    """A result may be shown only where its row was registered before it, with today's fixed fields.

    `versions` carries `at` (the instant of a version); `order` breaks ties between versions of one instant.
    """
    fields = F.struct(*fixed)
    today = versions.groupBy(id_).agg(F.max_by(fields, F.struct(at, *order)).alias("_today"))
    marks = versions.select(id_, F.col(at).alias("_t"), F.lit(0).alias("_side"), fields.alias("_then"), *order)
    asked = results.select(id_, F.col(at).alias("_t")).distinct().withColumn("_side", F.lit(1))
    line = marks.unionByName(asked, allowMissingColumns=True)
    then = last_known(line, "_then", ["_t", "_side", *order], slice_by, [id_], "_held").filter("_side = 1").select(id_, "_t", "_held")
    both = match(match(results.withColumn("_t", F.col(at)), then, [id_, "_t"], "left"), today, [id_], "left")
    return both.withColumn("admissible", F.coalesce(F.col("_held") == F.col("_today"), F.lit(False))).drop("_t", "_held", "_today")


def history_problems(versions: DataFrame, touched: DataFrame, exceptions: DataFrame, order: Sequence[str], slice_by: Column | FromData | None) -> DataFrame:
    """(id, merge, reason): thresholds changed together with code, bars set after a report, stale exceptions.

    `versions` is (id, merge, threshold, verdict_kind, order...), `touched` is (merge, path), `exceptions` is (merge, id).
    """
    steps = lagged(versions, {"_threshold": "threshold", "_kind": "verdict_kind", "_merge": "merge"}, order, slice_by, ["id"]).filter(
        F.col("_merge").isNotNull())
    moves, bars = F.col("threshold") != F.col("_threshold"), (F.col("_kind") == "report") & (F.col("verdict_kind") == "fail_bar")
    # written once, since two of the reasons read the order
    steps = settled(steps.select("id", "merge", moves.alias("moves"), bars.alias("bars")).filter("moves OR bars"))
    code = touched.filter(F.startswith("path", F.lit("src/"))).select("merge").distinct()
    moved = settled(steps.filter("moves").select("id", "merge").distinct().join(code, "merge", "left_semi").select("id", "merge"))
    held = exceptions.select("id", "merge").distinct()
    return (
        moved.join(held, ["id", "merge"], "left_anti").withColumn("reason", F.lit("threshold changes together with code"))
        .unionByName(steps.filter("bars").select("id", "merge").distinct().withColumn("reason", F.lit("a bar set after a report")))
        .unionByName(held.join(moved, ["id", "merge"], "left_anti").withColumn("reason", F.lit("a stale exception"))))


def declaration_problems(declarations: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """(quantity, reason) from (component, quantity, role): several writers, reads nobody writes, writes nobody reads."""
    roles = declarations.select("component", "quantity", "role").distinct().groupBy("quantity").agg(
        F.sum((F.col("role") == "write").cast("int")).alias("w"), F.sum((F.col("role") == "read").cast("int")).alias("r"))
    found = F.array_compact(F.array(F.when(F.col("w") > 1, "several writers"), F.when(F.col("w") == 0, "read, never written"),
                                    F.when(F.col("r") == 0, "written, never read")))
    out = roles.select("quantity", F.explode(found).alias("reason"))
    if stocks is None:
        return out
    known = declarations.select("quantity").distinct()
    return out.unionByName(stocks.select("quantity").distinct().join(known, "quantity", "left_anti").withColumn("reason", F.lit("an undeclared stock")))


# Paths are arrays of steps; the step ':' stands for any element. The first step is always a name,
# which is the equi-join key, so no pair of unrelated paths is ever formed.
WILD = ":"


def _steps_agree(a: Column, b: Column) -> Column:
    """Whether two paths agree on every step they share."""
    n = F.least(F.size(a), F.size(b))
    return F.forall(F.arrays_zip(F.slice(a, F.lit(1), n).alias("x"), F.slice(b, F.lit(1), n).alias("y")),
                    lambda p: (p["x"] == p["y"]) | (p["x"] == WILD) | (p["y"] == WILD))


def _literal(path: Column) -> Column:
    """The steps before the first wildcard."""
    wild = F.array_position(path, F.lit(WILD)).cast("int")
    return F.slice(path, F.lit(1), F.when(wild > 0, wild - 1).otherwise(F.size(path)))


def _prefixes(literal: Column, proper: bool = False) -> Column:
    """Every prefix of the steps, the empty one included."""
    most = F.size(literal) - (1 if proper else 0)
    return F.when(most >= 0, F.transform(F.sequence(F.lit(0), most), lambda n: F.slice(literal, F.lit(1), n))).otherwise(F.array())


def affected(declared: DataFrame, changes: DataFrame) -> DataFrame:
    """(change, name): names one of whose declared paths overlaps a changed path.

    Paths overlap only if the steps before the first wildcard of one begin those of the other, so each
    side is joined whole with the prefixes of the other: a first step that many paths share is no join
    key unless a wildcard follows it. Paths that begin with a wildcard meet all others.
    """
    d = declared.select("name", "path", _literal(F.col("path")).alias("_l")).distinct()
    c = changes.select(F.col("path").alias("change"), _literal(F.col("path")).alias("_l")).distinct()
    below = c.select("change", F.col("_l").alias("_k")).join(d.select("name", "path", F.explode(_prefixes(F.col("_l"))).alias("_k")), "_k")
    above = c.select("change", F.explode(_prefixes(F.col("_l"), proper=True)).alias("_k")).join(d.select("name", "path", F.col("_l").alias("_k")), "_k")
    return below.unionByName(above).filter(_steps_agree(F.col("path"), F.col("change"))).select("change", "name").distinct()


def _covers(declared: Column, read: Column) -> Column:
    n = F.least(F.size(declared), F.size(read))
    steps = F.forall(F.arrays_zip(F.slice(declared, F.lit(1), n).alias("x"), F.slice(read, F.lit(1), n).alias("y")),
                     lambda p: (p["x"] == p["y"]) | (p["x"] == WILD))
    return steps & ((F.size(declared) <= F.size(read)) | (F.element_at(read, -1) == WILD))


def dependency_subset(reads: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, path, problem): reads no declared path covers, and declared paths no read reaches."""
    r = reads.select("name", F.col("path").alias("read"), F.element_at("path", 1).alias("_k")).distinct()
    d = declared.select("name", F.col("path").alias("decl"), F.element_at("path", 1).alias("_k")).distinct()
    ok = r.join(d, ["name", "_k"]).filter(_covers(F.col("decl"), F.col("read")))
    undeclared = r.join(ok.select("name", "read").distinct(), ["name", "read"], "left_anti")
    reached = ok.filter(F.size("decl") <= F.size("read")).select("name", "decl").distinct()
    unread = d.join(reached, ["name", "decl"], "left_anti")
    return undeclared.select("name", F.col("read").alias("path"), F.lit("undeclared").alias("problem")).unionByName(
        unread.select("name", F.col("decl").alias("path"), F.lit("unread").alias("problem")))


FEW = 256         # inputs of a name that are folded in one row
WIDTHS = (9, 6, 3)  # prefixes of digests that are folded one after the other, before the whole


def _text(digest: Column) -> Column:
    """A digest as it is hashed and returned; it is moved and written as bytes."""
    return F.lower(F.hex(digest))


def _folded(digests: Column) -> Column:
    """The digest of a short array of different digests: by prefixes, as `_input_digest` folds them."""
    bound = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))  # noqa: E731  (what is named twice is worked out once)
    joined = lambda a: F.sha2(F.array_join(F.transform(a, lambda x: x["d"]), ""), 256)
    level = F.transform(F.array_sort(F.transform(digests, _text)), lambda t: F.struct(t.alias("p"), t.alias("d")))

    def by_prefix(width: int, a: Column) -> Column:
        cut = lambda x: F.substring(x["p"], 1, width)
        return bound(F.array_distinct(F.transform(a, cut)), lambda qs: F.when(
            F.size(qs) == F.size(a), F.transform(a, lambda x: F.struct(cut(x).alias("p"), F.sha2(x["d"], 256).alias("d")))).otherwise(
            F.transform(qs, lambda q: F.struct(q.alias("p"), joined(F.filter(a, lambda x: cut(x) == q)).alias("d")))))

    for width in WIDTHS:
        level = bound(level, partial(by_prefix, width))
    return joined(level)


def _input_digest(inputs: DataFrame, wide: DataFrame | None) -> DataFrame:
    """(name, _inputs): one digest per name over its input digests in sorted order.

    A name of at most FEW inputs is folded in one row. Those of `wide` are folded by prefix, so a hot name never meets in one row.
    """
    short = inputs if wide is None else inputs.join(wide, "name", "left_anti")
    out = short.groupBy("name").agg(F.collect_set("key").alias("_k")).select("name", _folded(F.col("_k")).alias("_inputs"))
    if wide is None:
        return out
    key = _text(F.col("key"))
    level = inputs.join(wide, "name", "left_semi").select("name", key.alias("p"), key.alias("d")).distinct()
    for width in (*WIDTHS, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]), "")
        level = level.groupBy("name", F.substring("p", 1, width).alias("_q")).agg(F.sha2(joined, 256).alias("d")).select("name", F.col("_q").alias("p"), "d")
    return out.unionByName(level.select("name", F.col("d").alias("_inputs")))


def _alone(key: Column) -> Column:
    """The digest `_input_digest` gives to a single input."""
    for _ in range(4):
        key = F.sha2(key, 256)
    return key


class Layout(NamedTuple):
    """What the edges of a lineage graph say about the order of its keys, written once for any number of runs."""

    placed: DataFrame  # (name, first, level, at, to, takes): the stretch and round of each name, -1 for names on or behind a cycle;
    #                    `first` is null where a name is a stretch of its own; the name it feeds, where that is one, and the round of that
    chained: bool  # whether any stretch holds several names
    feed: DataFrame | None  # (source, gives, target, takes): edges between stretches of names that feed several, with the rounds of both
    wide: DataFrame | None  # (name): names of more than FEW inputs


def lineage_layout(edges: DataFrame) -> Layout:
    once = settled(edges.select("source", "target").dropna().distinct())
    degree = settled(degrees(once))
    levels = settled(levels_by_degree(once, degree))
    runs = lineage_runs(degree, levels)
    chained = not runs.isEmpty()
    if chained:
        begins = runs.select("first").distinct().withColumn("_run", F.lit(True))
        rows = levels.join(runs, "name", "left")
        own = F.coalesce("first", "name")
        lead = runs.select(F.col("name").alias("source"), F.col("first").alias("_from"))
        fed_by = once.join(runs.select(F.col("name").alias("target")), "target", "left_anti").join(lead, "source", "left")
        depth = settled(lineage_levels(fed_by.select(F.coalesce("_from", "source").alias("source"), "target")))
        heads = settled(levels.filter("level IS NOT NULL").join(runs, "name", "left_anti").join(
            depth.select("name", F.col("level").alias("at")), "name", "left").select(F.col("name").alias("_head"), F.coalesce("at", F.lit(0)).alias("at")))
        rows = rows.select("name", "level", own.alias("_head")).join(heads, "_head", "left").join(begins.withColumnRenamed("first", "_head"), "_head", "left")
        rows = rows.select("name", F.when(F.col("_run"), F.col("_head")).alias("first"), "level", F.coalesce("at", F.lit(-1)).alias("at"))
    else:
        heads = levels.filter("level IS NOT NULL").select(F.col("name").alias("_head"), F.col("level").alias("at"))
        rows = levels.select("name", F.lit(None).cast(levels.schema["name"].dataType).alias("first"), "level", F.coalesce("level", F.lit(-1)).alias("at"))
    only = degree.select("name", F.when(F.col("outputs") == 1, F.col("target")).alias("to"))
    placed = settled(rows.join(only, "name").join(heads.select(F.col("_head").alias("to"), F.col("at").alias("takes")), "to", "left")
                     .select("name", "first", "level", "at", "to", "takes"))
    several = settled(degree.filter("outputs > 1").select(F.col("name").alias("source")))
    wide = settled(degree.filter(F.col("inputs") > FEW).select("name"))
    feed = None
    if not several.isEmpty():
        feed = settled(once.join(several, "source", "left_semi")
                       .join(placed.filter("at >= 0").select(F.col("name").alias("source"), F.col("at").alias("gives")), "source")
                       .join(heads.select(F.col("_head").alias("target"), F.col("at").alias("takes")), "target")
                       .select("source", "gives", "target", "takes").repartitionByRange("gives"))
    return Layout(placed, chained, feed, None if wide.isEmpty() else wide)


def dataset_keys(runs: DataFrame, edges: DataFrame, attributes: Sequence[str], layout: Layout | None = None) -> DataFrame:
    """(name, key): digest of a dataset's own attributes and of the keys of its inputs.

    `runs` is (name, attributes...), `edges` is (source, target). Names on a cycle have no key, nor has a
    name without a row or one all of whose inputs lack a key. A stretch of names with one input each is one
    row whose keys follow from one another, so rounds are levels of stretches. A key is written once, as bytes, filed by
    the round that reads it; names that feed several others hand theirs on through a join.
    """
    return _dataset_keys(runs, attributes, layout or lineage_layout(edges)).select("name", _text(F.col("key")).alias("key"))


def _dataset_keys(runs: DataFrame, attributes: Sequence[str], layout: Layout) -> DataFrame:
    """`dataset_keys` with keys as bytes."""
    spark = runs.sparkSession
    json = F.to_json(F.struct(*sorted(attributes)), {"ignoreNullFields": "false"})
    # attributes shorter than their digest are moved as they are; a digest begins with no brace
    own = runs.select("name", F.when(F.length(json) > 64, F.sha2(json, 256)).otherwise(json).alias("_own"))
    digest = lambda m: F.when(m["_own"].startswith("{"), F.sha2(m["_own"], 256)).otherwise(m["_own"])
    # names without edges are stretches of the first round
    rows = layout.placed.join(own, "name", "full").withColumn("at", F.coalesce("at", F.lit(0))).filter("at >= 0")
    member = F.struct("level", "name", "_own", "to", "takes")
    stretches = rows.filter("first IS NULL").select(F.col("name").alias("first"), "at", F.array(member).alias("run"))
    if layout.chained:
        stretches = stretches.unionByName(rows.filter("first IS NOT NULL").groupBy("first", "at").agg(F.sort_array(F.collect_list(member)).alias("run")))
    stretches = settled(stretches.repartitionByRange("at"))
    last = stretches.agg(F.max("at").alias("m")).first()["m"]
    kind = rows.schema["name"].dataType.simpleString()
    filed, more = (f"{shared_dir(spark)}/gridspark/{uuid.uuid4().hex}" for _ in range(2))
    put = lambda df, path, *by: df.write.mode("append").partitionBy(*by).parquet(path)
    keys = spark.read.schema(f"name {kind}, key binary, to {kind}, takes int, at int").parquet
    handed = spark.read.schema(f"name {kind}, key binary, takes int").parquet
    link = lambda m, key: F.struct(m["name"].alias("name"), F.sha2(key, 256).alias("key"), m["to"].alias("to"), m["takes"].alias("takes"))
    follow = lambda done, m: F.concat(done, F.array(link(m, F.concat(digest(m), _alone(F.element_at(done, -1)["key"])))))
    for n in range(-1 if last is None else last + 1):
        here = stretches.filter(F.col("at") == n)
        lead = F.get("run", F.lit(0))
        start = digest(lead)
        if n:
            taken = keys(filed).filter(F.col("takes") == n).select(F.col("to").alias("name"), "key")
            if layout.feed is not None:
                taken = taken.unionByName(handed(more).filter(F.col("takes") == n).select("name", "key"))
            here = here.join(_input_digest(taken, layout.wide).withColumnRenamed("name", "first"), "first")
            start = F.concat(start, F.col("_inputs"))
        begun = F.array(link(lead, start))
        rest = F.slice("run", F.lit(2), F.size("run"))
        made = here.select(F.explode(F.aggregate(rest, begun, follow)).alias("k")).select("k.*").filter("key IS NOT NULL")
        put(made.select("name", F.unhex("key").alias("key"), "to", "takes", F.lit(n).alias("at")), filed, "at", "takes")
        if layout.feed is not None and n < last:
            now = keys(filed).filter(F.col("at") == n).select(F.col("name").alias("source"), "key")
            given = layout.feed.filter(F.col("gives") == n).join(now, "source")
            put(given.select(F.col("target").alias("name"), "key", "takes"), more, "takes")
    if last is None:
        return rows.select("name", F.lit(None).cast("binary").alias("key")).limit(0)
    return keys(filed).select("name", "key")


def stale_datasets(runs: DataFrame, edges: DataFrame, attributes: Sequence[str], stored: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Names whose key differs from the stored one: a changed dataset and everything made from it."""
    now = _dataset_keys(runs, attributes, layout or lineage_layout(edges))
    # a stored key that is no digest in hexadecimal equals none
    known = stored.select("name", F.when(F.col("key").rlike("^[0-9a-f]{64}$"), F.unhex("key")).alias("_stored"))
    both = now.join(known, "name", "full")
    return both.filter(F.coalesce(F.col("key") != F.col("_stored"), F.lit(True))).select("name")


def two_way_links(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """(row, manifest, status) from each side's link array: both, row_only or manifest_only."""
    a = rows.select(F.col("id").alias("row"), F.explode("links").alias("manifest")).distinct().withColumn("_a", F.lit(1))
    b = manifests.select(F.explode("links").alias("row"), F.col("id").alias("manifest")).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), "row_only").when(F.col("_a").isNull(), "manifest_only").otherwise("both")
    return a.join(b, ["row", "manifest"], "full").select("row", "manifest", status.alias("status"))


ANCHOR_ID = r"\b([a-z][a-z0-9]*\.[a-z][a-z0-9_]*)"


def link_problems(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """(site, problem, other) for every broken link between registry rows and the manifests of their data.

    `rows` is (id, tier, datasets), `manifests` is (path, id, oracle_data, oracles, anchors), the lists null where the
    field is absent. An id of two manifests is a problem at each of their paths; links count for any
    manifest of that id. A row of tier 2 or 3 has datasets, a manifest of oracle data names a row, each link
    holds both ways, and no anchor carries an id whose first word begins a row's id.
    """
    say = lambda df, site, text, other=None: df.select(
        F.col(site).alias("site"), F.lit(text).alias("problem"), (F.lit(None).cast("string") if other is None else F.col(other)).alias("other"))
    ids = rows.select("id").dropna().distinct()
    named = rows.select("id", F.explode("datasets").alias("manifest")).distinct()
    names = manifests.select("path", F.col("id").alias("manifest"), F.explode("oracles").alias("oracle")).distinct()
    held = manifests.select(F.col("id").alias("manifest")).distinct()
    twice = manifests.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    back = names.select(F.col("oracle").alias("id"), "manifest").distinct()
    forth = named.select(F.col("id").alias("oracle"), "manifest")
    known = ids.select(F.col("id").alias("oracle"))
    words = ids.select(F.substring_index("id", ".", 1).alias("_word")).distinct()
    hits = manifests.select("path", F.explode("anchors").alias("_a")).select(
        "path", F.explode(F.regexp_extract_all("_a", F.lit(ANCHOR_ID), F.lit(1))).alias("hit")).distinct()
    linked = named.join(held, "manifest", "left_semi")
    placed = names.join(known, "oracle", "left_semi")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    found = [
        say(manifests.join(twice, "id", "left_semi"), "path", "its id is used again", "id"),
        say(rows.filter("tier IN (2, 3) AND datasets IS NULL"), "id", "has no datasets field"),
        say(named.join(held, "manifest", "left_anti"), "id", "names a manifest that does not exist", "manifest"),
        say(linked.join(back, ["id", "manifest"], "left_anti"), "id", "is not named back by the manifest", "manifest"),
        say(manifests.filter(F.col("oracle_data") & empty("oracles")), "path", "oracle data that names no row"),
        say(names.join(known, "oracle", "left_anti"), "path", "names an id that is no row", "oracle"),
        say(placed.join(forth, ["oracle", "manifest"], "left_anti"), "path", "is not named back by the row", "oracle"),
        say(hits.withColumn("_word", F.substring_index("hit", ".", 1)).join(words, "_word", "left_semi"), "path", "an anchor carries the id of a row", "hit"),
    ]
    return fold(lambda a, b: a.unionByName(b), found)


def unit_sum(fractions: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Whether each group's shares sum to one within the rounding bound of that sum."""
    out = fractions.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.sum(F.abs(value)).alias("_m"))
    return out.withColumn("ok", F.abs(F.col("total") - 1.0) <= numeric.error_bound(F.col("n") + 2, F.col("_m"))).drop("_m")


def recompute_check(df: DataFrame, supplied: Column, rule: Column, bound: Column) -> DataFrame:
    """Rows whose supplied value is further from its rule than the bound allows."""
    return df.withColumn("gap", F.abs(supplied - rule)).filter(F.coalesce(F.col("gap") > bound, F.lit(True)))


def dangling(references: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(name, problem): names that resolve to no row, and row ids used more than once."""
    lost = references.select(name).distinct().join(rows.select(name), name, "left_anti").withColumn("problem", F.lit("unresolved"))
    twice = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(name, F.lit("repeated").alias("problem"))
    return lost.unionByName(twice)


def dependency_closure(edges: DataFrame) -> DataFrame:
    """(id, reaches): every row reachable through one or more edges, one join per round of new pairs."""
    links = settled(edges.select(F.col("id"), F.col("depends_on")).distinct())
    new = settled(links.select("id", F.col("depends_on").alias("reaches")))
    parts = [new]
    step = links.select(F.col("id").alias("reaches"), F.col("depends_on").alias("_next"))
    while True:
        grown = new.join(step, "reaches").select("id", F.col("_next").alias("reaches")).distinct()
        for p in parts:
            grown = grown.join(p, ["id", "reaches"], "left_anti")
        new = settled(grown)
        if new.isEmpty():
            return fold(lambda a, b: a.unionByName(b), parts)
        parts.append(new)


def dependency_problems(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, problem, depends_on): what is wrong with the ids rows depend on; `depends_on` is null for a row that reaches itself.

    `edges` is (id, depends_on) with repeats, `rows` is (id, tier). An id named twice by one row, an id that is no
    row and a row of a less trusted tier are joins; rows on a cycle are strongly connected parts, so
    reachable pairs are never listed. Only edges between rows can close a cycle.
    """
    named = edges.select("id", "depends_on").dropna()
    known = rows.select("id").dropna().distinct()
    counted = settled(named.join(known, "id", "left_semi").groupBy("id", "depends_on").agg(F.count(F.lit(1)).alias("_n")))
    target = known.withColumnRenamed("id", "depends_on")
    own = rows.groupBy("id").agg(F.min("tier").alias("tier"))
    far = own.select(F.col("id").alias("depends_on"), F.col("tier").alias("_far"))
    resolved = counted.join(target, "depends_on", "left_semi")
    part = strong_parts(resolved.select(F.col("id").alias("source"), F.col("depends_on").alias("target")))
    problem = lambda df, text: df.select("id", F.lit(text).alias("problem"), "depends_on")
    return (problem(counted.filter("_n > 1"), "names a row more than once")
            .unionByName(problem(counted.join(target, "depends_on", "left_anti"), "depends on an id that is no row"))
            .unionByName(problem(resolved.join(own, "id").join(far, "depends_on").filter("_far > tier"), "depends on a less trusted row"))
            .unionByName(part.select(F.col("name").alias("id"), F.lit("depends on itself").alias("problem"),
                                     F.lit(None).cast(counted.schema["depends_on"].dataType).alias("depends_on"))))
