"""Audits over tables that stand in for registries, declarations, lineage and manifests; sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.contracts import declare
from gridspark.functions import cells, hashing
from gridspark.operators import audit, fields
from gridspark.operators.ordered import FromData, numbered
from gridspark.plans.fields import cell_fractions
from gridspark.plans.fixtures import CELL_SQL, CELL_TABLE_SQL, ORDER, anc_sql, cell_table, events, fine_field, seconds
from gridspark.plans.grids import LEVEL_SQL, level_of
from gridspark.plans.registry import query, r6, table
from gridspark.session import settled, shared_dir
from gridspark.sources import tables

SOURCE_KINDS = ("STANDARD", "SMALL", "MEDIUM")


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def registry(spark, sf):
    """Parts as registry rows, with faults that follow from their attributes."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.concat(F.lit("system."), F.col("p_partkey").cast("string")).alias("id"), F.when(size % 13 != 0, size % 4).alias("tier"), F.when(size % 17 != 0, F.col("p_type")).alias("source_kind"),
        F.when(size % 5 == 0, "maybe").when(size % 19 == 0, None).when(size % 2 == 0, "report").otherwise("fail_bar").alias("verdict_kind"),
        F.when(size % 3 == 0, "").when(size % 7 == 0, "abc").otherwise(F.repeat(F.lit("0a"), 20)).alias("registered_at"),
        F.when(size % 8 == 1, F.array(F.lit("x"))).alias("instances"), F.when(size % 11 != 0, "p").alias("protocol"),
        F.when(size % 6 == 0, F.array().cast("array<string>")).when(size % 23 != 0, F.array(F.lit("a"))).alias("anchors"),
        F.when(size > 10, size * 0.1).alias("bar_half_width"), F.when(size > 12, 2.0).alias("observation_uncertainty"),
        F.when(F.col("p_brand") != "Brand#2", F.col("p_name")).alias("statistic"))


_RULES = (
    ("p_brand = 'Brand#2'", "carries no statistic"), ("p_size % 4 NOT IN (1, 2, 3) OR p_size % 13 = 0", "tier is outside the closed set"),
    ("p_type NOT IN ('STANDARD', 'SMALL', 'MEDIUM') OR p_size % 17 = 0", "source_kind is outside the closed set"),
    ("p_size % 5 = 0 OR p_size % 19 = 0", "verdict_kind is outside the closed set"), ("p_size % 3 <> 0 AND p_size % 7 = 0", "registered_at is no commit id"),
    ("p_size % 4 = 1 AND p_size % 13 <> 0 AND p_size % 8 <> 1", "a tier 1 system entry names no instances"),
    ("p_size % 4 = 3 AND p_size % 13 <> 0 AND p_size % 11 = 0", "a tier 3 entry names no protocol"),
    ("p_size % 4 IN (2, 3) AND p_size % 13 <> 0 AND (p_size % 6 = 0 OR p_size % 23 = 0)", "a tier 2 or 3 entry with no anchors"),
    ("p_size > 10 AND p_size <= 12", "bar and uncertainty are not stated together"),
    ("p_size > 12 AND p_size * 0.1::DOUBLE < 2.0", "a bar narrower than its uncertainty"))
RULES_SQL = " UNION ALL ".join(f"SELECT 'system.' || p_partkey AS site, '{why}' AS reason FROM part WHERE {when}" for when, why in _RULES)


@query("aud1_rule_check", RULES_SQL)
def aud1(spark, sf):
    return audit.rule_check(registry(spark, sf), ["id", "statistic"], SOURCE_KINDS)


@query("top4_sorted_problems", f"SELECT site, reason, row_number() OVER (ORDER BY site, reason) AS position FROM ({RULES_SQL})")
def top4(spark, sf):
    found = audit.rule_check(registry(spark, sf), ["id", "statistic"], SOURCE_KINDS)
    # positions in sorted order; ids share a prefix, so the digits after it cut the slices
    return numbered(audit.sorted_problems(found), ["site", "reason"], F.substring("site", 8, 2), name="position")


_JUDGED = """(SELECT o_orderpriority AS id, avg(o_totalprice) AS value, 150000.0 AS reference, 5000.0 AS u,
    CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'report' ELSE 'fail_bar' END AS kind, {bar} AS bar FROM orders GROUP BY 1)"""
_BAR = "CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 1e6 END"


def judged(spark, sf):
    values = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(F.avg("o_totalprice").alias("value")).withColumn("reference", F.lit(150000.0))
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id")).distinct().select(
        "id", F.when(F.col("id").isin("1-URGENT", "5-LOW"), "report").otherwise("fail_bar").alias("verdict_kind"),
        F.when(F.col("id") == "2-HIGH", 1.0).otherwise(1e6).alias("bar_half_width"), F.lit(5000.0).alias("observation_uncertainty"))
    return audit.judge(values, rows)


@query("aud2_judge", f"""
    SELECT id, round(abs(value - reference), 4) AS distance, round(abs(value - reference) / u, 6) AS in_uncertainty,
           CASE WHEN kind = 'report' THEN 'REPORT' WHEN abs(value - reference) <= bar THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM {_JUDGED.format(bar=_BAR)}""")
def aud2(spark, sf):
    return judged(spark, sf).select("id", r6(F.col("distance"), 4).alias("distance"), r6(F.col("in_uncertainty")).alias("in_uncertainty"), "verdict")


@query("aud3_distance_report", f"""
    SELECT id, id || '  ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || '  150000  ' || CAST(CAST(round(abs(value - reference) / u) AS BIGINT) AS VARCHAR) || '  ' ||
           CASE WHEN kind = 'report' THEN 'REPORT' WHEN abs(value - reference) <= bar THEN 'PASS' ELSE 'FAIL' END AS line
    FROM {_JUDGED.format(bar=_BAR)}""")
def aud3(spark, sf):
    whole = lambda c: F.round(c).cast("bigint").alias(c)
    return audit.distance_report(judged(spark, sf).select("id", whole("value"), whole("reference"), whole("in_uncertainty"), "verdict"))


@query("aud4_admissible", """
    WITH v AS (SELECT l_partkey AS id, epoch_us(l_shipdate) / 1e6 AS inst, l_orderkey, l_linenumber, l_suppkey, l_returnflag || l_linestatus AS f FROM lineitem),
    today AS (SELECT id, max_by(f, (inst, l_orderkey, l_linenumber, l_suppkey)) AS f FROM v GROUP BY 1),
    r AS (SELECT o_orderkey, o_custkey AS id, epoch_us(o_orderdate) / 1e6 AS inst FROM orders),
    held AS (SELECT o_orderkey, max_by(v.f, (v.inst, l_orderkey, l_linenumber, l_suppkey)) AS f FROM r JOIN v ON v.id = r.id AND v.inst <= r.inst GROUP BY 1)
    SELECT r.o_orderkey, coalesce(h.f = t.f, false) AS admissible FROM r LEFT JOIN held h ON h.o_orderkey = r.o_orderkey LEFT JOIN today t ON t.id = r.id""")
def aud4(spark, sf):
    versions = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), seconds("l_shipdate").alias("at"), "l_orderkey", "l_linenumber",
                                                   "l_suppkey", "l_returnflag", "l_linestatus")
    results = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), seconds("o_orderdate").alias("at"))
    out = audit.admissible(results, versions, "id", "at", ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_returnflag", "l_linestatus"],
                           FromData())
    return out.select("o_orderkey", "admissible")


@query("aud5_history_problems", """
    WITH v AS (SELECT l_partkey AS id, l_orderkey AS merge, l_tax AS threshold, CASE WHEN l_returnflag = 'A' THEN 'report' ELSE 'fail_bar' END AS kind,
        l_linenumber, l_suppkey, l_extendedprice FROM lineitem),
    s AS (SELECT *, lag(threshold) OVER w AS pt, lag(kind) OVER w AS pk, lag(merge) OVER w AS pm FROM v
        WINDOW w AS (PARTITION BY id ORDER BY merge, l_linenumber, l_suppkey, l_extendedprice)),
    m AS (SELECT DISTINCT id, merge FROM s WHERE pm IS NOT NULL AND threshold <> pt AND merge IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')),
    x AS (SELECT DISTINCT l_partkey AS id, l_orderkey AS merge FROM lineitem WHERE l_discount > 0.095)
    SELECT id, merge, 'threshold changes together with code' AS reason FROM m WHERE (id, merge) NOT IN (SELECT (id, merge) FROM x)
    UNION ALL SELECT DISTINCT id, merge, 'a bar set after a report' FROM s WHERE pk = 'report' AND kind = 'fail_bar'
    UNION ALL SELECT id, merge, 'a stale exception' FROM x WHERE (id, merge) NOT IN (SELECT (id, merge) FROM m)""")
def aud5(spark, sf):
    li = table(spark, sf, "lineitem")
    versions = li.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("merge"), F.col("l_tax").alias("threshold"),
                         F.when(F.col("l_returnflag") == "A", "report").otherwise("fail_bar").alias("verdict_kind"), "l_linenumber", "l_suppkey", "l_extendedprice")
    touched = table(spark, sf, "orders").select(F.col("o_orderkey").alias("merge"), F.when(F.col("o_orderstatus") == "F", "src/a").otherwise("docs/a").alias("path"))
    exceptions = li.filter("l_discount > 0.095").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("merge"))
    return audit.history_problems(versions, touched, exceptions, ["merge", "l_linenumber", "l_suppkey", "l_extendedprice"], FromData())


@query("aud6_declaration_problems", """
    WITH d AS (SELECT DISTINCT l_suppkey AS component, l_partkey AS quantity, CASE WHEN l_discount > 0.09 THEN 'write' ELSE 'read' END AS role FROM lineitem),
    n AS (SELECT quantity, sum(CASE WHEN role = 'write' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN role = 'read' THEN 1 ELSE 0 END) AS r FROM d GROUP BY 1)
    SELECT quantity, 'several writers' AS reason FROM n WHERE w > 1 UNION ALL SELECT quantity, 'read, never written' FROM n WHERE w = 0
    UNION ALL SELECT quantity, 'written, never read' FROM n WHERE r = 0
    UNION ALL SELECT o_custkey, 'an undeclared stock' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT quantity FROM d)""")
def aud6(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("quantity"),
                                            F.when(F.col("l_discount") > 0.09, "write").otherwise("read").alias("role"))
    return audit.declaration_problems(d, table(spark, sf, "orders").select(F.col("o_custkey").alias("quantity")))


def declared_paths(spark, sf):
    step = F.when(F.col("l_linenumber") == 7, ":").otherwise(F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("name"), F.array(F.concat(F.lit("k"), F.col("l_partkey") % 50), step).alias("path")).distinct()


_DECL = """(SELECT DISTINCT l_suppkey AS name, 'k' || l_partkey % 50 AS k, CASE WHEN l_linenumber = 7 THEN ':' ELSE CAST(l_linenumber AS VARCHAR) END AS s FROM lineitem)"""


@query("aud7_affected", f"""
    SELECT DISTINCT c.k || '/' || c.s AS change, d.name FROM (SELECT DISTINCT 'k' || l_partkey % 60 AS k, CAST(l_linenumber AS VARCHAR) AS s
        FROM lineitem) c JOIN {_DECL} d ON d.k = c.k AND (d.s = c.s OR d.s = ':')""")
def aud7(spark, sf):
    changes = table(spark, sf, "lineitem").select(
        F.array(F.concat(F.lit("k"), F.col("l_partkey") % 60), F.col("l_linenumber").cast("string")).alias("path"))
    out = audit.affected(declared_paths(spark, sf), changes)
    return out.select(F.array_join("change", "/").alias("change"), "name")


_READS = """(SELECT DISTINCT l_suppkey AS name, 'k' || CASE WHEN l_tax < 0.05 THEN l_partkey ELSE l_orderkey END % 50 AS k,
    CAST(l_linenumber AS VARCHAR) AS s, l_returnflag AS f FROM lineitem)"""


@query("aud8_dependency_subset", f"""
    WITH d AS {_DECL}, r AS {_READS}, ok AS (SELECT r.*, d.s AS ds FROM r JOIN d ON d.name = r.name AND d.k = r.k AND (d.s = r.s OR d.s = ':'))
    SELECT name, k || '/' || s || '/' || f AS path, 'undeclared' AS problem FROM r WHERE NOT EXISTS (
        SELECT 1 FROM ok WHERE ok.name = r.name AND ok.k = r.k AND ok.s = r.s AND ok.f = r.f)
    UNION ALL SELECT name, k || '/' || s, 'unread' FROM d WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.name = d.name AND ok.k = d.k AND ok.ds = d.s)""")
def aud8(spark, sf):
    key = F.when(F.col("l_tax") < 0.05, F.col("l_partkey")).otherwise(F.col("l_orderkey"))
    reads = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("name"), F.array(
        F.concat(F.lit("k"), key % 50), F.col("l_linenumber").cast("string"), F.col("l_returnflag")).alias("path"))
    out = audit.dependency_subset(reads, declared_paths(spark, sf))
    return out.select("name", F.array_join("path", "/").alias("path"), "problem")


def lineage(spark, sf):
    """Orders as datasets, each read by the dataset numbered an eighth of it; order 0 reads itself."""
    li = table(spark, sf, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("source"), F.floor(F.col("l_orderkey") / 8).alias("target")).distinct()
    return li, edges


@query("aud9_stale_datasets", """
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS source, l_orderkey // 8 AS target FROM lineitem),
    hit AS (SELECT l_orderkey AS name FROM lineitem WHERE l_orderkey <> 0 GROUP BY 1 HAVING max(l_quantity) = 50 AND max(l_discount) > 0.09
        UNION SELECT e.target FROM hit h JOIN e ON e.source = h.name WHERE e.target <> 0)
    SELECT name FROM hit""")
def aud9(spark, sf):
    # one row an order, written once: lines, edges and both runs come from it
    orders = settled(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(
        ((F.max("l_quantity") == 50) & (F.max("l_discount") > 0.09)).alias("hit")))
    # order 0 reads itself, so it has no key; the rest form a forest
    edges = orders.select(F.col("name").alias("source"), F.floor(F.col("name") / 8).alias("target")).filter("target <> 0")
    both = orders.unionByName(edges.select(F.col("target").alias("name"), F.lit(False).alias("hit")))
    names = settled(both.groupBy("name").agg(F.max("hit").alias("hit")).filter("name <> 0"))
    old = names.select("name", F.lit("v1").alias("code"))
    new = names.select("name", F.when(F.col("hit"), "v2").otherwise("v1").alias("code"))
    layout = audit.lineage_layout(edges)
    return audit.stale_datasets(new, edges, ["name", "code"], audit.dataset_keys(old, edges, ["name", "code"], layout), layout)


@query("aud10_two_way_links", """
    SELECT coalesce(a.r, b.r) AS row, coalesce(a.m, b.m) AS manifest, CASE WHEN b.r IS NULL THEN 'row_only' WHEN a.r IS NULL THEN 'manifest_only' ELSE 'both' END AS status
    FROM (SELECT DISTINCT l_orderkey AS r, l_suppkey AS m FROM lineitem WHERE l_returnflag <> 'R') a
    FULL JOIN (SELECT DISTINCT l_orderkey AS r, l_suppkey AS m FROM lineitem WHERE l_returnflag <> 'A') b ON a.r = b.r AND a.m = b.m""")
def aud10(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("id"), F.array("l_suppkey").alias("links"))
    manifests = li.filter("l_returnflag <> 'A'").select(F.col("l_suppkey").alias("id"), F.array("l_orderkey").alias("links"))
    return audit.two_way_links(rows, manifests)


@query("aud10_link_problems", """
    WITH r AS MATERIALIZED (SELECT 'ord.a' || l_orderkey AS id, 1 + l_orderkey % 3 AS tier,
            list(DISTINCT 'm' || l_suppkey) FILTER (l_returnflag <> 'R') AS datasets FROM lineitem GROUP BY l_orderkey),
    m AS MATERIALIZED (SELECT 'data/' || l_suppkey || '-' || l_linestatus AS path, 'm' || l_suppkey AS id, l_linestatus = 'O' AS oracle_data,
            list(DISTINCT CASE WHEN l_quantity > 49 THEN 'gone.' ELSE 'ord.a' END || l_orderkey) FILTER (l_returnflag <> 'A' AND l_tax < 0.06) AS oracles,
            bool_or(l_quantity = 50 AND l_discount > 0.09) AS hit FROM lineitem GROUP BY l_suppkey, l_linestatus),
    named AS MATERIALIZED (SELECT DISTINCT id, unnest(datasets) AS manifest FROM r),
    names AS MATERIALIZED (SELECT DISTINCT path, id AS manifest, unnest(oracles) AS oracle FROM m)
    SELECT path AS site, 'its id is used again' AS problem, id AS other FROM m WHERE id IN (SELECT id FROM m GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT id, 'has no datasets field', NULL FROM r WHERE tier IN (2, 3) AND datasets IS NULL
    UNION ALL SELECT id, 'names a manifest that does not exist', manifest FROM named WHERE manifest NOT IN (SELECT id FROM m)
    UNION ALL SELECT id, 'is not named back by the manifest', manifest FROM named n WHERE manifest IN (SELECT id FROM m)
        AND NOT EXISTS (SELECT 1 FROM names b WHERE b.oracle = n.id AND b.manifest = n.manifest)
    UNION ALL SELECT path, 'oracle data that names no row', NULL FROM m WHERE oracle_data AND oracles IS NULL
    UNION ALL SELECT path, 'names an id that is no row', oracle FROM names WHERE oracle NOT IN (SELECT id FROM r)
    UNION ALL SELECT path, 'is not named back by the row', oracle FROM names n WHERE oracle IN (SELECT id FROM r)
        AND NOT EXISTS (SELECT 1 FROM named b WHERE b.id = n.oracle AND b.manifest = n.manifest)
    UNION ALL SELECT path, 'an anchor carries the id of a row', 'ord.x_1' FROM m WHERE hit""")
def aud10_links(spark, sf):
    li = table(spark, sf, "lineitem")
    some = lambda value, when: F.collect_set(F.when(when, value))
    listed = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    order = F.col("l_orderkey").cast("string")
    rows = li.groupBy("l_orderkey").agg(some(F.concat(F.lit("m"), "l_suppkey"), F.col("l_returnflag") != "R").alias("datasets"))
    rows = rows.select(F.concat(F.lit("ord.a"), "l_orderkey").alias("id"), (1 + F.col("l_orderkey") % 3).alias("tier"), listed("datasets"))
    oracle = F.concat(F.when(F.col("l_quantity") > 49, "gone.").otherwise("ord.a"), order)
    manifests = li.groupBy("l_suppkey", "l_linestatus").agg(
        some(oracle, (F.col("l_returnflag") != "A") & (F.col("l_tax") < 0.06)).alias("oracles"),
        F.bool_or((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.09)).alias("hit"))
    manifests = manifests.select(
        F.concat_ws("-", F.concat(F.lit("data/"), "l_suppkey"), "l_linestatus").alias("path"), F.concat(F.lit("m"), "l_suppkey").alias("id"),
        (F.col("l_linestatus") == "O").alias("oracle_data"), listed("oracles"),
        F.array(F.when(F.col("hit"), "see ord.x_1 and Sea.x").otherwise("see other.x_1")).alias("anchors"))
    return audit.link_problems(rows, manifests)


@query("aud11_unit_sum", f"SELECT {CELL_SQL} AS cell, CAST(3 AS BIGINT) AS n, true AS ok FROM lineitem GROUP BY 1")
def aud11(spark, sf):
    return audit.unit_sum(cell_fractions(spark, sf), ["cell"], "share").select("cell", "n", "ok")


_DEPENDS = "(SELECT DISTINCT l_orderkey AS id, l_orderkey // 8 AS dep FROM lineitem)"


@query("aud12_dependency_closure", f"""
    WITH RECURSIVE e AS MATERIALIZED {_DEPENDS}, c AS (SELECT id, dep AS reaches FROM e UNION SELECT c.id, e.dep FROM c JOIN e ON e.id = c.reaches)
    SELECT id, reaches FROM c""")
def aud12(spark, sf):
    _, edges = lineage(spark, sf)
    return audit.dependency_closure(edges.select(F.col("source").alias("id"), F.col("target").alias("depends_on")))


@query("aud12_dependency_problems", """
    WITH RECURSIVE known AS MATERIALIZED (SELECT o_orderkey AS id, o_orderpriority AS tier FROM orders),
    e AS MATERIALIZED (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN l_orderkey + 1 WHEN l_linenumber > 2 THEN l_orderkey // 8 ELSE l_partkey END AS dep
        FROM lineitem WHERE l_quantity > 15),
    n AS (SELECT id, dep, count(*) AS n FROM e WHERE id IN (SELECT id FROM known) GROUP BY ALL),
    r AS MATERIALIZED (SELECT id, dep FROM n WHERE dep IN (SELECT id FROM known)),
    way AS (SELECT id, dep AS spot FROM r UNION SELECT way.id, r.dep FROM way JOIN r ON r.id = way.spot)
    SELECT id, 'names a row more than once' AS problem, dep AS depends_on FROM n WHERE n > 1
    UNION ALL SELECT id, 'depends on an id that is no row', dep FROM n WHERE dep NOT IN (SELECT id FROM known)
    UNION ALL SELECT r.id, 'depends on a less trusted row', dep FROM r JOIN known a ON a.id = r.id JOIN known b ON b.id = dep WHERE b.tier > a.tier
    UNION ALL SELECT DISTINCT id, 'depends on itself', CAST(NULL AS BIGINT) FROM way WHERE spot = id""")
def aud12_problems(spark, sf):
    line = F.col("l_linenumber")
    to = F.when(line == 2, F.col("l_orderkey") + 1).when(line > 2, F.floor(F.col("l_orderkey") / 8)).otherwise(F.col("l_partkey"))
    edges = table(spark, sf, "lineitem").filter("l_quantity > 15").select(F.col("l_orderkey").alias("id"), to.alias("depends_on"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tier"))
    return audit.dependency_problems(edges, rows)


@query("aud14_recompute_check", """
    SELECT o_orderkey, round(abs(o_totalprice - p), 2) AS gap FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey WHERE abs(o_totalprice - p) > 30000.0 * n""")
def aud14(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("n"))
    out = audit.recompute_check(table(spark, sf, "orders").join(lines, "o_orderkey"), F.col("o_totalprice"), F.col("p"), 30000.0 * F.col("n"))
    return out.select("o_orderkey", r6(F.col("gap"), 2).alias("gap"))


@query("jn12_dangling_references", """
    SELECT DISTINCT l_partkey AS name, 'unresolved' AS problem FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, 'repeated' FROM orders GROUP BY 1 HAVING count(*) > 1""")
def jn12(spark, sf):
    return audit.dangling(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name")),
                          table(spark, sf, "orders").select(F.col("o_custkey").alias("name")), "name")


# Sources and sinks

_EXPECTED = {"semantics": "Extensive", "time_semantics": "Static", "dimension": [0, 0, 0, 0, 0], "support_id": "level5", "owner": "orders", "interval": []}


@query("src1_read_contracted", f"SELECT cell, round(value, 2) AS value FROM ({CELL_TABLE_SQL})")
def src1(spark, sf):
    path = scratch(spark, "contracted")
    declare(cell_table(spark, sf).select("cell", "value"), "value", semantics="Extensive", support_id="level5", owner="orders").write.parquet(path)
    return tables.read_contracted(spark, path, "value", _EXPECTED).withColumn("value", r6(F.col("value"), 2))


@query("src2_verify_manifest", """
    SELECT * FROM (VALUES ('benchmark', 'ok'), ('conversations', 'ok'), ('customer', 'ok'), ('documents', 'ok'), ('embeddings', 'ok'), ('events', 'ok'),
        ('labels', 'ok'), ('lineitem', 'sha256 differs'), ('nation', 'ok'), ('orders', 'extra'), ('pages', 'ok'), ('part', 'bytes differ'),
        ('region', 'ok'), ('supplier', 'ok'), ('zebra', 'absent')) v(name, status)""")
def src2(spark, sf):
    found = tables.file_manifest(spark, sf, "*.parquet")
    owner = tables.table_of()  # a table is one file, or a folder of them
    kept = found.filter(owner != "orders.parquet").select(
        "path", (F.col("bytes") + (owner == "part.parquet").cast("int")).alias("bytes"),
        F.when(owner == "lineitem.parquet", F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.createDataFrame([("zebra.parquet", 1, "0")], "path string, bytes bigint, sha256 string")
    out = tables.table_statuses(tables.verify_manifest(found, kept.unionByName(gone)))
    return out.select(F.regexp_replace("path", r"\.parquet$", "").alias("name"), "status")


@query("src3_feature_pages", """
    SELECT 'site' AS kind, 'C' || c_custkey AS site, round(c_acctbal, 2) AS x, 1 AS n FROM customer
    UNION ALL SELECT 'reading', 'C' || user_id, round(sum(value), 2), count(*) FROM events GROUP BY 2""")
def src3(spark, sf):
    """Customers and events written out as GeoJSON pages, then read back as sites and measurements."""
    path = scratch(spark, "features")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    sites = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 500).alias("page"), F.struct(
        F.struct(F.lit("Point").alias("type"), F.array(F.col("c_acctbal"), F.lit(1.0)).alias("coordinates")).alias("geometry"),
        F.struct(F.concat(F.lit("C"), F.col("c_custkey")).alias("id"), *none("monitoring_location_id", "value")).alias("properties")).alias("feature"))
    readings = events(spark, sf).select(F.floor(F.col("event_id") / 500).alias("page"), F.struct(
        F.lit(None).cast("struct<type:string,coordinates:array<double>>").alias("geometry"),
        F.struct(*none("id"), F.concat(F.lit("C"), F.col("user_id")).alias("monitoring_location_id"), F.col("value").cast("string").alias("value")).alias("properties")
    ).alias("feature"))
    pages = sites.unionByName(readings).groupBy("page").agg(F.collect_list("feature").alias("features"))  # 1000 features a page
    pages.select("features").write.option("compression", "gzip").json(path)
    a, b = tables.read_feature_pages(spark, path)
    left = a.select(F.lit("site").alias("kind"), F.col("id").alias("site"), r6(F.col("lon"), 2).alias("x"), F.lit(1).cast("bigint").alias("n"))
    right = b.groupBy("site").agg(r6(F.sum(F.col("value").cast("double")), 2).alias("x"), F.count(F.lit(1)).alias("n"))
    return left.unionByName(right.withColumn("kind", F.lit("reading")))


@query("snk1_put_dataset", f"SELECT {anc_sql(2)} AS coarse, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
def snk1(spark, sf):
    df = declare(fine_field(spark, sf).withColumnRenamed("l_extendedprice", "value"), "value", semantics="Extensive")
    out = fields.coarsen(df, "value", 2, reservoir=True)
    path = tables.put_dataset(out.field, scratch(spark, "store"), {"table": "lineitem", "depth": 2, "code": "1"}, out.ledger)
    return spark.read.parquet(path).select("coarse", r6(F.col("value"), 2).alias("value"))


@query("snk2_put_geometry", f"""
    SELECT 'fine' AS support_id, CAST(20 * pow(4, {LEVEL_SQL}) AS BIGINT) AS cells, round(4 * pi(), 6) AS area""")
def snk2(spark, sf):
    root = tables.put_geometry(spark, scratch(spark, "geometry"), level_of(spark, sf), "fine")
    return spark.read.parquet(f"{root}/cells").groupBy("support_id").agg(F.count(F.lit(1)).alias("cells"), r6(F.sum("area"), 6).alias("area"))


@query("snk3_clustered_write", f"""
    SELECT (l_orderkey % 20480) // 1024 + 1 AS chunk, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1""")
def snk3(spark, sf):
    path = scratch(spark, "clustered")
    tables.clustered_write(fine_field(spark, sf).select("cell", "l_extendedprice"), path, 5)
    return spark.read.parquet(path).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_extendedprice"), 2).alias("value"))


@query("snk5_export_with_geometry")
def snk5(spark, sf):
    path = scratch(spark, "export")
    tables.write_with_geometry(cell_table(spark, sf).select("cell", "value"), 5, path, {"value": "currency"}, "level5")
    out = spark.read.parquet(path)
    return out.select("cell", r6(F.col("value"), 2).alias("value"), *[r6(F.col(c), 9).alias(c) for c in ("area", "lat", "lon", "ax", "by", "cz")])


@query("sca10_random_words")
def sca10(spark, sf):
    w = hashing.random_word(20260910, b"\0" * 32, 3, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("word"))


@query("sca11_canonical_digest", """
    SELECT sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}') AS digest, count(*) AS n
    FROM lineitem GROUP BY 1""")
def sca11(spark, sf):
    d = hashing.canonical_digest(["l_orderkey", "l_returnflag", "l_linenumber"])
    return table(spark, sf, "lineitem").groupBy(d.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
