"""Corpus queries: documents as paged texts, benchmark items as questions, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import corpus
from gridspark.operators.ordered import FromData
from gridspark.plans.registry import dealt, query, r6, table

LINES = 4  # lines of a document that stand for one page
SIZE, OVERLAP, LEAST = 400, 50, 100

PAGES_SQL = f"""
    lines AS MATERIALIZED (SELECT doc_id, pos - 1 AS pos, (pos - 1) // {LINES} + 1 AS page, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
    stripped AS MATERIALIZED (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines)"""
HEADS_SQL = f"""{PAGES_SQL},
    body AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS up,
                    row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS down FROM stripped WHERE s <> ''),
    edge AS (SELECT doc_id, page, pos, s, 'first' AS part FROM body WHERE up <= 2 UNION ALL SELECT doc_id, page, pos, s, 'last' FROM body WHERE down <= 2),
    counts AS (SELECT doc_id, max(page) AS pages FROM lines GROUP BY 1),
    heads AS MATERIALIZED (SELECT e.doc_id, regexp_replace(s, '[0-9]+', '#', 'g') AS key, count(*) AS n FROM edge e
        JOIN counts c ON c.doc_id = e.doc_id AND c.pages >= 4 WHERE length(regexp_replace(s, '[0-9]+', '#', 'g')) > 3
        GROUP BY 1, 2, c.pages HAVING count(*) >= greatest(3.0, 0.3 * c.pages))"""
BODIES_SQL = f"""{HEADS_SQL},
    kept AS (SELECT l.doc_id, l.page, l.pos, regexp_replace(s, '[ \\t]{{2,}}', ' ', 'g') AS s FROM stripped l
        LEFT JOIN heads h ON h.doc_id = l.doc_id AND h.key = regexp_replace(l.s, '[0-9]+', '#', 'g')
        WHERE s = '' OR (h.key IS NULL AND NOT regexp_full_match(s, '[^A-Za-z]*') AND NOT regexp_matches(s, '\\.{{4,}}'))),
    bodies AS MATERIALIZED (SELECT * FROM (SELECT doc_id, page, regexp_replace(regexp_replace(
        string_agg(s, chr(10) ORDER BY pos), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body
        FROM kept GROUP BY 1, 2) WHERE body <> '')"""
CHUNKS_SQL = f"""{BODIES_SQL},
    placed AS (SELECT *, coalesce(sum(length(body) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM bodies),
    texts AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page) AS t FROM bodies GROUP BY 1),
    starts AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - {SIZE}) / {SIZE - OVERLAP}.0)) AS BIGINT) + 1)) * {SIZE - OVERLAP} AS start FROM texts),
    pieces AS (SELECT doc_id, start, substr(t, start + 1, {SIZE}) AS text FROM starts),
    chunked AS MATERIALIZED (SELECT p.doc_id, (SELECT max(page) FROM placed x WHERE x.doc_id = p.doc_id AND x.at <= p.start) AS page, start, text
        FROM pieces p WHERE length(text) >= {LEAST} AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')"""


def paged(spark, sf):
    return corpus.with_pages(dealt(table(spark, sf, "documents").select("doc_id", "text")), "text", LINES)


@query("cor1_page_search", """
    SELECT doc_id, substr(regexp_replace(coalesce(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'this'))[1], ''),
           '^\\s+|\\s+$', '', 'g'), 1, 160) AS line FROM documents WHERE contains(lower(text), 'this') AND contains(lower(text), 'ent')""")
def cor1(spark, sf):
    return corpus.page_search(table(spark, sf, "documents"), "doc_id", "text", ["This", "ent"]).select("doc_id", "line")


@query("cor1_pattern_search", """
    SELECT page_id, count(*) AS n FROM pages WHERE regexp_matches(lower(html), 'class="ad">[a-z]+ the') GROUP BY 1""")
def cor1_pattern(spark, sf):
    out = corpus.page_search(table(spark, sf, "pages"), "page_id", "html", pattern='class="ad">[a-z]+ the')
    return out.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("win11_edge_lines", f"WITH {HEADS_SQL} SELECT doc_id, page, count(*) AS n, sum(length(s))::BIGINT AS chars FROM edge GROUP BY 1, 2")
def win11(spark, sf):
    rows = paged(spark, sf).select("doc_id", F.explode("pages").alias("p")).select(
        "doc_id", F.col("p.page").alias("page"), F.explode(corpus.edge_lines(F.col("p.lines"))).alias("l"))
    return rows.groupBy("doc_id", F.col("page").cast("bigint").alias("page")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(corpus.strip(F.col("l")))).alias("chars"))


@query("cor2_running_heads", f"WITH {HEADS_SQL} SELECT doc_id, key, n FROM heads")
def cor2(spark, sf):
    return corpus.running_heads(paged(spark, sf), "doc_id")


@query("cor3_normalise", f"WITH {BODIES_SQL} SELECT doc_id, page, length(body) AS chars, sha256(body) AS digest FROM bodies")
def cor3(spark, sf):
    out = corpus.normalised(paged(spark, sf), "doc_id").select("doc_id", F.explode_outer("bodies").alias("b")).filter("b IS NOT NULL")
    return out.select("doc_id", F.col("b.page").cast("bigint").alias("page"), F.length("b.body").cast("bigint").alias("chars"),
                      F.sha2("b.body", 256).alias("digest"))


def chunked(spark, sf):
    return corpus.chunks(corpus.normalised(paged(spark, sf), "doc_id"), "doc_id", SIZE, OVERLAP, LEAST)


@query("cor4_chunks", f"WITH {CHUNKS_SQL} SELECT doc_id, page, start, sha256(text) AS digest FROM chunked")
def cor4(spark, sf):
    return chunked(spark, sf).select("doc_id", F.col("page").cast("bigint").alias("page"), F.col("start").cast("bigint").alias("start"),
                                     F.sha2("text", 256).alias("digest"))


@query("cor7_excerpt_key", f"""WITH {CHUNKS_SQL}
    SELECT doc_id, start, substr(sha256(concat_ws(':', doc_id, page, start)), 1, 8) AS key FROM chunked""")
def cor7(spark, sf):
    return chunked(spark, sf).select("doc_id", F.col("start").cast("bigint").alias("start"),
                                     corpus.excerpt_key(F.col("doc_id"), F.col("page"), F.col("start")).alias("key"))


_STOP = ", ".join(f"'{w}'" for w in corpus.STOP)


def tokens_sql(name, source, key):
    return f"""{name} AS MATERIALIZED (SELECT {key}, w FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source})
        WHERE length(w) > 2 AND w NOT IN ({_STOP}))"""


@query("cor5_tokens", f"WITH {tokens_sql('t', 'documents', 'doc_id')} SELECT doc_id, w AS token, count(*) AS n FROM t GROUP BY 1, 2")
def cor5(spark, sf):
    words = dealt(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.explode_outer(corpus.tokens(F.col("text"))).alias("token")).filter("token IS NOT NULL")
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


BM25_SQL = f"""{tokens_sql('d', 'documents', 'doc_id')}, {tokens_sql('q', 'benchmark', 'item_id')},
    len AS (SELECT documents.doc_id, count(d.w) AS n FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id GROUP BY 1),
    tot AS (SELECT count(*) AS docs, avg(n) AS av FROM len),
    tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    bm AS MATERIALIZED (SELECT item_id, tf.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))) AS score
        FROM (SELECT DISTINCT item_id, w FROM q) q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN len ON len.doc_id = tf.doc_id, tot GROUP BY 1, 2),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""


def bm25_scores(spark, sf):
    return corpus.bm25(dealt(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


@query("cor6_bm25_top_k", f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 12")
def cor6(spark, sf):
    out = corpus.best(bm25_scores(spark, sf), 12, "item_id", "doc_id")
    return out.withColumn("score", r6(F.col("score")))


@query("top3_top_k_per_query", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 10""")
def top3(spark, sf):
    from gridspark.operators.ordered import top_k

    df = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = top_k(df, 10, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], ["l_suppkey"])
    return out.drop("l_extendedprice")


CENTROID_SQL = """
    e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS MATERIALIZED (SELECT label AS query, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(v[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1),
    near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT query, vec_id, label, q, v, round(list_cosine_similarity(v, q), 9) AS score FROM e, c))"""


def centroids(spark, sf):
    """The mean vector of each label: as many queries as there are labels."""
    parts = table(spark, sf, "embeddings").select(F.col("label").alias("query"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("query", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))


def nearest(spark, sf, k):
    return corpus.cosine_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", centroids(spark, sf), "query", "q", k)


@query("cor8_cosine_top_k", f"WITH {CENTROID_SQL} SELECT query, vec_id, round(score, 6) AS score, rank FROM near WHERE rank <= 15")
def cor8(spark, sf):
    return nearest(spark, sf, 15).withColumn("score", r6(F.col("score")))


_SECOND = f"""{CENTROID_SQL}, second AS (SELECT query, vec_id, rank AS first_rank, row_number() OVER (PARTITION BY query
    ORDER BY round(list_inner_product(v, v), 9) DESC, vec_id) AS second_rank, label FROM near WHERE rank <= 20)"""


def reranked(spark, sf):
    """Shortlist by cosine, ranked again by squared length."""
    e = table(spark, sf, "embeddings")
    size = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    second = e.select("vec_id", "label", size.alias("second"))
    return corpus.rerank(nearest(spark, sf, 20).join(second, "vec_id"), "query", "vec_id", "second")


@query("cor9_two_stage_rank", f"WITH {_SECOND} SELECT query, vec_id, first_rank, second_rank FROM second")
def cor9(spark, sf):
    return reranked(spark, sf).select("query", "vec_id", "first_rank", "second_rank")


@query("cor10_retrieval_metrics", f"""WITH {_SECOND},
    seen AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY min(second_rank)) AS r FROM second GROUP BY query, label),
    first AS (SELECT c.query, min(s.r) AS r FROM c LEFT JOIN seen s ON s.query = c.query AND s.label = c.query GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
           round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM first""")
def cor10(spark, sf):
    wanted = centroids(spark, sf).select("query", F.col("query").alias("label"))
    out = corpus.retrieval_metrics(reranked(spark, sf), "query", "label", "second_rank", wanted)
    return out.select("queries", *[r6(F.col(c)).alias(c) for c in ("recall_5", "recall_10", "mrr")])


GATE, SIGNATURE = r"\$\$\$", r"[#*]{3}|&amp"


@query("cor11_damaged_pages", f"""WITH {PAGES_SQL},
    p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines GROUP BY 1, 2)
    SELECT doc_id, string_agg(page, ',' ORDER BY page) AS damaged FROM p WHERE regexp_matches(t, '[#*]{{3}}|&amp')
    AND doc_id IN (SELECT doc_id FROM p WHERE regexp_matches(t, '\\$\\$\\$')) GROUP BY 1""")
def cor11(spark, sf):
    out = corpus.damaged_pages(paged(spark, sf), "doc_id", GATE, SIGNATURE)
    return out.select("doc_id", F.array_join(F.transform("damaged", lambda p: p.cast("string")), ",").alias("damaged"))


def table_pages(spark, sf):
    """Line items written out as table markup, one page per eight orders: at most a few dozen rows each."""
    li = table(spark, sf, "lineitem")
    td = lambda *cs: F.concat(*[x for c in cs for x in (F.lit("<td>"), c.cast("string"), F.lit("</td>"))])
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    row = F.concat(F.lit("<tr>"), td(F.col("l_orderkey"), F.col("l_linenumber"), price),
                   F.when(F.col("l_linenumber") <= 4, td(F.col("l_quantity"))).otherwise(td(F.col("l_quantity"), F.col("l_quantity"))),
                   F.lit("</tr>"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("p"), row.alias("r"))))
    grouped = li.groupBy(F.floor(F.col("l_orderkey") / 8).alias("page")).agg(rows.alias("_r"), F.min("l_suppkey").alias("_s"))
    caption = F.when(F.col("_s") % 7 == 0, "Values estimated from the graph").otherwise("Line items")
    return grouped.select("page", F.concat(F.lit("<p>text</p><table><caption>"), caption, F.lit("</caption>"),
                                           F.array_join(F.transform("_r", lambda s: s["r"]), ""), F.lit("</table>")).alias("html"))


@query("cor12_table_screens")
def cor12(spark, sf):
    return corpus.table_screens(corpus.page_tables(table_pages(spark, sf), "page", "html"), "page")


@query("cor13_strip_tables", """
    SELECT l_orderkey // 8 AS page, 1 AS tables, '<p>text</p>[table on page ' || l_orderkey // 8 || ', ' || (count(*) + CASE WHEN (l_orderkey // 8) % 3 = 0 THEN 1 ELSE 0 END) ||
           ' rows, not transcribed: "' || CASE WHEN min(l_suppkey) % 7 = 0 THEN 'Values estimated from the graph' ELSE 'Line items' END ||
           '". Cells read by OCR are not reproduced; open the scan for the numbers.]' AS text
    FROM lineitem GROUP BY l_orderkey // 8""")
def cor13(spark, sf):
    # every third page ends its table with a row that is never closed
    unclosed = F.when(F.col("page") % 3 == 0, F.replace("html", F.lit("</table>"), F.lit("<tr><td>0</td></table>"))).otherwise(F.col("html"))
    return corpus.strip_tables(table_pages(spark, sf).withColumn("html", unclosed), "page", "html")


@query("cor14_change_status", """
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'new' WHEN source = 'src9' THEN 'forced' WHEN source = 'src5' THEN 'errored'
        WHEN source = 'src7' THEN 'adopted' WHEN source = 'src3' THEN 'changed' ELSE 'unchanged' END AS status FROM documents""")
def cor14(spark, sf):
    docs = table(spark, sf, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("digest"), "source")
    then = docs.filter("lang <> 'fr'").select(
        "doc_id", F.when(F.col("source") != "src7", F.sha2(F.concat("text", F.when(F.col("source") == "src3", "!").otherwise("")), 256)).alias("digest"),
        F.when(F.col("source") == "src5", "ERROR").alias("state"))
    return corpus.change_status(now, then, "doc_id", F.col("source") == "src9")


@query("cor15_latest_records", """
    SELECT source, max(doc_id) AS doc_id, max_by(n_chars, doc_id) AS n_chars, max_by(lang, doc_id) AS lang FROM documents GROUP BY 1""")
def cor15(spark, sf):
    return corpus.latest_records(table(spark, sf, "documents"), "source", "doc_id", ["doc_id", "n_chars", "lang"])


@query("cor16_attach_evidence", f"""WITH {BM25_SQL}
    SELECT item_id, string_agg(doc_id, ',' ORDER BY rank) AS evidence FROM ranked WHERE rank <= 5 GROUP BY 1""")
def cor16(spark, sf):
    out = corpus.attach_evidence(corpus.best(bm25_scores(spark, sf), 5, "item_id", "doc_id"), "item_id", "doc_id", 5)
    return out.select("item_id", F.array_join(F.transform("evidence", lambda d: d.cast("string")), ",").alias("evidence"))


@query("jn14_relabel", f"""WITH {CHUNKS_SQL}
    SELECT c.doc_id, start, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS citation FROM chunked c
    JOIN documents d ON d.doc_id = c.doc_id LEFT JOIN labels l ON l.doc_id = c.doc_id""")
def jn14(spark, sf):
    held = chunked(spark, sf).select("doc_id", F.col("start").cast("bigint").alias("start")).join(
        table(spark, sf, "documents").select("doc_id", F.col("source").alias("citation")), "doc_id")
    fresh = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("citation"))
    return corpus.relabel(held, fresh, "doc_id", "citation")


@query("win10_jump_screen", """
    WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - lag(l_extendedprice) OVER w) AS step FROM lineitem
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey)),
    m AS (SELECT l_suppkey, list_sort(list(step))[count(*) // 2 + 1] AS typical FROM s WHERE step IS NOT NULL GROUP BY 1)
    SELECT s.l_suppkey, l_orderkey, l_linenumber, l_partkey, round(step, 2) AS step, round(typical, 2) AS typical FROM s
    JOIN m ON m.l_suppkey = s.l_suppkey WHERE typical > 0 AND step > 12 * typical""")
def win10(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = corpus.jump_screen(df, ["l_suppkey"], "l_extendedprice", ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"],
                             FromData())
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r6(F.col("step"), 2).alias("step"), r6(F.col("typical"), 2).alias("typical"))
