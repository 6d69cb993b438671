"""The registered queries of this subpackage: thin, whole-table uses of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import ready, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def keep(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        return fn

    return keep


@query("op2_line_dedup")
def op2(spark, sf_dir):
    from gridspark.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@query("op5_source_mix")
def op5(spark, sf_dir):
    from gridspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_benchmark_decontamination")
def op9(spark, sf_dir):
    from gridspark.llm.decontam import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    from gridspark.llm.toxicity import THRESHOLD, fit, held_out, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


@query("op3_minhash_near_dedup")
def op3(spark, sf_dir):
    from gridspark.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("k")


@query("op8_embedding_near_dedup")
def op8(spark, sf_dir):
    from gridspark.llm.pivots import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_secret_scan")
def op6(spark, sf_dir):
    from gridspark.llm.secrets import KINDS, scan_secrets, span_list

    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts[:3], F.sha2(span_list(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"), span_list(*KINDS).alias("spans"))


@query("op10_html_extraction")
def op10(spark, sf_dir):
    from gridspark.llm.html_blocks import filler, main_text, trained

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = main_text(pages, trained(filler(pages)))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    from gridspark.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op7_token_counts")
def op7(spark, sf_dir):
    from gridspark.llm.token_spans import section_tokens, vocabulary

    out = section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    whole = F.transform("section_tokens", lambda x: x.cast("long"))
    return out.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"),
                      F.aggregate("section_crossing", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_crossing"), whole.alias("section_tokens"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    from gridspark.llm.conversations import damaged, digests, repair

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(repair(damaged(rows), ids=rows))


@query("op12_hard_negatives")
def op12(spark, sf_dir):
    from gridspark.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


@query("op13_quality")
def op13(spark, sf_dir):
    from gridspark.llm.quality import THRESHOLD, fit, quality
    from gridspark.llm.toxicity import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, fit(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
