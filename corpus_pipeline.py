"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept, and returns a
DataFrame; `run` writes it as Parquet in the shared folder and reads it back as the next one's input.
The SQL check is left out: the toxicity model cannot be said in SQL, so tests hold every stage against
a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import ready, row_key, table
from gridspark.llm.decontam import decontaminate
from gridspark.llm.line_dedup import line_dedup
from gridspark.llm.minhash import near_duplicates
from gridspark.llm.mixing import mix
from gridspark.llm.toxicity import THRESHOLD, fit, toxicity
from gridspark.session import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score the threshold or more go; the rest stay as they are.

    Null and empty texts score the model's base probability. Repeated rows are scored alike; null ids stay.
    Of further columns, here as in the later stages, only those of `COLUMNS` go on; no rows give no rows.
    """
    ready(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).filter(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier document holds; n_chars follows the text.

    A null text stays null with its n_chars; rows of one doc_id are one document, so none loses a line to
    another; a row with a null doc_id loses nothing.
    """
    ready(spark)
    out = line_dedup(docs)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", changed.alias("n_chars"))


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Texts without words and rows with a null doc_id stay. Rows of one doc_id are one document: they stay or
    go together, repeated rows included.
    """
    ready(spark)
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct()
    keyed = docs.withColumn("_row", row_key("doc_id", "text"))
    return keyed.join(gone.hint("shuffle_hash"), (keyed["_row"] == gone["_k"]) & (keyed["doc_id"] == gone["_id"]), "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; the rest stay as they are.

    Null and empty texts hold no window and stay; repeated rows are judged alike, null ids as well.
    """
    ready(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and in how many copies.

    A null text has no words and gives none; a null source is a source, the last in order; repeated rows are
    documents of their own.
    """
    ready(spark)
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_near_duplicate),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
