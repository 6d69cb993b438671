from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(spark, rows):
    """Documents from (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows], COLUMNS)


def crowded(df):
    """The same rows with extra columns whose names an operator may want for itself."""
    for name in ("k", "_k", "key", "n", "m", "label", "score", "bytes", "_bytes", "runs", "start", "node", "_key", "_id", "size", "found", "at", "h1"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df
