"""Small document tables with the awkward cases that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
BASE = " ".join(f"word{i}" for i in range(100))


def rows() -> list[tuple]:
    near = BASE.replace("word50 ", "other ")
    texts = [None, "", " \t\n ", "a", "A b", LONG, BASE, near, BASE, BASE.upper(), "é ü 日本 \x00 <|endoftext|>", "x" * 5000]
    out = [(i, t, "en", f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    out += [(20, BASE, None, None, None), (21, "one two three four five", "fr", None, 23), (21, "one two three four five", "fr", None, 23)]
    return out


def documents(spark, with_null_id: bool = True, extra: bool = True):
    data = rows() + ([(None, "no id here", "en", "s0", 10)] if with_null_id else [])
    df = spark.createDataFrame(data, SCHEMA)
    if extra:  # names that operators use themselves
        from pyspark.sql import functions as F

        for name in ("size", "target", "_hash", "media", "feature", "key", "shard", "rate", "copies", "sig", "rep", "wrapper", "host", "score"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
