"""Lookups: keyed values, shared strings, references, inherited styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, values: DataFrame, key: str, value: str, name: str, small_bytes: int = 0) -> DataFrame:
    """Adds `name`: the value of the key, null if there is none. values: one row for each key.

    The join strategy is left to Spark, which broadcasts a side only below its size threshold.
    """
    return df.join(values.select(F.col(key).alias("_k"), F.col(value).alias(name)), F.col(key) == F.col("_k"), "left").drop("_k")


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """cells (file, ..., type, value) with type 's' refer to strings (file, index, text)."""
    at = F.when(F.col("type") == "s", F.expr("try_cast(value as int)"))
    s = strings.select(F.col("file").alias("_f"), F.col("index").alias("_i"), "text")
    joined = cells.withColumn("_at", at).join(s, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_i")), "left")
    return joined.withColumn("value", F.when(F.col("type") == "s", F.col("text")).otherwise(F.col("value"))).drop("_at", "_f", "_i", "text")


def label_of(c):
    """A link label in its normal form: case folded, inner white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def resolve_references(links: DataFrame, definitions: DataFrame) -> DataFrame:
    """links (doc_id, label, ...) with url and title of definitions (doc_id, label, seq, url, title); the first definition of a label holds."""
    first = definitions.withColumn("_l", label_of(F.col("label"))).groupBy("doc_id", "_l").agg(F.min_by(F.struct("url", "title"), "seq").alias("_d"))
    return links.withColumn("_l", label_of(F.col("label"))).join(first, ["doc_id", "_l"], "left").select(*links.columns, "_d.url", "_d.title")


def style_cascade(styles: DataFrame, properties: list[str], depth: int = 12) -> DataFrame:
    """styles (style_id, based_on, properties...): each style's own value, else that of its nearest ancestor within `depth` steps. Cycles end there."""
    own = styles.select("style_id", "based_on", *properties)
    out = own.withColumn("_up", F.col("based_on"))
    hops = 1
    while hops < depth:  # ancestors at 1, 2, 4, ... steps: the reach doubles each time
        up = out.select(F.col("style_id").alias("_id"), F.col("_up").alias("_next"), *[F.col(p).alias(f"_{p}") for p in properties])
        out = out.join(up, F.col("_up") == F.col("_id"), "left").select("style_id", "based_on", *[F.coalesce(p, f"_{p}").alias(p) for p in properties], F.col("_next").alias("_up"))
        hops *= 2
    return out.drop("_up")


def first_per_key(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(seq)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
