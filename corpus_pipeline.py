"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, secret scan, source mix.

Each stage gets what its predecessor kept, as `docs` with the columns of documents (others pass
through), and is written as Parquet to the shared folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, language_id, mixing, neardup, secrets
from millrace.llm.common import fresh, new_folder, same_columns, table

#: Below this posterior probability a text's language counts as unknown.
SURE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language (no letter, or no language more likely than all others together); fills in a missing lang."""
    model = language_id.fit(docs)
    lang, sure = fresh(docs, "_lang"), fresh(docs, "_sure")
    known = language_id.predict(docs, model, names=(lang, sure)).filter((F.col(lang) != language_id.UNKNOWN) & (F.col(sure) >= SURE))
    return same_columns(known.withColumn("lang", F.coalesce("lang", lang)), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id."""
    gone = neardup.near_duplicates(docs, shingle=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return same_columns(docs.join(gone, "doc_id", "left_anti"), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark occurs."""
    found = fresh(docs, "matches")
    return same_columns(decontam.matches(docs, table(spark, sf_dir, "benchmark"), name=found).filter(F.size(found) == 0), docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks accepted secrets in the text; n_chars follows. No document is dropped."""
    found, clean = fresh(docs, "findings"), fresh(docs, "clean_text")
    scanned = secrets.scan(docs, secrets.fit(), names=(found, clean))
    changed = ~F.col(clean).eqNullSafe(F.col("text"))
    return same_columns(scanned.withColumn("n_chars", F.when(changed, F.length(clean)).otherwise(F.col("n_chars")).cast("long")).withColumn("text", F.col(clean)), docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken): how often the mix takes each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", masked_secrets),
    ("mixing sources", mixed_sources),
]

#: SQL can't express the forward pass, the forest or the rates; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
