"""Session and table helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; shuffle partitions are left to the cluster's setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it isn't installed."""
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / here.name), "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(archive)
