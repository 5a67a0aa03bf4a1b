"""Ordered maps, prefix maps, heaps, ring buffers, caches and keyed stores, as operations on DataFrames.

`seq` names the column that gives the order of arrival; a DataFrame has none of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order (TakeOrderedAndProject: each task keeps k)."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key. Spark keeps k of each key before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank_in_key", F.row_number().over(w)).filter(F.col("rank_in_key") <= k)


def heap_drain(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)


def heap_peek(df: DataFrame, *order: Column) -> DataFrame:
    return top_k(df, 1, *order)


def heap_bounded(df: DataFrame, most: int) -> DataFrame:
    """The rows, or an error if there are more than a bounded heap takes."""
    n = df.agg(F.count("*").alias("n"))
    full = n.select(F.when(F.col("n") > most, F.raise_error(F.lit(f"heap: more than {most} items")).cast("boolean")).otherwise(True).alias("_ok"))
    return df.filter(full.scalar())


def has(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1).agg((F.count("*") > 0).alias("found"))


def key_range(df: DataFrame, key: str, low=None, high=None, include_low: bool = True, include_high: bool = False) -> DataFrame:
    """Half open unless told otherwise; pushed down to the scan."""
    c = F.col(key)
    if low is not None:
        df = df.filter(c >= low if include_low else c > low)
    if high is not None:
        df = df.filter(c <= high if include_high else c < high)
    return df


def prefix_search(df: DataFrame, key: str, prefix: str | Column, limit: int | None = None) -> DataFrame:
    """Keys that begin with a prefix, in key order."""
    found = df.filter(F.col(key).startswith(prefix)).orderBy(key)
    return found if limit is None else found.limit(limit)


def has_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.filter(F.col(key).startswith(prefix)).limit(1).agg((F.count("*") > 0).alias("found"))


def entries(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def first_last(df: DataFrame, key: str, value: str) -> DataFrame:
    """The smallest and the largest key with their values."""
    return df.agg(F.min(key).alias("min_key"), F.min_by(value, key).alias("min_value"), F.max(key).alias("max_key"), F.max_by(value, key).alias("max_value"))


def latest(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The last row of each key, by aggregation: one struct per key and task is shuffled, and no key is sorted."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(seq)).alias("_r")
    return df.groupBy(*by).agg(best).select(*by, "_r.*").select(df.columns)


def upsert(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old with the rows of new, which replace those with equal keys. new: one row for each key."""
    return old.join(new.select(*by), by, "left_anti").unionByName(new)


def delete(df: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    return df.join(keys.select(*by).distinct(), by, "left_anti")


def last_n(df: DataFrame, by: list[str], n: int, seq: str) -> DataFrame:
    """A ring buffer of n rows for each key."""
    return top_k_per_key(df, by, n, F.col(seq).desc())


def lru(accesses: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """The keys a least-recently-used cache holds in the end, latest first."""
    return accesses.groupBy(key).agg(F.max(seq).alias("last_used")).orderBy(F.col("last_used").desc(), key).limit(capacity)


def window_of(df: DataFrame, offset: int, count: int, *order: Column) -> DataFrame:
    """The visible rows of a long list."""
    return df.orderBy(*order).offset(offset).limit(count)


class Store:
    """A keyed store over a log of changes (key, value, op: set | del | clear, seq)."""

    def __init__(self, log: DataFrame):
        self.log = log

    def state(self) -> DataFrame:
        """(key, value) after all changes: what was set last, after the last clear."""
        cleared = self.log.agg(F.max(F.when(F.col("op") == "clear", F.col("seq"))).alias("_c"))
        live = self.log.filter("op <> 'clear'").filter(F.col("seq") > F.coalesce(cleared.scalar(), F.lit(-(1 << 62))))
        return latest(live, ["key"], "seq").filter("op = 'set'").select("key", "value")

    def get(self, key: str) -> DataFrame:
        return self.state().filter(F.col("key") == key)

    def set(self, rows: DataFrame) -> Store:
        return Store(self.log.unionByName(rows.select("key", "value", F.lit("set").alias("op"), "seq")))

    def delete(self, keys: DataFrame) -> Store:
        return Store(self.log.unionByName(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit("del").alias("op"), "seq")))

    def count(self, low=None, high=None) -> DataFrame:
        return key_range(self.state(), "key", low, high).agg(F.count("*").alias("n"))

    def prefix(self, prefix: str) -> DataFrame:
        """Namespaced keys."""
        return prefix_search(self.state(), "key", prefix)

    def changes(self) -> DataFrame:
        return self.log.orderBy("seq")
