"""Trees as rows: (doc_id, path array<int>, kind, props map<string,string>, text).

A node's path holds its place among its siblings at each depth, so document order is path order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def walk(nodes: DataFrame) -> DataFrame:
    """All nodes in document order, depth first."""
    return nodes.orderBy("doc_id", "path")


def depth() -> Column:
    return F.size("path")


def parent() -> Column:
    return F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))


def under(path: list[int] | Column) -> Column:
    """Whether a node is a descendant of the one at a path."""
    p = F.array(*map(F.lit, path)) if isinstance(path, list) else path
    return (F.size("path") > F.size(p)) & (F.slice("path", F.lit(1), F.size(p)) == p)


def find_first(nodes: DataFrame, where: Column) -> DataFrame:
    """The first node of each document that fits."""
    rest = [c for c in nodes.columns if c != "doc_id"]
    return nodes.filter(where).groupBy("doc_id").agg(F.min_by(F.struct(*rest), "path").alias("_n")).select("doc_id", "_n.*")


def find_all(nodes: DataFrame, where: Column) -> DataFrame:
    return nodes.filter(where)


def text_content(nodes: DataFrame, between: str = "") -> DataFrame:
    """(doc_id, text): the text of all nodes in document order."""
    return nodes.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("_t")).select("doc_id", F.array_join(F.transform("_t", lambda x: x["text"]), between).alias("text"))


def replace_nodes(nodes: DataFrame, where: Column, **new: Column) -> DataFrame:
    """The same tree with columns of the nodes that fit replaced; `kind`, `props`, `text`."""
    return nodes.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def remove_nodes(nodes: DataFrame, where: Column) -> DataFrame:
    """Without the nodes that fit and what is under them."""
    gone = nodes.filter(where).select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"))
    # ancestors and the node itself: an equi-join on each prefix of the path
    prefixes = nodes.select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("_p"))
    hit = prefixes.join(gone, (F.col("doc_id") == F.col("_d")) & (prefixes["_p"] == gone["_p"]), "left_semi").select("doc_id", "path").distinct()
    return nodes.join(hit, ["doc_id", "path"], "left_anti")


def wrap_nodes(nodes: DataFrame, where: Column, kind: str) -> DataFrame:
    """Puts each node that fits under a new node of a kind, which takes its place."""
    tops = nodes.filter(where).select("doc_id", F.col("path").alias("_top"))
    prefixes = nodes.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("_pre"))
    inside = prefixes.join(tops, (prefixes["doc_id"] == tops["doc_id"]) & (F.col("_pre") == F.col("_top")), "left_semi").groupBy("doc_id", "path").agg(F.sort_array(F.collect_set(F.size("_pre"))).alias("_at"))
    d = nodes.join(inside, ["doc_id", "path"], "left")
    # after each wrapped level a 1 (the only child) is put in
    moved = F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.flatten(F.transform("path", lambda x, i: F.when(F.array_contains("_at", i + 1), F.array(x, F.lit(1))).otherwise(F.array(x)))))
    old = d.select("doc_id", moved.alias("path"), *[c for c in nodes.columns if c not in ("doc_id", "path")])
    new = d.filter(where).select("doc_id", F.slice(moved, F.lit(1), F.size(moved) - 1).alias("path"), F.lit(kind).alias("kind"), F.create_map().cast("map<string,string>").alias("props"), F.lit(None).cast("string").alias("text"))
    return old.unionByName(new.select(*old.columns) if set(old.columns) == set(new.columns) else new, allowMissingColumns=True)


def flatten_nodes(nodes: DataFrame, where: Column) -> DataFrame:
    """Drops the nodes that fit and puts their children in their place; order is kept, paths gain a level there."""
    return nodes.filter(~where)


def clone(nodes: DataFrame) -> DataFrame:
    return nodes.select("*")
