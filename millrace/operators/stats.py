"""Descriptive statistics, as aggregates by group and as window forms.

Semantics: population variance unless asked for the sample's; quantiles interpolate linearly (type 7);
a mode's tie goes to the value that came first; geometric mean: 0 with a zero, NaN with a negative;
harmonic mean: 0 with a zero; NaN is no number and is refused by `checked`. Nulls are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import col


def checked(v: Column | str) -> Column:
    """The value; raises on NaN, as the statistics take numbers only."""
    c = col(v)
    return F.when(F.isnan(c), F.raise_error(F.lit("not a number: NaN")).cast("double")).otherwise(c)


def with_aggregates(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """df with aggregates of each row's group: by a join, or a scalar subquery where there is one group."""
    if by:
        return df.join(df.groupBy(*by).agg(*aggregates), by)
    found = df.agg(*aggregates)
    return df.withColumn("_all", found.select(F.struct(*found.columns)).scalar()).select(*df.columns, "_all.*")


def total(v: Column | str) -> Column:
    return F.sum(col(v))


def product(v: Column | str) -> Column:
    return F.product(col(v))


def mean(v: Column | str) -> Column:
    return F.avg(col(v))


def spread(v: Column | str) -> Column:
    """max - min"""
    return F.max(col(v)) - F.min(col(v))


def median(v: Column | str) -> Column:
    return F.median(col(v))


def quantile(v: Column | str, q: float) -> Column:
    if not 0 <= q <= 1:
        raise ValueError("q: 0 to 1")
    return F.percentile(col(v), F.lit(float(q)))


def percentile(v: Column | str, p: float) -> Column:
    return quantile(v, p / 100)


def iqr(v: Column | str) -> Column:
    return quantile(v, 0.75) - quantile(v, 0.25)


def variance(v: Column | str, sample: bool = False) -> Column:
    return (F.var_samp if sample else F.var_pop)(col(v))


def stddev(v: Column | str, sample: bool = False) -> Column:
    return (F.stddev_samp if sample else F.stddev_pop)(col(v))


def geomean(v: Column | str) -> Column:
    c = col(v)
    logs = F.exp(F.avg(F.when(c > 0, F.ln(c))))
    return F.when(F.min(c) < 0, F.lit(float("nan"))).when(F.min(c) == 0, F.lit(0.0)).otherwise(logs)


def harmean(v: Column | str) -> Column:
    c = col(v)
    return F.when(F.min(F.abs(c)) == 0, F.lit(0.0)).otherwise(F.count(c) / F.sum(F.when(c != 0, 1 / c)))


def mode_first(df: DataFrame, by: list[str], v: str, seq: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; among equals the one with the smallest `seq`."""
    counts = df.filter(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("_n"), F.min(seq).alias("_s"))
    # largest count, then smallest first arrival: one ordered struct, no sort
    best = F.max(F.struct(F.col("_n"), (-F.col("_s")).alias("_a"), F.col(v).alias("_v")))
    return counts.groupBy(*by).agg(best.getField("_v").alias(name))


def mad(df: DataFrame, by: list[str], v: str, name: str = "mad") -> DataFrame:
    """Median of the absolute deviations from the group's median."""
    keyed = with_aggregates(df, by, F.median(v).alias("_mid"))
    return keyed.groupBy(*by).agg(F.median(F.abs(F.col(v) - F.col("_mid"))).alias(name))


def histogram(df: DataFrame, v: str, bins: int | list[float] = 10, by: list[str] | None = None) -> DataFrame:
    """(by, bin, lo, hi, n) of the bins that have rows. The last bin includes its upper edge; values outside given edges don't count."""
    by = by or []
    d = df.filter(F.col(v).isNotNull())
    if isinstance(bins, list):
        edges = F.array(*[F.lit(float(e)) for e in bins])
        last = len(bins) - 2
        at = F.size(F.filter(edges, lambda e: e <= F.col(v))) - 1
        d = d.filter((F.col(v) >= bins[0]) & (F.col(v) <= bins[-1])).withColumn("bin", F.least(at, F.lit(last)))
        return d.groupBy(*by, "bin").agg(F.count("*").alias("n")).select(*by, "bin", F.get(edges, F.col("bin")).alias("lo"), F.get(edges, F.col("bin") + 1).alias("hi"), "n")
    keyed = with_aggregates(d, by, F.min(v).cast("double").alias("_lo"), F.max(v).cast("double").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(v) - F.col("_lo")) / F.when(step > 0, step)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = keyed.withColumn("bin", at).groupBy(*by, "bin", "_lo", "_hi").agg(F.count("*").alias("n"))
    return counts.select(*by, "bin", (F.col("_lo") + F.col("bin") * step).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * step).alias("hi"), "n")


def scaled(df: DataFrame, v: str, by: list[str], make, name: str) -> DataFrame:
    """Adds make(value, statistics of the group): the groups' aggregates are joined back, so no group is sorted or held."""
    c = F.col(v)
    keyed = with_aggregates(df, by, F.avg(c).alias("_avg"), F.stddev_pop(c).alias("_sd"), F.min(c).alias("_min"), F.max(c).alias("_max"))
    return keyed.withColumn(name, make(c)).drop("_avg", "_sd", "_min", "_max")


def zscore(df: DataFrame, v: str, by: list[str] | None = None, name: str = "zscore") -> DataFrame:
    """(value - mean) / population sd; 0 where the sd is 0."""
    return scaled(df, v, by or [], lambda c: F.when(F.col("_sd") > 0, (c - F.col("_avg")) / F.when(F.col("_sd") > 0, F.col("_sd"))).otherwise(0.0), name)


standardize = zscore


def normalize(df: DataFrame, v: str, by: list[str] | None = None, a: float = 0.0, b: float = 1.0, name: str = "normalized") -> DataFrame:
    """Min-max into [a, b]; a where all values are equal."""
    width = F.col("_max") - F.col("_min")
    return scaled(df, v, by or [], lambda c: F.when(width > 0, a + (c - F.col("_min")) * (b - a) / F.when(width > 0, width)).otherwise(F.lit(float(a))), name)


def top10(v: str, by: list[str], n: int = 10, percent: bool = False, bottom: bool = False) -> Column:
    """Conditional-format rule: among the n (or n percent) largest of the group."""
    w = W.partitionBy(*by).orderBy(F.col(v).asc() if bottom else F.col(v).desc())
    return F.percent_rank().over(w) * 100 < n if percent else F.rank().over(w) <= n


def above_average(v: str, by: list[str], below: bool = False, or_equal: bool = False) -> Column:
    avg = F.avg(v).over(W.partitionBy(*by))
    c = F.col(v)
    return (c <= avg if or_equal else c < avg) if below else (c >= avg if or_equal else c > avg)


def duplicated(v: str, by: list[str]) -> Column:
    return F.count(v).over(W.partitionBy(*by, v)) > 1


def unique(v: str, by: list[str]) -> Column:
    return F.count(v).over(W.partitionBy(*by, v)) == 1


#: Totals-row functions of a structured table.
TOTALS = {"sum": F.sum, "average": F.avg, "count": F.count, "countNums": F.count, "min": F.min, "max": F.max, "stdDev": F.stddev_samp, "var": F.var_samp}


def totals_row(df: DataFrame, functions: dict[str, str]) -> DataFrame:
    """The totals row of a table: {column: function name}."""
    return df.agg(*[TOTALS[f](c).alias(c) for c, f in functions.items()])


def subtotals(df: DataFrame, by: list[str], functions: dict[str, str]) -> DataFrame:
    """Subtotals at every level of `by`, and the grand total; `level` is the number of columns grouped by."""
    parts = [TOTALS[f](c).alias(c) for c, f in functions.items()]
    level = F.lit(len(by)) - sum((F.grouping(c).cast("int") for c in by), F.lit(0))
    return df.rollup(*by).agg(level.alias("level"), *parts)


def pivot(df: DataFrame, rows: list[str], columns: str, value: str, function: str = "sum", values: list | None = None) -> DataFrame:
    """A data-pilot table. Give `values` where known: else Spark runs a job to find them."""
    return df.groupBy(*rows).pivot(columns, values).agg(TOTALS[function](value))
