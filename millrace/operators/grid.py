"""Spreadsheet grids as long tables (keys..., row, col, value); row and col count from 1.

Empty cells are absent, null or ''. A grid's used size is its last row and column with a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col


def column_name(n: Column | str) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA; up to XFD and beyond (seven letters)."""
    c = col(n).cast("long")
    out, rest = F.lit(""), c
    for _ in range(7):
        out = F.when(rest > 0, F.concat(F.char(F.lit(65) + F.pmod(rest - 1, F.lit(26))), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return out


def cell_address(row: Column | str, column: Column | str) -> Column:
    return F.concat(column_name(column), col(row).cast("string"))


def address_parts(a: Column | str) -> Column:
    """struct<row, col> of an address such as $B$7."""
    letters = F.upper(F.regexp_extract(col(a), r"^\$?([A-Za-z]+)\$?\d+$", 1))
    number = F.aggregate(F.split(letters, ""), F.lit(0), lambda s, c: s * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))
    return F.when(letters != "", F.struct(F.regexp_extract(col(a), r"(\d+)$", 1).cast("int").alias("row"), number.alias("col")))


def in_range(cells: DataFrame, ref: str) -> DataFrame:
    """The cells of a range such as A2:C10."""
    import re

    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?", ref)
    number = lambda s: sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(s)))
    c1, r1 = number(m[1]), int(m[2])
    c2, r2 = (number(m[3]), int(m[4])) if m[3] else (c1, r1)
    return cells.filter(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))


def filled(cells: DataFrame) -> DataFrame:
    return cells.filter(F.coalesce(F.col("value"), F.lit("")) != "")


def used_size(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, cols)"""
    return filled(cells).groupBy(*keys).agg(F.max("row").cast("int").alias("rows"), F.max("col").cast("int").alias("cols"))


def padded_size(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells): what normalising would make, known before it is made."""
    return used_size(cells, keys).select(*keys, (F.col("rows").cast("long") * F.col("cols")).alias("cells"))


def normalized(cells: DataFrame, keys: list[str], most_cells: int = 5_000_000) -> DataFrame:
    """The complete rectangle of each grid: trailing empty rows and columns gone, gaps filled with ''.

    A grid over most_cells raises an error before anything is filled in.
    """
    size = used_size(cells, keys).withColumn("_ok", F.when(F.col("rows").cast("long") * F.col("cols") > most_cells, F.raise_error(F.lit("the grid has too many cells")).cast("int")).otherwise(1))
    full = size.filter("_ok = 1").select(*keys, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"), "cols").select(*keys, "row", F.explode(F.sequence(F.lit(1), F.col("cols"))).alias("col"))
    return full.join(filled(cells).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value"), [*keys, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def grid_rows(cells: DataFrame, keys: list[str], most_cells: int = 5_000_000) -> DataFrame:
    """(keys, row, values): a row of texts for each row of the normalised grid."""
    n = normalized(cells, keys, most_cells)
    return n.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("_c")).select(*keys, "row", F.transform("_c", lambda c: c["value"]).alias("values"))


def csv_line(values: Column, delimiter: str = ",", quote: str = '"') -> Column:
    special = f"[{delimiter}{quote}\\r\\n]"
    one = lambda v: F.when(v.rlike(special), F.concat(F.lit(quote), F.replace(v, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(v)
    return F.array_join(F.transform(values, one), delimiter)


def to_csv(cells: DataFrame, keys: list[str], newline: str = "\r\n") -> DataFrame:
    """(keys, csv)"""
    lines = grid_rows(cells, keys).select(*keys, "row", csv_line(F.col("values")).alias("line"))
    return whole(lines, keys, "csv", newline)


def to_tsv(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tsv, escaped): tab, line ends and backslash as backslash sequences; whether there were any."""
    esc = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    r = grid_rows(cells, keys)
    lines = r.select(*keys, "row", F.array_join(F.transform("values", esc), "\t").alias("line"), F.exists("values", lambda v: v.rlike(r"[\t\r\n\\]")).alias("_e"))
    text = whole(lines, keys, "tsv", "\n")
    return text.join(lines.groupBy(*keys).agg(F.max("_e").alias("escaped")), keys)


def whole(lines: DataFrame, keys: list[str], name: str, newline: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("_l")).select(*keys, F.array_join(F.transform("_l", lambda x: x["line"]), newline).alias(name))


def unpadded_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, values): rows up to their own last value; rows without one are left out."""
    f = filled(cells)
    ends = f.groupBy(*keys, "row").agg(F.max("col").cast("int").alias("_n"), F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"))
    return ends.select(*keys, "row", F.transform(F.sequence(F.lit(1), F.col("_n")), lambda k: F.coalesce(F.element_at("_m", k.cast(cells.schema["col"].dataType)), F.lit(""))).alias("values"))


def sparse_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, line): `A1: text` of each cell with a value."""
    return filled(cells).select(*keys, "row", "col", F.concat(cell_address("row", "col"), F.lit(": "), F.col("value")).alias("line"))


def expand_repeats(cells: DataFrame, row_repeat: str = "row_repeat", col_repeat: str = "col_repeat", most: int | None = None) -> DataFrame:
    """Run-length cells: rows and columns repeated in full, or up to `most` times where it is given."""
    full = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    times = lambda c: full(c) if most is None else F.least(full(c), F.lit(most))
    d = cells.withColumn("_r", F.explode(F.sequence(F.lit(0), times(row_repeat) - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), times(col_repeat) - 1)))
    return d.withColumn("row", F.col("row") + F.col("_r")).withColumn("col", F.col("col") + F.col("_c")).drop("_r", "_c", row_repeat, col_repeat)
