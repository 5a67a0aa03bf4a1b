"""CSV: reading with per-cell casts, and writing.

`read` splits files by lines and uses Spark's reader where the options allow; `read_exact` reads each
file whole, which the options that count lines of a file need.
"""

from __future__ import annotations

import csv
import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col

SAFE = (1 << 53) - 1


@dataclass(frozen=True)
class Options:
    delimiter: str = ","
    quote: str = '"'
    header: bool = False
    skip_empty: bool = True
    trim: bool = False
    comment: str = ""
    skip_lines: int = 0


def parse(text: str, o: Options = Options()) -> list[list[str]]:
    """The rows of a CSV text. LF, CR and CRLF end lines; a byte order mark is dropped; an unclosed quote raises ValueError.

    A row whose only field is empty is skipped (skip_empty), even if it was quoted; so is one whose
    first field begins with the comment sign, quoted or not; skip_lines counts the rows left.
    """
    text = text.removeprefix("﻿")
    rows: list[list[str]] = []
    token = re.compile(f"{re.escape(o.quote)}((?:[^{re.escape(o.quote)}]|{re.escape(o.quote)}{{2}})*)({re.escape(o.quote)}?)")
    plain = re.compile(f"[^{re.escape(o.delimiter)}\r\n]*")
    at, row = 0, []
    while at < len(text) or row:
        if at < len(text) and text[at] == o.quote:
            m = token.match(text, at)
            if not m[2]:
                raise ValueError(f"csv: the quote at {at} isn't closed")
            rest = plain.match(text, m.end())
            value, at, bare = m[1].replace(o.quote * 2, o.quote) + rest[0], rest.end(), False
        else:
            m = plain.match(text, at)
            value, at, bare = m[0], m.end(), True
        row.append(value.strip() if o.trim and bare else value)
        if text[at : at + 1] == o.delimiter:
            at += 1
            if at == len(text):
                row.append("")
            else:
                continue
        at += 2 if text[at : at + 2] == "\r\n" else 1
        rows.append(row)
        row = []
    kept = [r for r in rows if not (o.skip_empty and r == [""]) and not (o.comment and r[0].startswith(o.comment))]
    return kept[o.skip_lines :]


def cast_text(s: str):
    """A cell by its own look: empty text stays; null, true, false; whole numbers up to 2^53 - 1; decimals; else text."""
    if s == "null":
        return None
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"-?(?:0|[1-9]\d*)", s):
        return int(s) if abs(int(s)) <= SAFE else s
    if re.fullmatch(r"-?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?", s) and math.isfinite(float(s)):
        return float(s) if not re.fullmatch(r"-?\d+", s) else s
    return s


def cast(c: Column | str) -> Column:
    """cast_text as a variant column."""
    s = col(c)
    number = s.rlike(r"^-?(?:0|[1-9]\d*)$") & (F.length(s) < 18) & (F.abs(F.expr("0") + F.try_to_number(s, F.lit("S" + "9" * 18))) <= SAFE)
    decimal = s.rlike(r"^-?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?$|^-?\d+[eE][+-]?\d+$")
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^(?=\.)|(?<=^-)(?=\.)", "0"), r"\.(?=[eE]|$)", ".0"), r"^(-?)0+(?=\d)", "$1")
    plain = F.when(s.isin("null", "true", "false") | F.coalesce(number, F.lit(False)), s).when(decimal, fixed)
    return F.parse_json(F.coalesce(plain, F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)))


def read(spark: SparkSession, path: str, schema: T.StructType | str, o: Options = Options(header=True)) -> DataFrame:
    """Typed columns by a schema; values that don't fit are null. Not for skip_lines, trim or quoted comment fields."""
    if o.skip_lines or o.comment:
        raise ValueError("use read_exact for skip_lines and comment")
    r = spark.read.schema(schema).option("sep", o.delimiter).option("quote", o.quote).option("escape", o.quote).option("header", o.header).option("multiLine", True)
    r = r.option("nullValue", "\0").option("emptyValue", "").option("mode", "PERMISSIVE").option("enforceSchema", not o.header)
    return r.option("ignoreLeadingWhiteSpace", o.trim).option("ignoreTrailingWhiteSpace", o.trim).csv(path)


def read_exact(spark: SparkSession, path: str, o: Options = Options()) -> DataFrame:
    """(file, row, values array<string>), or with a header (file, row, values map<string,string>): missing cells absent, extra ones dropped. A file is one row of a task."""
    kind = "map<string,string>" if o.header else "array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                rows = parse(bytes(data).decode("utf-8"), o)
                if o.header:
                    names, rows = (rows[0], rows[1:]) if rows else ([], [])
                    rows = [dict(zip(names, r, strict=False)) for r in rows]
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pd.DataFrame({"file": file, "row": range(k + 1, k + 1 + len(part)), "values": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, row int, values {kind}")


def stringify(rows: list, delimiter: str = ",", quote: str = '"', newline: str = "\r\n", header: bool = True) -> str:
    """Rows (lists, or dicts whose columns are the first one's) as CSV; null is empty, times in ISO form."""
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, quotechar=quote, lineterminator=newline)
    text = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else v.isoformat() if hasattr(v, "isoformat") else v
    if rows and isinstance(rows[0], dict):
        names = list(rows[0])
        if header:
            w.writerow(names)
        rows = [[r.get(n) for n in names] for r in rows]
    for r in rows:
        w.writerow([text(v) for v in r])
    return out.getvalue()


def write(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """A folder of CSV files with CRLF line ends (lone CR and LF in values are quoted)."""
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    rows = df.select(F.concat_ws(delimiter, *[quoted(F.coalesce(c.cast("string"), F.lit("")), delimiter) for c in iso]).alias("value"))
    if header:
        # each file begins with the names, as readers of a folder expect
        names = delimiter.join(stringify([[c]], delimiter, newline="") for c in df.columns)
        rows = rows.mapInArrow(with_header(names), "value string")
    rows.write.mode(mode).option("lineSep", "\r\n").text(path)


def quoted(c: Column, delimiter: str) -> Column:
    return F.when(c.rlike(f"[{re.escape(delimiter)}\"\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def with_header(names: str):
    import pyarrow as pa

    def run(batches):
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([names], b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    return run
