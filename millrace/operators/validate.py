"""Schemas, filters and conditional formats compiled to Columns.

A schema is a dict with the usual keywords: type, enum, const, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, minLength, maxLength, pattern, format, items, minItems, maxItems,
uniqueItems, properties, required, allOf, anyOf, oneOf, not. Null is a missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Patterns of the named formats.
FORMATS = {
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$",
    "time": r"^(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$",
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$",
    "hostname": r"^(?=.{1,253}$)(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.?)+$",
}


def is_number(c: Column) -> Column:
    """A number that isn't NaN or infinite."""
    return F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False))


TYPES: dict[str, tuple[str, ...]] = {
    "string": ("string",), "boolean": ("boolean",), "integer": ("tinyint", "smallint", "int", "bigint"),
    "number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "array": ("array",), "object": ("struct", "map"), "null": ("void",),
}


def of_type(c: Column, name: str) -> Column:
    kind = F.substring_index(F.substring_index(F.typeof(c), "(", 1), "<", 1)
    if name == "null":
        return c.isNull()
    right = kind.isin(*TYPES[name])
    return c.isNotNull() & (right & is_number(c) if name in ("number",) else right)


def checks(c: Column, schema: dict, path: str = "$") -> list[tuple[str, str, Column]]:
    """(path, keyword, whether it holds) of a value that is there. Missing values fail `required` only."""
    out: list[tuple[str, str, Column]] = []

    def check(keyword: str, ok: Column) -> None:
        out.append((path, keyword, c.isNull() | F.coalesce(ok, F.lit(False))))

    s = schema
    if "type" in s:
        names = s["type"] if isinstance(s["type"], list) else [s["type"]]
        ok = F.lit(False)
        for n in names:
            ok = ok | (F.lit(True) if n in ("object", "array") else of_type(c, n))
        check("type", ok)
    if "enum" in s:
        check("enum", c.isin(*s["enum"]))
    if "const" in s:
        check("const", c == s["const"])
    for keyword, op in (("minimum", "__ge__"), ("maximum", "__le__"), ("exclusiveMinimum", "__gt__"), ("exclusiveMaximum", "__lt__")):
        if keyword in s:
            check(keyword, getattr(c, op)(s[keyword]))
    if "multipleOf" in s:
        check("multipleOf", F.pmod(c, F.lit(s["multipleOf"])) == 0)
    if "minLength" in s:
        check("minLength", F.length(c) >= s["minLength"])
    if "maxLength" in s:
        check("maxLength", F.length(c) <= s["maxLength"])
    if "pattern" in s:
        check("pattern", c.rlike(s["pattern"]))
    if "format" in s and s["format"] in FORMATS:
        check("format", c.rlike(FORMATS[s["format"]]))
    if "minItems" in s:
        check("minItems", F.size(c) >= s["minItems"])
    if "maxItems" in s:
        check("maxItems", F.size(c) <= s["maxItems"])
    if s.get("uniqueItems"):
        check("uniqueItems", F.size(c) == F.size(F.array_distinct(c)))
    if "items" in s:
        check("items", F.forall(c, lambda x: holds(x, s["items"])))
    for name in s.get("required", ()):
        out.append((f"{path}.{name}", "required", c[name].isNotNull()))
    for name, inner in s.get("properties", {}).items():
        out += checks(c[name], inner, f"{path}.{name}")
    if "allOf" in s:
        for k, inner in enumerate(s["allOf"]):
            out += checks(c, inner, f"{path}/allOf/{k}")
    if "anyOf" in s:
        check("anyOf", any_of([holds(c, x) for x in s["anyOf"]]))
    if "oneOf" in s:
        check("oneOf", sum((holds(c, x).cast("int") for x in s["oneOf"]), F.lit(0)) == 1)
    if "not" in s:
        check("not", ~holds(c, s["not"]))
    return out


def any_of(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def holds(c: Column, schema: dict) -> Column:
    out = F.lit(True)
    for _, _, ok in checks(c, schema):
        out = out & ok
    return out


def row_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def test(df: DataFrame, schema: dict, name: str = "valid") -> DataFrame:
    """Whether each row fits the schema of an object."""
    return df.withColumn(name, holds(row_struct(df), schema))


def errors(df: DataFrame, schema: dict, name: str = "errors") -> DataFrame:
    """array<struct<path, keyword>> of what fails in each row."""
    found = [F.when(~ok, F.struct(F.lit(p).alias("path"), F.lit(k).alias("keyword"))) for p, k, ok in checks(row_struct(df), schema)]
    empty = F.array().cast("array<struct<path:string,keyword:string>>")
    return df.withColumn(name, F.array_compact(F.array(*found)) if found else empty)


# Autofilter of a structured table: {column: criterion}


def wildcard(text: str) -> str:
    """* and ? as in a spreadsheet filter; ~ escapes."""
    import re

    return "(?is)^" + re.sub(r"~([*?~])|\*|\?|[^*?~]+|~", lambda m: re.escape(m[1]) if m[1] else {"*": ".*", "?": "."}.get(m[0], re.escape(m[0])), text) + "$"


COMPARE: dict[str, Callable] = {
    "equal": lambda c, v: c.cast("string").rlike(wildcard(str(v))) if isinstance(v, str) else c == v,
    "notEqual": lambda c, v: ~c.cast("string").rlike(wildcard(str(v))) if isinstance(v, str) else c != v,
    "lessThan": lambda c, v: c < v, "lessThanOrEqual": lambda c, v: c <= v, "greaterThan": lambda c, v: c > v, "greaterThanOrEqual": lambda c, v: c >= v,
}


def autofilter(df: DataFrame, criteria: dict[str, dict]) -> DataFrame:
    """criteria: values (list, blank), custom ([(operator, value)], and), top10 (n, percent, bottom), dynamic (aboveAverage, belowAverage)."""
    for name, k in criteria.items():
        c = F.col(name)
        if "values" in k:
            df = df.filter(c.isin(*k["values"]) | (c.isNull() if k.get("blank") else F.lit(False)))
        if "custom" in k:
            parts = [COMPARE[op](c, v) for op, v in k["custom"]]
            every = parts[0]
            for p in parts[1:]:
                every = (every & p) if k.get("and") else (every | p)
            df = df.filter(every)
        if "top10" in k:
            # the bound is an aggregate: no global sort in one task
            n, bottom = k["top10"], k.get("bottom", False)
            order = c.asc() if bottom else c.desc()
            if k.get("percent"):
                edge = df.agg(F.percentile(c, F.lit(n / 100 if bottom else 1 - n / 100)).alias("_e"))
            else:
                edge = df.filter(c.isNotNull()).orderBy(order).limit(n).agg((F.max if bottom else F.min)(c).alias("_e"))
            df = df.filter(c <= edge.scalar() if bottom else c >= edge.scalar())
        if "dynamic" in k:
            avg = df.agg(F.avg(c).alias("_a"))
            df = df.filter(c > avg.scalar() if k["dynamic"] == "aboveAverage" else c < avg.scalar())
    return df


def filter_tree(tree: dict) -> Column:
    """An ODF filter: {and: [...]}, {or: [...]}, {field, operator, value, case}, {field, set: [...]}."""
    if "and" in tree:
        out = F.lit(True)
        for t in tree["and"]:
            out = out & filter_tree(t)
        return out
    if "or" in tree:
        return any_of([filter_tree(t) for t in tree["or"]])
    c = F.col(tree["field"])
    if "set" in tree:
        return c.isin(*tree["set"])
    op, v = tree["operator"], tree.get("value")
    text = c.cast("string")
    fold = (lambda x: x) if tree.get("case") else F.lower
    value = F.lit(v) if not isinstance(v, str) else fold(F.lit(v))
    left = c if not isinstance(v, str) else fold(text)
    table: dict[str, Callable[[], Column]] = {
        "=": lambda: left == value, "!=": lambda: left != value, "<": lambda: left < value, "<=": lambda: left <= value, ">": lambda: left > value, ">=": lambda: left >= value,
        "match": lambda: text.rlike(v), "!match": lambda: ~text.rlike(v), "begins": lambda: left.startswith(value), "!begins": lambda: ~left.startswith(value),
        "ends": lambda: left.endswith(value), "!ends": lambda: ~left.endswith(value), "contains": lambda: left.contains(value), "!contains": lambda: ~left.contains(value),
        "empty": lambda: F.coalesce(text, F.lit("")) == "", "!empty": lambda: F.coalesce(text, F.lit("")) != "",
    }
    return table[op]()


def conditional_format(rule: dict, column: str, by: list[str]) -> Column:
    """Whether a rule's format applies: cellIs, containsText, notContainsText, beginsWith, endsWith, containsBlanks, notContainsBlanks, top10, aboveAverage, duplicateValues, uniqueValues, timePeriod, between by operator."""
    from millrace.operators import stats

    c, kind, v = F.col(column), rule["type"], rule.get("value")
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    low = F.lower(F.lit(str(v)))
    if kind == "cellIs":
        op = rule["operator"]
        if op in ("between", "notBetween"):
            ok = c.between(*v)
            return ok if op == "between" else ~ok
        return COMPARE[op](c, v)
    simple = {
        "containsText": lambda: text.contains(low), "notContainsText": lambda: ~text.contains(low), "beginsWith": lambda: text.startswith(low), "endsWith": lambda: text.endswith(low),
        "containsBlanks": lambda: F.trim(text) == "", "notContainsBlanks": lambda: F.trim(text) != "",
        "top10": lambda: stats.top10(column, by, rule.get("rank", 10), rule.get("percent", False), rule.get("bottom", False)),
        "aboveAverage": lambda: stats.above_average(column, by, rule.get("below", False), rule.get("equal", False)),
        "duplicateValues": lambda: stats.duplicated(column, by), "uniqueValues": lambda: stats.unique(column, by),
    }
    if kind in simple:
        return simple[kind]()
    if kind == "timePeriod":
        d, today = F.to_date(c), F.to_date(F.lit(rule["today"]))
        month = lambda n: F.date_trunc("month", d) == F.date_trunc("month", F.add_months(today, n))
        week = lambda n: F.date_trunc("week", d) == F.date_trunc("week", F.date_add(today, 7 * n))
        return {"today": d == today, "yesterday": d == F.date_sub(today, 1), "tomorrow": d == F.date_add(today, 1), "last7Days": d.between(F.date_sub(today, 6), today), "thisMonth": month(0), "lastMonth": month(-1), "nextMonth": month(1), "thisWeek": week(0), "lastWeek": week(-1), "nextWeek": week(1)}[v]
    raise ValueError(f"no rule {kind!r}")


def ranked(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.withColumn("rank", F.rank().over(W.partitionBy(*by).orderBy(F.col(column).desc())))
