"""String, Unicode, entity, ANSI, version and URL functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col, let, replaced


# Cases


def split_words(s: Column | str) -> Column:
    """The words of an identifier: breaks at aA, AAa, a1 and 1a, then at white space, - and _."""
    c = col(s)
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\d)", r"(\d)(\p{L})"):
        c = F.regexp_replace(c, pattern, "$1 $2")
    return F.filter(F.split(c, r"[\s\-_]+"), lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def joined(s: Column | str, each, between: str) -> Column:
    return F.array_join(F.transform(split_words(s), each), between)


def camel_case(s: Column | str) -> Column:
    return F.array_join(F.transform(split_words(s), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capital(w))), "")


def pascal_case(s: Column | str) -> Column:
    return joined(s, capital, "")


def title_case(s: Column | str) -> Column:
    return joined(s, capital, " ")


def kebab_case(s: Column | str) -> Column:
    return joined(s, F.lower, "-")


def snake_case(s: Column | str) -> Column:
    return joined(s, F.lower, "_")


def constant_case(s: Column | str) -> Column:
    return joined(s, F.upper, "_")


def truncate(s: Column | str, length: int, suffix: str = "…", words: bool = True) -> Column:
    """At most `length` characters with the suffix; the cut moves back to the last space if there is one."""
    c = col(s)
    cut = F.substring(c, 1, max(0, length - len(suffix)))
    if words:
        cut = F.when(F.instr(cut, " ") > 1, F.regexp_replace(cut, r"\s\S*$", "")).otherwise(cut)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(cut, F.lit(suffix)))


def pad(s: Column | str, length: int, fill: str = " ", side: str = "right") -> Column:
    """Padded to `length`; longer texts stay whole. both: the odd character goes to the right."""
    c = col(s)
    left = {"left": F.lit(length), "right": F.length(c), "both": F.length(c) + F.floor((F.lit(length) - F.length(c)) / 2).cast("int")}[side]
    return F.when(F.length(c) >= length, c).otherwise(F.rpad(F.lpad(c, left, fill), F.lit(length), fill))


def format_text(template: Column | str, params: dict[str, Column]) -> Column:
    """{name} is replaced by its parameter; unknown names stay."""
    c = col(template)
    for name, value in params.items():
        c = F.replace(c, F.lit("{" + name + "}"), value.cast("string"))
    return c


def escape_regex(s: Column | str) -> Column:
    return F.regexp_replace(col(s), r"([.*+?^${}()|\[\]\\])", r"\\$1")


#: In this order, as the ampersand comes first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def escape_html(s: Column | str) -> Column:
    return replaced(col(s), HTML_ESCAPES)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(col(a), col(b)) / F.when(longer > 0, longer))


# Unicode


def per_value(function, returns: T.DataType):
    """A pandas UDF that applies a Python function to each value; null stays null."""

    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else function(v))

    return run


def normalize_unicode(s: Column | str, form: str = "NFC") -> Column:
    return per_value(lambda v: unicodedata.normalize(form, v), T.StringType())(col(s))


def casefold(s: Column | str) -> Column:
    return F.lower(col(s))


def graphemes(s: Column | str) -> Column:
    return F.regexp_extract_all(col(s), F.lit(r"(\X)"), F.lit(1))


def width_of(text: str) -> int:
    """Terminal columns: wide and fullwidth characters take two, combining and control characters none."""
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def width(s: Column | str) -> Column:
    return per_value(width_of, T.IntegerType())(col(s))


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def strip_diacritics(s: Column | str) -> Column:
    return per_value(without_marks, T.StringType())(col(s))


def slug(s: Column | str, separator: str = "-", ascii_only: bool = False) -> Column:
    """Lower case, marks stripped, other characters to separators. ascii_only: skips the UDF for text without marks."""
    c = col(s) if ascii_only else strip_diacritics(s)
    c = F.regexp_replace(F.lower(c), "[^a-z0-9]+", separator)
    return F.regexp_replace(c, f"^(?:{separator})+|(?:{separator})+$", "")


def compare(a: Column | str, b: Column | str, collation: str = "UNICODE") -> Column:
    """-1, 0 or 1 by a collation."""
    x, y = F.collate(col(a), collation), F.collate(col(b), collation)
    return F.when(x < y, -1).when(x == y, 0).otherwise(1)


def sorted_by_collation(df: DataFrame, c: str, collation: str = "UNICODE") -> DataFrame:
    return df.orderBy(F.collate(F.col(c), collation))


# Entities


def decode_html(s: Column | str) -> Column:
    return per_value(html.unescape, T.StringType())(col(s))


XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def decode_xml(s: Column | str) -> Column:
    """The five named entities; numeric references by the XML reader."""
    return replaced(col(s), XML_ENTITIES)


def encode_xml(s: Column | str) -> Column:
    return replaced(col(s), [(b, a) for a, b in reversed(XML_ENTITIES)])


# ANSI

ANSI = r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\^_])"


def strip_ansi(s: Column | str) -> Column:
    return F.regexp_replace(col(s), ANSI, "")


def ansi_events(s: Column | str) -> Column:
    """array<struct<kind, value>>: text, and sequences (csi, osc, esc), in order."""
    found = F.regexp_extract_all(col(s), F.lit(rf"({ANSI}|[^\x1B]+|\x1B)"), F.lit(1))
    kind = lambda e: F.when(e.rlike(r"^\x1B\["), "csi").when(e.rlike(r"^\x1B\]"), "osc").when(e.rlike(r"^\x1B"), "esc").otherwise("text")
    return F.transform(found, lambda e: F.struct(kind(e).alias("kind"), e.alias("value")))


# Versions

SEMVER = r"^[v=]?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z.-]+)?$"


def semver_valid(s: Column | str) -> Column:
    return F.coalesce(col(s).rlike(SEMVER), F.lit(False))


def semver(s: Column | str) -> Column:
    """struct<major, minor, patch, prerelease, rank>; null if invalid. Structs compare by major, minor, patch, then `rank`."""
    c = F.trim(col(s))
    number = lambda g: F.regexp_extract(c, SEMVER, g).cast("long")
    pre = F.regexp_extract(c, SEMVER, 4)
    # numeric parts below others and by value, fewer parts first; a release above its prereleases
    part = lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p))
    rank = F.when(pre == "", F.lit("~")).otherwise(F.array_join(F.transform(F.split(pre, r"\."), part), "\x01"))
    value = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), rank.alias("rank"), pre.alias("prerelease"))
    return F.when(semver_valid(c), value)


def semver_compare(a: Column | str, b: Column | str) -> Column:
    order = lambda s: F.struct(s["major"], s["minor"], s["patch"], s["rank"])
    x, y = order(semver(a)), order(semver(b))
    return F.when(semver(a).isNull() | semver(b).isNull(), None).when(x < y, -1).when(x == y, 0).otherwise(1)


def semver_satisfies(s: Column | str, wanted: str) -> Column:
    """Ranges: comparators (<, <=, >, >=, =), ^, ~, x-ranges; space is and, || is or."""
    import re

    def bound(text: str) -> tuple[list[int], str]:
        core, _, pre = text.partition("-")
        numbers = [int(x) for x in core.split(".") if x not in ("x", "X", "*", "")]
        return numbers, pre

    def one(token: str) -> Column:
        op, text = re.match(r"^(\^|~|<=|>=|<|>|=|v)?\s*(.*)$", token).groups()
        numbers, pre = bound(text)
        full = (numbers + [0, 0, 0])[:3]
        low = ".".join(map(str, full)) + (f"-{pre}" if pre else "")

        def below(at: int) -> str:
            up = full[: at + 1]
            up[at] += 1
            return ".".join(map(str, (up + [0, 0])[:3])) + "-0"

        at_least, less = semver_compare(s, F.lit(low)) >= 0, lambda v: semver_compare(s, F.lit(v)) < 0
        if op in ("<", "<=", ">", ">="):
            order = semver_compare(s, F.lit(low))
            if op == ">" and len(numbers) < 3 and numbers:
                return semver_compare(s, F.lit(below(len(numbers) - 1))) >= 0
            if op == "<=" and len(numbers) < 3 and numbers:
                return less(below(len(numbers) - 1))
            return {"<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]
        if not numbers:
            return semver_valid(s)
        if op == "^":
            at = next((k for k, n in enumerate(full) if n), min(len(numbers), 3) - 1)
            return at_least & less(below(min(at, len(numbers) - 1) if not any(full) else at))
        if op == "~":
            return at_least & less(below(min(1, len(numbers) - 1)))
        return at_least & less(below(len(numbers) - 1)) if len(numbers) < 3 else semver_compare(s, F.lit(low)) == 0

    out = F.lit(False)
    for part in wanted.split("||"):
        every = F.lit(True)
        hyphen = re.match(r"^\s*(\S+)\s+-\s+(\S+)\s*$", part)
        tokens = [f">={hyphen[1]}", f"<={hyphen[2]}"] if hyphen else re.sub(r"(<=|>=|<|>|=|\^|~)\s+", r"\1", part).split()
        for token in tokens:
            every = every & one(token)
        out = out | (every if tokens else semver_valid(s))
    return F.coalesce(out, F.lit(False))


def max_satisfying(df: DataFrame, by: list[str], s: str, wanted: str, name: str = "version") -> DataFrame:
    """The largest version of each group that satisfies a range."""
    v = semver(s)
    return df.filter(semver_satisfies(s, wanted)).groupBy(*by).agg(F.max_by(s, F.struct(v["major"], v["minor"], v["patch"], v["rank"])).alias(name))


# URLs


def url_parts(s: Column | str) -> Column:
    """struct<scheme, host, port, path, query, fragment>; null where there is none."""
    c = col(s)
    get = lambda what: F.try_parse_url(c, F.lit(what))
    port = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.struct(get("PROTOCOL").alias("scheme"), get("HOST").alias("host"), F.when(port != "", port).cast("int").alias("port"), get("PATH").alias("path"), get("QUERY").alias("query"), get("REF").alias("fragment"))


def query_map(s: Column | str) -> Column:
    """The decoded parameters of a URL; the last of a repeated name holds."""
    q = F.try_parse_url(col(s), F.lit("QUERY"))
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    item = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v"))
    return let(F.transform(pairs, item), lambda a: F.map_from_entries(F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"]))))


def build_url(base: Column | str, params: dict[str, Column]) -> Column:
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    return F.concat(col(base), F.when(F.instr(col(base), "?") > 0, "&").otherwise("?"), F.concat_ws("&", *pairs))


# Translation


def translated(df: DataFrame, catalogue: DataFrame, key: str, locale: str, fallback: str, params: dict[str, Column] | None = None, count: Column | None = None, name: str = "text") -> DataFrame:
    """Looks `key` up in catalogue (locale, key, text), then in the fallback locale, else the key itself; fills {params}.

    Of repeated keys of a locale the smallest text counts.
    count: `key.one` is used for 1 and `key.other` otherwise, where they exist.
    """
    wanted = F.col(key) if count is None else F.concat(F.col(key), F.when(count == 1, ".one").otherwise(".other"))
    d = df.withColumn("_k", wanted)
    for n, code in enumerate((locale, fallback)):
        part = catalogue.filter(F.col("locale") == code).groupBy(F.col("key").alias("_k")).agg(F.min("text").alias(f"_t{n}"))
        d = d.join(part, "_k", "left")
    text = F.coalesce("_t0", "_t1", F.col(key))
    return d.withColumn(name, format_text(text, params or {})).drop("_k", "_t0", "_t1")
