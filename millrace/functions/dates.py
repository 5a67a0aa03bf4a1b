"""Date and time functions. Set the session zone to UTC; zoned arithmetic takes the zone as a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col

UNITS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds", "milliseconds")
MS = {"weeks": 604_800_000, "days": 86_400_000, "hours": 3_600_000, "minutes": 60_000, "seconds": 1000, "milliseconds": 1}
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def millis(ts: Column | str) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def parse_iso(s: Column | str) -> Column:
    """Strict ISO 8601 with a zone; null otherwise."""
    c = col(s)
    fixed = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(c.rlike(ISO), F.try_to_timestamp(fixed))


def parse(s: Column | str, fmt: str) -> Column:
    """Tokens YYYY MM DD HH mm ss SSS; the whole text must fit. A day or month out of range is null (no roll-over)."""
    return F.try_to_timestamp(col(s), F.lit(fmt.replace("YYYY", "yyyy").replace("DD", "dd")))


def format_date(ts: Column | str, pattern: str = "M/d/yyyy") -> Column:
    return F.date_format(col(ts), pattern)


#: The relative units and their lengths in milliseconds.
RELATIVE = [("year", 365.25 * 86_400_000), ("month", 30.44 * 86_400_000), ("week", 7 * 86_400_000), ("day", 86_400_000), ("hour", 3_600_000), ("minute", 60_000), ("second", 1000)]
#: Words that en-US has for -1, 0 and 1 of a unit.
NEAR = {"year": ("last year", "this year", "next year"), "month": ("last month", "this month", "next month"), "week": ("last week", "this week", "next week"), "day": ("yesterday", "today", "tomorrow"), "hour": (None, "this hour", None), "minute": (None, "this minute", None), "second": (None, "now", None)}


def format_relative(ts: Column | str, now: Column | str) -> Column:
    """en-US, such as `in 3 days`, `2 hours ago`, `yesterday`."""
    diff = millis(ts) - millis(now)
    out = None
    for unit, ms in RELATIVE:
        n = F.floor(diff / ms + 0.5)
        plural = F.when(F.abs(n) == 1, unit).otherwise(unit + "s")
        text = F.when(n < 0, F.concat(F.format_number(-n, 0), F.lit(" "), plural, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), F.format_number(n, 0), F.lit(" "), plural))
        for k, word in zip((-1, 0, 1), NEAR[unit], strict=True):
            if word:
                text = F.when(n == k, word).otherwise(text)
        fits = F.abs(diff) >= ms if unit != "second" else F.lit(True)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


def add(ts: Column | str, n: Column | int, unit: str) -> Column:
    """Years and months stop at the month's last day."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit == "milliseconds":
        return F.timestamp_millis(millis(ts) + n)
    return col(ts) + F.make_interval(**{{"seconds": "secs", "minutes": "mins"}.get(unit, unit): n})


def sub(ts: Column | str, n: Column | int, unit: str) -> Column:
    return add(ts, -n if isinstance(n, int) else -n, unit)


def diff(a: Column | str, b: Column | str, unit: str) -> Column:
    """a - b in whole units: elapsed time, cut toward zero; months by the day of the month, years from months."""
    x, y = col(a), col(b)
    if unit in MS:
        ms = millis(x) - millis(y)
        return F.when(ms < 0, F.ceil(ms / MS[unit])).otherwise(F.floor(ms / MS[unit])).cast("long")
    dy, dm, dd = F.year(x) - F.year(y), F.month(x) - F.month(y), F.day(x) - F.day(y)
    if unit == "months":
        n = dy * 12 + dm
        return (n - F.when((n > 0) & (dd < 0), 1).when((n < 0) & (dd > 0), -1).otherwise(0)).cast("long")
    n = dy + dm / 12
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")


def start_of(ts: Column | str, unit: str) -> Column:
    """years, months, days, hours, minutes, seconds; other units leave the time as it is."""
    one = unit.removesuffix("s")
    return F.date_trunc(one, col(ts)) if one in ("year", "month", "day", "hour", "minute", "second") else col(ts)


def end_of(ts: Column | str, unit: str) -> Column:
    """The last millisecond of the unit."""
    if unit.removesuffix("s") not in ("year", "month", "day", "hour", "minute", "second"):
        return col(ts)
    return F.timestamp_millis(millis(add(start_of(ts, unit), 1, unit)) - 1)


def offset_minutes(ts: Column | str, zone: str) -> Column:
    """Minutes east of UTC."""
    c = col(ts)
    return ((F.unix_seconds(F.from_utc_timestamp(c, zone)) - F.unix_seconds(c.cast("timestamp"))) / 60).cast("int")


def in_zone(ts: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def excel_serial(n: Column | str, date1904: bool = False) -> Column:
    """The time of a spreadsheet serial; the 1900 system counts a 29 February 1900, so serials from 60 on are a day back."""
    c = col(n).cast("double")
    if date1904:
        return F.timestamp_millis((F.round(c * 86_400_000) + F.lit(-2_082_844_800_000)).cast("long"))
    days = F.when(c >= 60, c - 1).otherwise(c)
    return F.timestamp_millis((F.round(days * 86_400_000) + F.lit(-2_209_075_200_000)).cast("long"))


# Cron

FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def cron_field(text: str, low: int, high: int) -> set[int]:
    found: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"(\*|\d+(?:-\d+)?)(?:/(\d+))?", part)
        if not m:
            raise ValueError(f"cron field {text!r}")
        a, _, b = m[1].partition("-")
        first, last = (low, high) if a == "*" else (int(a), int(b) if b else (high if m[2] else int(a)))
        if not low <= first <= last <= high or m[2] == "0":
            raise ValueError(f"cron field {text!r} is out of range")
        found |= set(range(first, last + 1, int(m[2] or 1)))
    return found


def cron_sets(expression: str) -> dict[str, set[int]]:
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    sets = {name: cron_field(text, low, high) for text, (name, low, high) in zip(parts, FIELDS, strict=True)}
    sets["weekday"] = {d % 7 for d in sets["weekday"]}
    return sets


def cron_match(ts: Column | str, expression: str) -> Column:
    """Whether the minute of a time matches. Day and weekday are alternatives where both are restricted."""
    c, sets, parts = col(ts), cron_sets(expression), expression.split()
    day, weekday = F.day(c).isin(sorted(sets["day"])), (F.dayofweek(c) - 1).isin(sorted(sets["weekday"]))
    either = (day | weekday) if parts[2] != "*" and parts[4] != "*" else day if parts[2] != "*" else weekday if parts[4] != "*" else F.lit(True)
    return F.minute(c).isin(sorted(sets["minute"])) & F.hour(c).isin(sorted(sets["hour"])) & F.month(c).isin(sorted(sets["month"])) & either


def cron_next(df: DataFrame, ts: str, expression: str, n: int = 1, name: str = "next_runs", horizon_days: int = 5 * 366) -> DataFrame:
    """Adds the next n matching minutes after each time, searched day by day up to the horizon; null if there are fewer."""
    sets = cron_sets(expression)
    minutes = F.array(*[F.lit(h * 60 + m) for h in sorted(sets["hour"]) for m in sorted(sets["minute"])])
    start = F.date_trunc("minute", F.col(ts)) + F.expr("interval 1 minute")
    days = F.sequence(F.to_date(start), F.date_add(F.to_date(start), horizon_days))
    good = F.filter(days, lambda d: cron_match_day(d, expression, sets))
    runs = F.flatten(F.transform(F.slice(good, 1, n + 1), lambda d: F.transform(minutes, lambda m: F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + m * 60))))
    found = F.slice(F.filter(runs, lambda t: t >= start), 1, n)
    return df.withColumn(name, F.when(F.size(found) == n, found))


def cron_match_day(d: Column, expression: str, sets: dict[str, set[int]]) -> Column:
    parts = expression.split()
    day, weekday = F.day(d).isin(sorted(sets["day"])), (F.dayofweek(d) - 1).isin(sorted(sets["weekday"]))
    either = (day | weekday) if parts[2] != "*" and parts[4] != "*" else day if parts[2] != "*" else weekday if parts[4] != "*" else F.lit(True)
    return F.month(d).isin(sorted(sets["month"])) & either


# Number formats


def format_code(n: Column | str, code: str, ties: str = "up") -> Column:
    """Spreadsheet number formats: sections by sign, grouping, decimals, percent, scientific, literals; date codes on serials.

    ties: "up" rounds decimals as spreadsheets do, half up after scaling; "even" rounds the exact value of the double,
    exact ties to the even digit, and keeps the sign of -0.0, as printf does.
    """
    if ties not in ("up", "even"):
        raise ValueError("ties: up or even")
    c = col(n).cast("double")
    sections = re.split(r";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", code)
    positive = sections[0]
    negative = sections[1] if len(sections) > 1 else None
    zero = sections[2] if len(sections) > 2 else None
    shown = lambda x, part: section(x, part, ties)
    minus = F.concat(F.lit("-"), shown(F.abs(c), positive))
    out = F.when(c >= 0, shown(c, positive)).otherwise(shown(-c, negative) if negative is not None else minus)
    if ties == "even" and negative is None and zero is None:
        out = F.when(c.cast("string") == "-0.0", minus).otherwise(out)
    return F.when(c == 0, shown(c, zero)).otherwise(out) if zero is not None else out


def half_up(c: Column, places: int) -> Column:
    """The double c >= 0 with so many decimals, half up. From 2 ** 53 on doubles are whole; floor would stop at 2 ** 63."""
    up = c * 10**places + 0.5
    return F.when(up < 2.0**53, F.floor(up).cast("double")).otherwise(up) / 10**places


def exact_digits(c: Column, places: int) -> Column:
    """The exact value of the double c >= 0, grouped, exact ties to the even digit.

    format_number does so while neighbouring doubles are closer than the last decimal; beyond that it fills up with
    zeros behind the 17th digit, and still does above 2 ** 116 (35 digits).
    """
    step, top = 2.0**53, 2.0**63
    high = F.floor(c / step)
    whole = F.when(c < top, F.floor(c).cast("decimal(38,0)")).otherwise(high.cast("decimal(20,0)") * F.lit(2**53).cast("decimal(16,0)") + (c - high.cast("double") * step).cast("long").cast("decimal(19,0)")).cast("decimal(38,0)")
    part = F.when(c < step, c - F.floor(c)).otherwise(F.lit(0.0))
    digits = F.format_number(part, places)
    carry = digits.startswith("1") | ((part == 0.5) & (F.floor(c) % 2 != 0) if places == 0 else F.lit(False))
    text = F.concat(F.format_number(F.when(carry, whole + 1).otherwise(whole).cast("decimal(38,0)"), 0), F.substring(digits, 2, places + 1) if places else F.lit(""))
    return F.when((c >= 2.0**52 / 10**places) & (c < 2.0**116), text).otherwise(F.format_number(c, places))


def section(c: Column, code: str, ties: str = "up") -> Column:
    if code.strip().lower() == "general":
        return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(c.cast("string"))
    bare = re.sub(r"\"[^\"]*\"|\\.|\[[^\]]*\]", "", code)
    if re.search(r"[ymdhs]", bare, re.I) and not re.search(r"[0#?]", bare):
        return F.date_format(excel_serial(c), date_pattern(code))
    m = re.search(r"[#0?,]*[#0?],*(?:\.[#0?]*)?(?:E[+-]0+)?", code)
    literal = lambda t: re.sub(r"\"([^\"]*)\"|\\(.)|\[[^\]]*\]|_.|\*.", lambda x: x[1] or x[2] or "", t)
    if not m:
        return F.lit(literal(code))
    body = m[0]
    whole, _, rest = body.partition(".")
    places = len(re.match(r"[#0?]*", rest)[0])
    # each percent sign multiplies by 100, each comma after the last whole digit divides by 1000
    commas = len(re.search(r",*(?=$|E)", whole)[0])
    whole = re.sub(r",+(?=$|E)", "", whole)
    value = c * 100.0 ** bare.count("%") if "%" in bare else c
    value = value / 1000.0**commas if commas else value
    if "E" in body:
        text = F.regexp_replace(F.format_string(f"%.{places}E", value), r"E([+-])0*(\d)", "E$1$2")
        digits = len(re.search(r"E[+-](0+)", body)[1])
        text = F.concat(F.regexp_extract(text, r"^(.*E[+-])", 1), F.lpad(F.regexp_extract(text, r"E[+-](\d+)$", 1), digits, "0"))
    else:
        text = exact_digits(half_up(value, places) if ties == "up" else value, places)
        text = text if "," in whole else F.replace(text, F.lit(","), F.lit(""))
        least = len(re.sub("[^0]", "", whole))
        if least > 1:
            point = F.instr(F.concat(text, F.lit(".")), ".") - 1
            text = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(least) - point, F.lit(0))), text)
        optional = len(re.search(r"#*$", rest)[0])
        if optional:
            text = F.regexp_replace(text, rf"0{{0,{optional}}}$", "")
            text = F.regexp_replace(text, r"\.$", "")
    return F.concat(F.lit(literal(code[: m.start()])), text, F.lit(literal(code[m.end() :])))


def date_pattern(code: str) -> str:
    """A spreadsheet date code as a date_format pattern: m after h or before s is minutes."""
    out, hours = [], False
    for token in re.findall(r"\"[^\"]*\"|\\.|\[[^\]]*\]|y+|m+|d+|h+|s+|AM/PM|a/p|.", code, re.I):
        low = token.lower()
        if low[0] == "y":
            out.append("yyyy" if len(low) > 2 else "yy")
        elif low[0] == "d":
            out.append({1: "d", 2: "dd", 3: "EEE"}.get(len(low), "EEEE"))
        elif low[0] == "h":
            hours = True
            out.append(("h" if re.search("AM/PM|a/p", code, re.I) else "H") * min(2, len(low)))
        elif low[0] == "s":
            out = [*out[:-2], out[-2].replace("M", "m"), out[-1]] if len(out) > 1 and set(out[-2]) == {"M"} else out
            out.append("s" * min(2, len(low)))
        elif low[0] == "m":
            out.append("m" * min(2, len(low)) if hours else {1: "M", 2: "MM", 3: "MMM"}.get(len(low), "MMMM"))
            hours = False
        elif low in ("am/pm", "a/p"):
            out.append("a")
        elif token[0] == '"':
            out.append("'" + token[1:-1].replace("'", "''") + "'")
        elif token[0] == "\\":
            out.append("'" + token[1].replace("'", "''") + "'")
        elif token[0] != "[":
            out.append("'" + token + "'" if token.isalpha() else token)
    return "".join(out)
