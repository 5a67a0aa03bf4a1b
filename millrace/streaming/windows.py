"""Time-based operators on events (key..., ts, seq, value): batch forms, and streaming forms where state is needed.

Batch forms are windows over each key's events in order; streaming forms keep state per key with
applyInPandasWithState, so the same functions hold for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.dates import millis

# Topic bus


def topic_matches(pattern: str, topic: str = "topic") -> Column:
    """An exact topic, or `prefix:*` for topics with something after the prefix; a bare * is refused."""
    if pattern == "*" or "*" in pattern[:-1]:
        raise ValueError(f"pattern {pattern!r}")
    if not pattern.endswith(":*"):
        return F.col(topic) == pattern
    head = pattern[:-1]
    return F.col(topic).startswith(head) & (F.length(topic) > len(head))


def sticky(events: DataFrame, topic: str = "topic", seq: str = "seq", value: str = "value") -> DataFrame:
    """The last value of each topic, as a late subscriber gets it. Works on streams (complete or update mode)."""
    return events.groupBy(topic).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def replay(events: DataFrame, topic: str, n: int, seq: str) -> DataFrame:
    w = W.partitionBy(topic).orderBy(F.col(seq).desc())
    return events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


# Debounce and throttle


def bursts(events: DataFrame, by: list[str], ts: str, delay_ms: int, seq: str) -> DataFrame:
    """Adds `burst`: a new one starts after `delay_ms` of silence or more."""
    w = W.partitionBy(*by).orderBy(ts, seq)
    gap = millis(ts) - F.lag(millis(ts)).over(w)
    return events.withColumn("_g", F.when(gap < delay_ms, 0).otherwise(1)).withColumn("burst", F.sum("_g").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_g")


def debounce(events: DataFrame, by: list[str], ts: str, delay_ms: int, seq: str, leading: bool = False, trailing: bool = True) -> DataFrame:
    """(by, fire_ts, edge, columns...): the first event of a burst at once, the last one when the silence is over.

    With both edges a burst of one event fires once, on its leading edge.
    """
    rest = [c for c in events.columns if c not in by]
    b = bursts(events, by, ts, delay_ms, seq)
    order = F.struct(ts, seq)
    g = b.groupBy(*by, "burst").agg(F.min_by(F.struct(*rest), order).alias("_first"), F.max_by(F.struct(*rest), order).alias("_last"), F.count("*").alias("_n"))
    out = []
    if leading:
        out.append(g.select(*by, F.col(f"_first.{ts}").alias("fire_ts"), F.lit("leading").alias("edge"), "_first.*"))
    if trailing:
        t = g.filter("_n > 1") if leading else g
        out.append(t.select(*by, (F.col(f"_last.{ts}") + F.expr(f"interval {delay_ms} milliseconds")).alias("fire_ts"), F.lit("trailing").alias("edge"), "_last.*"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def paced(times: list[int], interval: int, leading: bool, trailing: bool) -> list[tuple[int, int, str]]:
    """(fire time, index of the event, edge). An interval that ends with an event waiting fires it and is followed by the next; else it is over."""
    out: list[tuple[int, int, str]] = []
    end = waiting = None
    for k, t in enumerate(times):
        while end is not None and t >= end:
            if waiting is not None and trailing:
                out.append((end, waiting, "trailing"))
                end += interval
            else:
                end = None
            waiting = None
        if end is None:
            end = t + interval
            if leading:
                out.append((t, k, "leading"))
            else:
                waiting = k
        else:
            waiting = k
    if waiting is not None and trailing:
        out.append((end, waiting, "trailing"))
    return out


def throttle(events: DataFrame, by: list[str], ts: str, interval_ms: int, seq: str, leading: bool = True, trailing: bool = True) -> DataFrame:
    """(by, fire_ts, edge, seq): at most one firing for each interval; intervals start at the first event of a burst, so phases differ by key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", seq], kind="stable")
        fired = paced(pdf["_t"].tolist(), interval_ms, leading, trailing)
        out = pdf.iloc[[k for _, k, _ in fired]][[*by, seq]].copy()
        out["fire_ms"], out["edge"] = [f for f, _, _ in fired], [e for _, _, e in fired]
        return out

    d = events.select(*by, seq, millis(ts).alias("_t"))
    schema = d.select(*by, seq, F.col("_t").alias("fire_ms"), F.lit("").alias("edge")).schema
    return d.groupBy(*by).applyInPandas(run, schema).select(*by, F.timestamp_millis("fire_ms").alias("fire_ts"), "edge", seq)


# Token bucket


class Bucket:
    """A bucket of `capacity` tokens that gains refill_rate tokens each refill_ms, in fractions; a clock that goes back adds none."""

    def __init__(self, capacity: float, refill_rate: float, refill_ms: float, tokens: float | None = None, at: int | None = None):
        self.capacity, self.gain, self.at = capacity, refill_rate / refill_ms, at
        self.tokens = capacity if tokens is None else tokens

    def take(self, now: int, cost: float = 1.0) -> bool:
        if self.at is not None:
            self.tokens = min(self.capacity, self.tokens + max(0, now - self.at) * self.gain)
        self.at = now if self.at is None else max(self.at, now)
        if self.tokens < cost:
            return False
        self.tokens -= cost
        return True


def token_bucket(events: DataFrame, by: list[str], ts: str, seq: str, capacity: float, refill_rate: float, refill_ms: float) -> DataFrame:
    """(by, seq, allowed, tokens) of each event in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", seq], kind="stable")
        b, rows = Bucket(capacity, refill_rate, refill_ms), []
        for t in pdf["_t"].tolist():
            rows.append((b.take(t), b.tokens))
        return pdf[[*by, seq]].assign(allowed=[a for a, _ in rows], tokens=[x for _, x in rows])

    d = events.select(*by, seq, millis(ts).alias("_t"))
    schema = d.select(*by, seq, F.lit(True).alias("allowed"), F.lit(0.0).alias("tokens")).schema
    return d.groupBy(*by).applyInPandas(run, schema)


def token_bucket_stream(events: DataFrame, key: str, ts: str, seq: str, capacity: float, refill_rate: float, refill_ms: float) -> DataFrame:
    """The same on a stream: state is the tokens left and the time of the last event of each key."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (None, None)
        b = Bucket(capacity, refill_rate, refill_ms, tokens, at)
        for pdf in batches:
            pdf = pdf.sort_values(["t", seq], kind="stable")
            rows = [(b.take(t), b.tokens) for t in pdf["t"].tolist()]
            yield pd.DataFrame({key: k[0], seq: pdf[seq].to_numpy(), "allowed": [a for a, _ in rows], "tokens": [x for _, x in rows]})
        state.update((float(b.tokens), int(b.at)))

    d = events.select(key, seq, millis(ts).alias("t"))
    out = d.select(key, seq, F.lit(True).alias("allowed"), F.lit(0.0).alias("tokens")).schema
    return d.groupBy(key).applyInPandasWithState(run, out, "tokens double, at long", "append", GroupStateTimeout.NoTimeout)


# Sequence tracking

RESYNC = 1 << 16
WRAP = 1 << 32


def track(events: DataFrame, by: list[str], seq: str, arrival: str) -> DataFrame:
    """Adds status (first, next, gap, late, repeat) and missing, for sequences without wrap: a frame is judged by the largest one before it."""
    w = W.partitionBy(*by).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    top = F.max(seq).over(w)
    step = F.col(seq) - top
    status = F.when(top.isNull(), "first").when(step == 0, "repeat").when(step < 0, "late").when(step == 1, "next").otherwise("gap")
    return events.withColumn("status", status).withColumn("missing", F.when(step > 1, step - 1).otherwise(0))


class Tracker:
    """A layer's frames with 32-bit wrap; a jump of RESYNC or more either way starts anew."""

    def __init__(self, last: int | None = None):
        self.last = last

    def see(self, seq: int) -> tuple[str, int]:
        if self.last is None:
            self.last = seq
            return "first", 0
        step = (seq - self.last + WRAP // 2) % WRAP - WRAP // 2
        if abs(step) >= RESYNC:
            self.last = seq
            return "resync", 0
        if step <= 0:
            return ("repeat" if step == 0 else "late"), 0
        self.last = seq
        return ("next" if step == 1 else "gap"), step - 1


def track_wrapped(events: DataFrame, by: list[str], seq: str, arrival: str) -> DataFrame:
    """(by, arrival, seq, status, missing) with wrap and resync."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(arrival, kind="stable")
        t = Tracker()
        rows = [t.see(s) for s in pdf[seq].tolist()]
        return pdf.assign(status=[s for s, _ in rows], missing=[m for _, m in rows])

    d = events.select(*by, arrival, seq)
    return d.groupBy(*by).applyInPandas(run, d.select("*", F.lit("").alias("status"), F.lit(0).cast("long").alias("missing")).schema)


def track_stream(events: DataFrame, key: str, seq: str, arrival: str) -> DataFrame:
    """track_wrapped on a stream; state is the last sequence number of each layer."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Tracker(state.get[0] if state.exists else None)
        for pdf in batches:
            pdf = pdf.sort_values(arrival, kind="stable")
            rows = [t.see(s) for s in pdf[seq].tolist()]
            yield pd.DataFrame({key: k[0], arrival: pdf[arrival].to_numpy(), seq: pdf[seq].to_numpy(), "status": [s for s, _ in rows], "missing": [m for _, m in rows]})
        state.update((int(t.last),))

    d = events.select(key, F.col(arrival).cast("long").alias(arrival), F.col(seq).cast("long").alias(seq))
    return d.groupBy(key).applyInPandasWithState(run, d.select("*", F.lit("").alias("status"), F.lit(0).cast("long").alias("missing")).schema, "last long", "append", GroupStateTimeout.NoTimeout)


def conceal(events: DataFrame, by: list[str], seq: str, arrival: str, value: str, most: int | None = None, step: int = 10_000) -> DataFrame:
    """(by, seq, value, concealed): late and repeated frames dropped, gaps (of up to `most` where it is given) filled with the value before them.

    A gap is expanded `step` frames at a time, so that no long array is made.
    """
    t = track(events, by, seq, arrival).filter("status in ('first', 'next', 'gap')")
    w = W.partitionBy(*by).orderBy(seq)
    d = t.withColumn("_before", F.lag(value).over(w))
    own = d.select(*by, seq, value, F.lit(False).alias("concealed"))
    gaps = d.filter(F.col("missing") > 0 if most is None else F.col("missing").between(1, most))
    parts = gaps.select(*by, F.col(seq).alias("_end"), "_before", F.explode(F.sequence(F.col(seq) - F.col("missing"), F.col(seq) - 1, F.lit(step).cast("long"))).alias("_from"))
    lost = parts.select(*by, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (step - 1), F.col("_end") - 1))).alias(seq), F.col("_before").alias(value), F.lit(True).alias("concealed"))
    return own.unionByName(lost)


# Activity gate


def gate(frames: DataFrame, by: list[str], index: str, level: str, threshold: float, hold: int) -> DataFrame:
    """Adds `open`: up to `hold` frames after the last one at or above the threshold."""
    w = W.partitionBy(*by).orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col(level) >= threshold, F.col(index)), ignorenulls=True).over(w)
    return frames.withColumn("open", F.coalesce(F.col(index) - last <= hold, F.lit(False)))


def smooth_gate(frames: DataFrame, by: list[str], index: str, level: str, threshold: float, decay: float) -> DataFrame:
    """Adds `peak`, which falls by a factor each frame unless the level is higher, and `open`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, kind="stable")
        peak, peaks = 0.0, []
        for x in pdf[level].tolist():
            peak = max(x, peak * decay)
            peaks.append(peak)
        return pdf.assign(peak=peaks, open=[p >= threshold for p in peaks])

    return frames.groupBy(*by).applyInPandas(run, frames.select("*", F.lit(0.0).alias("peak"), F.lit(True).alias("open")).schema)


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x) / F.greatest(F.size(samples), F.lit(1)))


# Change feed and watch


def watch(changes: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """The changes of keys with a prefix; works on streams."""
    return changes.filter(F.col(key).startswith(prefix))


def media_time(ts: Column, unit_ms: float) -> Column:
    """A time in units of a link's frames."""
    return F.floor(millis(ts) / unit_ms)
