"""Operator 4, document fingerprints: Order MinHash. DataFrame functions only.

A text's k-mers are runs of k words (the whole text where it has fewer). Each is numbered by its
occurrence, so that repeats count, and hashed with that number. For each of `slots` equal parts of
the hash range the `tuple_size` smallest hashes from there on are selected (going round at the end of
the range, so short texts fill all slots); the selected k-mers are put back in the order in which the
text has them, and the tuple is hashed to 16 bits. Both what the texts share and the order in which
they have it decide how many slots agree, which is why the share of equal slots falls with the edit
distance and not only with the overlap of sets.

All of it happens within a row, by higher-order functions over packed numbers (32 bits of hash, 31
bits of position, as many as an array can have): one sort by k-mer for the occurrence numbers, one by hash for the selection.
Nothing is shuffled to fingerprint a text.

Defined cases: null counts as empty; texts without a word share the fingerprint of zeros, and two of
them have likeness 1. Equal texts have equal fingerprints. Rows with equal ids are ordered by text.
A row with a null id comes first. The one row of a one-row table is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, SLOTS, TUPLE = 2, 64, 2
PLACE = 31
HASH = (1 << 32) - 1
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def place(packed: Column) -> Column:
    return packed.bitwiseAND((1 << PLACE) - 1)


def packed(hashed: Column, at: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(HASH), PLACE).bitwiseOR(at)


def kmers(words: Column, k: int) -> Column:
    """Hash and position of each k-mer, sorted."""
    n = F.size(words)
    count = F.when(n == 0, 0).otherwise(F.greatest(n - (k - 1), F.lit(1)))
    return F.sort_array(F.transform(indexes(count), lambda i: packed(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i.cast("long"))))


def numbered(found: Column) -> Column:
    """The sorted k-mers with their occurrence number in the hash, sorted by the new hash."""
    kind = lambda i: F.shiftright(F.get(found, i), PLACE)
    starts = F.filter(indexes(F.size(found)), lambda i: (i == 0) | (kind(i) != kind(i - 1)))

    def runs(first: Column) -> Column:
        def run(s: Column, r: Column) -> Column:
            end = F.coalesce(F.get(first, r + 1), F.size(found))
            return F.transform(F.slice(found, s + 1, end - s), lambda x, o: packed(F.xxhash64(F.shiftright(x, PLACE), o), place(x)))

        return F.sort_array(F.flatten(F.transform(first, run)))

    return let(starts, runs)


def signature(items: Column, slots: int, size: int) -> Column:
    """The slots' 16-bit tuple hashes (1 to 65535; 0 where the text has no k-mer)."""
    part = lambda i: F.floor(F.shiftright(F.get(items, i), PLACE) / ((HASH + 1) // slots)).cast("int")
    n = F.size(items)
    # items at which a part begins that has no smaller item of its own: as often as parts end there
    gain = lambda i: part(i) - F.when(i == 0, -1).otherwise(part(i - 1))
    firsts = F.flatten(F.transform(F.filter(indexes(n), lambda i: gain(i) > 0), lambda i: F.array_repeat(i, gain(i))))

    def select(begin: Column) -> Column:
        def slot(i: Column) -> Column:
            own = [F.get(items, F.pmod(i + j, n)) for j in range(size)]
            in_order = F.sort_array(F.array(*[F.shiftleft(place(x), 32).bitwiseOR(F.shiftright(x, PLACE)) for x in own]))
            return (F.pmod(F.xxhash64(F.transform(in_order, lambda x: x.bitwiseAND(HASH))), F.lit(65535)) + 1).cast("int")

        return F.transform(F.concat(begin, F.array_repeat(F.lit(0), F.lit(slots) - F.size(begin))), slot)

    return F.when(n == 0, F.array_repeat(F.lit(0), slots)).otherwise(let(firsts, select))


def order_minhash(text: Column, k: int = K, slots: int = SLOTS, size: int = TUPLE) -> Column:
    """array<int>: the signature of a whole text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")
    return let(words, lambda w: let(kmers(w, k), lambda s: let(numbered(s), lambda items: signature(items, slots, size))))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of slots that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def splits(docs: DataFrame, key: str, rows_per_bucket: int, most: int) -> tuple[list[int], int | None, bool]:
    """At most `most` keys that cut the rows into even ranges; the first key; whether null keys come before it."""
    n, nulls, low = docs.agg(F.count("*"), F.sum(F.col(key).isNull().cast("int")), F.min(key)).first()
    buckets = max(1, min(most, n // rows_per_bucket))
    if buckets == 1:
        return [], low, bool(nulls)
    at = docs.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0] or []
    return sorted({x for x in at if x > low}), low, bool(nulls)


def with_next(docs: DataFrame, key: str, carried: list[str], tie: str, rows_per_bucket: int = 500, most: int = 20_000) -> DataFrame:
    """docs with next_<c> for each carried column: its value in the row with the next key (after the last: the first).

    Rows are dealt by ranges of the key whose bounds are keys themselves, so each range's first row is
    known; a copy of it also ends the range before. One shuffle, no global order in one task.
    """
    cuts, low, nulls = splits(docs, key, rows_per_bucket, most)
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.array().cast("array<long>")
    steps = F.array(*[F.lit(1 << b) for b in range(max(1, len(cuts).bit_length()) - 1, -1, -1)])
    number = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(bounds, lo + s - 1) <= F.col(key), F.lit(False)), lo + s).otherwise(lo))
    first = F.col(key).isNull() if nulls else F.coalesce(F.col(key) == F.lit(low), F.lit(False))
    d = docs.withColumn("_b", number)
    heads = F.coalesce(F.get(bounds, F.col("_b") - 1) == F.col(key), F.lit(False))
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))
    copies = F.array_compact(F.array(own, F.when(heads, F.struct((F.col("_b") - 1).alias("b"), F.lit(True).alias("copy"))), F.when(first, F.struct(F.lit(len(cuts)).alias("b"), F.lit(True).alias("copy")))))
    w = W.partitionBy("_at.b").orderBy("_at.copy", F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first())
    d = d.withColumn("_at", F.explode(copies)).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return d.filter(~F.col("_at.copy")).drop("_at", "_b")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, slots: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    d = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.withColumn("_sig", order_minhash(F.col("_text"), k, slots, size))
    d = with_next(d, "_key", ["_text", "_sig"], "_text")
    n = F.length("_text")
    tail = F.floor(n / 4).cast("int")
    d = d.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - tail), F.substring(F.col("next__text"), F.lit(1), tail)))
    d = d.select("_key", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_sig", "next__sig", order_minhash(F.col("_edited"), k, slots, size).alias("_sig2"))
    return d.select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", as_text(F.col("_sig")).alias("fingerprint"), as_text(F.col("_sig2")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_sig2")).alias("near_edited"), likeness(F.col("_sig"), F.col("next__sig")).alias("near_next"),
    )
