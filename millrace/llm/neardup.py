"""Operator 5, MinHash near-dedup: HyperMinHash.

A document's set holds its distinct shingles of `shingle` words. Documents are linked whose sets have
a Jaccard similarity of `percent` / 100 or more; a component is what links reach.

1. Sketch. Each register keeps the smallest of the set's hashes under a hash function of its own,
   compressed to 16 bits as HyperMinHash does: the number of leading zeros (6 bits) and the 10 bits
   that follow the first one. Sketches are written once, to the shared folder; later steps read the
   columns they need. Equal sets become one, under their smallest id.
2. Bands. `banding(percent)` gives bands and rows such that two sets at the threshold share no bucket
   with a probability below MISSED (at 0.8: 42 bands of 6 registers). Buckets with one set are dropped.
3. Families. In each bucket all sets are compared with two centres (the smallest and the largest id),
   by the collision-corrected estimate from EST registers. What isn't within 4.5 standard deviations
   of the threshold is no candidate. Connected parts of the candidates are families so far. Buckets
   that still hold several are torn: there the sets outside the bucket's largest family meet all its
   sets, in blocks of both. So every two sets of a bucket are compared or already in one family, and
   whatever is linked and shares a bucket ends in one family.
4. Verification on full sets, which are built for members of families only. Families are dealt to
   tasks in blocks of BLOCK sets. CENTRES members of each family meet all others; that covers families
   up to this size. In larger ones, all members outside the largest part found so far then meet all
   members of the family, in blocks of both. Only links that join two parts come out, no pairs.
5. Components of the confirmed links by alternating large-star and small-star steps, on the cluster.

No group is held in one task: copies are collapsed before, buckets are aggregated before they are
shuffled, groups are cut into blocks. Nothing but counts reaches the driver. Where many sets are alike
but not linked, the torn comparisons grow with the number outside times the group's size; that work is
spread over blocks, none of it skipped.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and kept. A
text with fewer words than a shingle has its whole sequence as one shingle. Rows with equal ids are
one document that has the links of all its rows. Rows with a null id are linked with nothing: their
component_id is null and they are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import new_folder, released, text_batches, words_of

MISSED, EST, REGISTERS = 3e-6, 128, 320
BLOCK, CENTRES, NEAR_BLOCK = 256, 16, 512
MIX = np.uint64(0x9E3779B97F4A7C15)
_chance = np.random.default_rng(5)
FLIP = _chance.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _chance.integers(0, 2, REGISTERS, dtype=np.uint64)
TIMES = _chance.integers(0, 1 << 62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut(df: DataFrame) -> DataFrame:
    """common.cut, after which the shuffle files of its own run go at once; otherwise those of all steps stay until the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        # a run of its own, whose shuffles no other one reads
        return common.cut(df.select("*"))
    finally:
        conf.set(name, before)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that REGISTERS allows for a chance below MISSED that sets at the threshold share none."""
    if not 10 <= percent <= 100:
        raise ValueError("percent: 10 to 100")
    found, s = (1, 1), min(percent / 100, 0.999)
    for rows in range(1, REGISTERS + 1):
        bands = math.ceil(math.log(MISSED) / math.log(1 - s**rows))
        if bands * rows > REGISTERS - 20:
            break
        found = (bands, rows)
    return found


def margin(percent: int) -> float:
    """4.5 standard deviations of the estimate at the threshold."""
    s = percent / 100
    return 4.5 * math.sqrt(max(s * (1 - s), 0.01) / EST)


class Hasher:
    """64-bit hashes of words, remembered for the words seen last."""

    def __init__(self, most: int = 200_000):
        self.most, self.seen = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of runs of k words; of all words where there are fewer."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    n = min(k, len(h))
    count = len(h) - n + 1
    out = np.full(count, n, dtype=np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + count]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(sets: list[np.ndarray], many: int = EST) -> np.ndarray:
    """(sets x many) uint16 of sets that aren't empty."""
    out = np.empty((len(sets), many), dtype=np.uint16)
    if not sets:
        return out
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    for j in range(many):
        out[:, j] = compressed(np.minimum.reduceat((x ^ FLIP[j]) * TIMES[j], starts))
    return out


def compressed(v: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the 10 bits after the first one."""
    zeros = np.zeros(len(v), dtype=np.uint64)
    left = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = left < (np.uint64(1) << np.uint64(64 - step))
        zeros += small.astype(np.uint64) * np.uint64(step)
        left = np.where(small, left << np.uint64(step), left)
    return ((zeros << np.uint64(10)) | ((left >> np.uint64(53)) & np.uint64(1023))).astype(np.uint16)


def chance_equal(n: int, m: int) -> float:
    """How likely registers of different minima of sets of n and m elements are equal."""
    k = np.arange(64)
    at_least = lambda s: np.exp(-s * 2.0**-k)  # noqa: E731  the minimum has k leading zeros at most ... as a share
    p, q = (np.diff(np.append(1 - np.concatenate([[1.0], 1 - at_least(s)[1:]]), 1.0)) for s in (max(1, n), max(1, m)))
    return float(np.abs(p * q).sum() / 1024)


def estimate(a: np.ndarray, b: np.ndarray, chance: float) -> np.ndarray:
    """Collision-corrected Jaccard estimates from rows of registers."""
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets x bands) bucket keys."""
    out = np.zeros((len(regs), bands), dtype=np.uint64)
    for j in range(rows):
        out = (out ^ regs[:, j::rows][:, :bands].astype(np.uint64) ^ (np.arange(bands, dtype=np.uint64) << np.uint64(32))) * MIX
        out ^= out >> np.uint64(29)
    return out


SKETCH = "row long, id long, n long, digest binary, est binary, bands array<long>"


def sketches(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """SKETCH of each row, numbered anew, stored in the shared folder; the last three columns are null for an empty set."""
    bands, width = banding(percent)

    def sketched(numbers: list, ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        full = [s for s in sets if len(s)]
        regs = registers(full, max(EST, bands * width))
        keys = band_keys(regs, bands, width).astype(np.int64)
        found = iter(zip((xxhash.xxh3_128_digest(s.tobytes()) for s in full), (r[:EST].tobytes() for r in regs), keys.tolist(), strict=True))
        rows = [(r, i, len(s), *(next(found) if len(s) else (None, None, None))) for r, i, s in zip(numbers, ids, sets, strict=True)]
        return pd.DataFrame(rows, columns=["row", "id", "n", "digest", "est", "bands"])

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            numbers, ids, held, sets = [], [], 0, []
            for r, i, t in zip(b["row"], b["id"], b["text"], strict=True):
                numbers.append(r)
                ids.append(i)
                sets.append(shingles(hasher(words_of(t if isinstance(t, str) else None)), k))
                held += len(sets[-1])
                if held > 400_000:
                    yield sketched(numbers, ids, sets)
                    numbers, ids, held, sets = [], [], 0, []
            if ids:
                yield sketched(numbers, ids, sets)

    spark = docs.sparkSession
    text_batches(spark)
    folder = new_folder(spark, "sketches")
    # ids as text on the way: pandas has no whole numbers with nulls
    made = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(released(sketch), SKETCH.replace(" id long", " id string"))
    made.withColumn("id", F.col("id").cast("long")).write.parquet(folder)
    return spark.read.schema(SKETCH).parquet(folder)


def grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted partition, whichever batches they lie in."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        values = b[key].to_numpy()
        ends = np.append(np.nonzero(values[1:] != values[:-1])[0] + 1, len(b))
        start = 0
        for end in ends:
            part = b.iloc[start:end]
            if rest and rest[-1][key].iat[-1] != values[start]:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(part)
            start = end
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def by_group(rows: DataFrame, key: str = "group") -> DataFrame:
    """Rows of a group side by side in one task."""
    return rows.repartition(key).sortWithinPartitions(key)


def estimates(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """The pairs (u, v: ids; n, m, a, b: sizes and registers of both) that are near."""
    for x in batches:
        if not len(x):
            continue
        n, m = x["n"].to_numpy(dtype=float), x["m"].to_numpy(dtype=float)
        a, b = (np.frombuffer(b"".join(x[c]), dtype=np.uint16).reshape(len(x), EST) for c in ("a", "b"))
        # registers of different minima agree most often where sizes are equal
        chance = chance_equal(int(np.median(n)), int(np.median(n)))
        ok = (np.minimum(n, m) >= least * np.maximum(n, m)) & (estimate(a, b, chance) >= least)
        yield x.loc[ok, ["u", "v"]]


def merged(parts: np.ndarray, of: int, met: np.ndarray) -> np.ndarray:
    """One of met (places) for each part that isn't yet that of `of`; all become one part, in place."""
    labels, first = np.unique(parts[met], return_index=True)
    new = labels != parts[of]
    if new.any():
        parts[np.isin(parts, labels[new])] = parts[of]
    return met[first[new]]


def candidates(rows: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """(id, family) of the sets that may be linked with another. firsts: (digest, id, row) of each different set."""
    least = percent / 100 - margin(percent)
    bands = rows.select("row", "id", "bands").join(firsts.select("row"), "row", "left_semi").select("row", "id", F.explode("bands").alias("bucket"))
    busy = bands.groupBy("bucket").count().filter("count > 1").select("bucket")
    live = cut(bands.join(busy, "bucket").select("bucket", "row", "id"))
    ends = live.groupBy("bucket").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    star = live.join(ends, "bucket").select("row", F.explode(F.array("lo", "hi")).alias("centre")).filter("row <> centre")
    pairs = cut(star.select(F.least("row", "centre").alias("r"), F.greatest("row", "centre").alias("s")).distinct())
    est = rows.select("row", "id", "n", "est")
    one = pairs.join(est.select(F.col("row").alias("r"), F.col("id").alias("u"), "n", F.col("est").alias("a")), "r")
    both = one.join(est.select(F.col("row").alias("s"), F.col("id").alias("v"), F.col("n").alias("m"), F.col("est").alias("b")), "s").filter("u <> v")
    near = both.select("u", "v", "n", "m", "a", "b").mapInPandas(released(lambda batches: estimates(batches, least)), "u long, v long")

    # buckets of three sets or more in which families are still apart
    family = stars(near)
    large = live.join(ends.filter("size > 2").select("bucket", "size"), "bucket")
    member = large.join(family, F.col("id") == F.col("node"), "left").select("bucket", "size", "row", "id", F.coalesce("component", "id").alias("family"))
    member = cut(member)
    counts = member.groupBy("bucket", "family").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", "family")).alias("m"), F.count("*").alias("families")).filter("families > 1").select("bucket", F.col("m.family").alias("main"))
    torn = member.join(main, "bucket").withColumn("outside", F.col("family") != F.col("main")).join(est.drop("id"), "row")
    more = in_blocks(torn, "bucket", F.col("size"), NEAR_BLOCK, ["id", "n", "est", "family"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, "group"):
            ids, n = g["id"].to_numpy(), g["n"].to_numpy(dtype=float)
            own, probe = g["member"].to_numpy(dtype=bool), g["probe"].to_numpy(dtype=bool)
            regs = np.frombuffer(b"".join(g["est"]), dtype=np.uint16).reshape(len(g), EST)
            chance = chance_equal(int(np.median(n)), int(np.median(n)))
            parts, out = g["family"].to_numpy().copy(), []
            for c in np.nonzero(probe)[0]:
                at = np.nonzero(own & (parts != parts[c]) & (np.minimum(n, n[c]) >= least * np.maximum(n, n[c])))[0]
                at = at[estimate(regs[at], regs[c], chance) >= least]
                out += [(int(ids[c]), int(ids[k])) for k in merged(parts, c, at)]
            yield pd.DataFrame(out, columns=["u", "v"])

    found = components(family.union(by_group(more).mapInPandas(released(compare), "u long, v long")))
    return found.select(F.col("node").alias("id"), F.col("component").alias("family"))


def in_blocks(rows: DataFrame, key: str, size: Column, block: int, columns: list[str]) -> DataFrame:
    """(group, member, probe, ...): each row with `outside` meets all rows of its key, in blocks of both.

    Rows are dealt by a hash of their number to about size / block blocks. A group holds one block of members
    and one of probes; where a key has a single block, each row goes there once.
    """
    many = F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("row"), many).cast("int")
    place = lambda m, p, member, probe: F.struct(m.alias("m"), p.alias("p"), F.lit(member).alias("member"), probe.alias("probe"))
    each = F.sequence(F.lit(0), F.col("_many") - 1)
    single = F.array(place(F.lit(0), F.lit(0), True, F.col("outside")))
    as_member = F.transform(each, lambda p: place(F.col("_own"), p, True, F.lit(False)))
    as_probe = F.when(F.col("outside"), F.transform(each, lambda m: place(m, F.col("_own"), False, F.lit(True)))).otherwise(F.array().cast("array<struct<m:int,p:int,member:boolean,probe:boolean>>"))
    there = F.when(F.col("_many") == 1, single).otherwise(F.concat(as_member, as_probe))
    return rows.withColumn("_many", many).withColumn("_own", own).select(key, *columns, F.explode(there).alias("_at")).select(F.xxhash64(key, "_at.m", "_at.p").alias("group"), *columns, "_at.member", "_at.probe")


def with_smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m): the different edges, with the smallest v of each u; one deal by u serves all three steps where Spark reuses the exchange."""
    e = edges.repartition("u").distinct()
    # merge: both sides lie in the same partitions already, a broadcast would be one more run over them
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")


def stars(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reached, for the nodes of the edges (two columns, by position) that reach a smaller one.

    No step makes more edges than it gets; equal ones are dropped where the next step has them side by side.
    """
    edges = edges.toDF("u", "v")
    # stored first: which links join two parts may differ if they are computed again
    e, last = cut(edges.filter("u <> v")), None
    for _ in range(rounds):
        # large-star: larger neighbours go to the smallest one
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        e = with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small-star: smaller neighbours, and the node, go to the smallest one
        e = cut(with_smallest(e).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.toDF("node", "component")
        last = now
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached, for all nodes of the edges."""
    found = stars(edges)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


def full_sets(docs: DataFrame, members: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """members (id, row, digest, ...) with items: the sorted shingle hashes of the text of that digest; stored in the shared folder."""
    more = [f for f in members.schema.fields if f.name not in ("id", "digest")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = Hasher(), set()
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                sets = [shingles(hasher(words_of(t)), k).tobytes() for t in part["text"]]
                # rows that share an id have other texts, or the same one again
                own = []
                for r, d, x in zip(part["row"], part["digest"], sets, strict=True):
                    own.append(r not in seen and xxhash.xxh3_128_digest(x) == bytes(d))
                    if own[-1]:
                        seen.add(r)
                yield part.drop(columns=["text", "digest"]).assign(items=sets)[own]

    spark = docs.sparkSession
    chosen = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(members, "id")
    schema = ", ".join(["id long", *[f"{f.name} {f.dataType.simpleString()}" for f in more], "items binary"])
    folder = new_folder(spark, "sets")
    chosen.select("id", *[f.name for f in more], "digest", "text").mapInPandas(released(build), schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (group, id, member, probe, items). (u, v): links of a group's probes with its members that join two parts."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, "group"):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in g["items"]]
            ids, probe, member = g["id"].to_numpy(), g["probe"].to_numpy(dtype=bool), g["member"].to_numpy(dtype=bool)
            own = np.array([k for k in np.nonzero(member)[0] if len(sets[k])], dtype=np.int64)
            if not len(own):
                continue
            x = np.concatenate([sets[k] for k in own])
            sizes = np.array([len(sets[k]) for k in own])
            starts = np.cumsum(sizes) - sizes
            parts = np.unique(ids, return_inverse=True)[1]
            out = []
            for c in np.nonzero(probe)[0]:
                s = sets[c]
                if not len(s):
                    continue
                at = np.minimum(np.searchsorted(s, x), len(s) - 1)
                both = np.add.reduceat((s[at] == x).astype(np.int64), starts)
                linked = 100 * both >= percent * (sizes + len(s) - both)
                out += [(int(ids[c]), int(ids[k])) for k in merged(parts, c, own[linked])]
            yield pd.DataFrame(out, columns=["u", "v"])

    return by_group(rows.select("group", "id", "member", "probe", "items")).mapInPandas(released(verify), "u long, v long")


def verified(docs: DataFrame, firsts: DataFrame, families: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(u, v): edges that connect all documents of the families (id, family) that links connect, as links do. firsts: (digest, id, row)."""
    own = cut(firsts.join(families, "id"))
    known = own.join(own.groupBy("family").agg(F.count("*").alias("size")), "family")
    # the smallest hashes of a family, without gathering it: its range of hashes is cut by its size
    h = F.xxhash64(F.lit(5), "row")
    known = cut(known)
    some = known.filter((F.col("size") <= CENTRES) | (F.pmod(h, F.lit(1 << 30)) < (1 << 30) * (F.lit(4.0 * CENTRES) / F.col("size"))))
    chosen = some.groupBy("family").agg(F.slice(F.sort_array(F.collect_set(F.struct(h.alias("h"), "row"))), 1, CENTRES).alias("c")).select(F.explode("c.row").alias("row"))
    members = cut(known.join(chosen.withColumn("outside", F.lit(True)), "row", "left").fillna(False, ["outside"]))
    sets = full_sets(docs, members, key, text, k)
    # centres are probes of every block of their family, in one group with its members
    many = F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("row"), F.col("_many")).cast("int")
    blocks = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("_many") - 1)).otherwise(F.array("_own"))
    rows = sets.withColumn("_many", many).withColumn("_own", block).select("*", F.explode(blocks).alias("_b"))
    rows = rows.select(F.xxhash64("family", "_b").alias("group"), "id", (F.col("_b") == F.col("_own")).alias("member"), F.col("outside").alias("probe"), "items")
    parts = stars(confirmed(rows, percent))

    # in families of more than CENTRES sets: what lies outside the largest part meets all
    large = members.filter(F.col("size") > CENTRES).select("family", "row", "id", F.col("outside").alias("met"))
    big = cut(large.join(parts, F.col("id") == F.col("node"), "left").select("family", "row", "met", F.coalesce("component", "id").alias("part")))
    counts = big.groupBy("family", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts")).filter("parts > 1").select("family", F.col("m.part").alias("main"))
    # centres have met all
    left = big.join(main, "family").select("row", ((F.col("part") != F.col("main")) & ~F.col("met")).alias("outside"))
    torn = sets.filter(F.col("size") > CENTRES).drop("outside").join(left, "row")
    second = confirmed(in_blocks(torn, "family", F.col("size"), BLOCK, ["id", "items"]), percent)
    return parts.union(second)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; component_id: the smallest id that links reach."""
    rows = sketches(docs, key, text, shingle, percent)
    real = rows.filter("n > 0 and id is not null")
    firsts = cut(real.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("f")).select("digest", "f.id", "f.row"))
    links = verified(docs, firsts, candidates(real, firsts, percent), key, text, shingle, percent)

    # a document whose rows have different texts has the links of all of them
    pairs = real.select("id", "digest").distinct()
    several = pairs.groupBy("id").count().filter("count > 1").select("id")
    one = pairs.join(several, "id").join(firsts.select("digest", F.col("id").alias("first")), "digest").select("id", "first")
    same = one.join(one.groupBy("id").agg(F.min("first").alias("v")), "id").select(F.col("first").alias("u"), "v")

    found = stars(links.union(same))
    named = firsts.join(found, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    linked = real.select("id", "n", "digest").join(named, "digest").select("id", "n", "component_id")
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
