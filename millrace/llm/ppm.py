"""Operator 8, LM scoring: prediction by partial matching over a byte-context trie.

The trie holds, for contexts of 0 to `order` bytes, how often each byte follows. A byte is predicted
in its longest known context; if it hasn't been seen there, an escape (method C: as likely as the
number of distinct bytes seen) leads to the context shortened by its oldest byte, where the bytes of
the longer context are excluded. Below the empty context all bytes not excluded are equally likely.
The code length of a text is the sum of -log2 of its bytes' probabilities.

Two uses. *Pretrained* (`fit`, `predict`): counts over all training texts; a text is scored by the
frozen trie. *Adaptive* (`adaptive_code_length`): the trie starts empty and learns within the text.

The trie is a set of sorted arrays, one for each context length: the grams (context and byte, packed
in a 64-bit number) and their counts. No gram is dropped, however rare. What is excluded after an
escape is exactly what the context just left had seen, so all sums that scoring needs are made once.

A byte's probability depends on its gram alone, so texts are scored by gram: grams that make up at
least one of `nodes` bytes counted (so `nodes` at most) travel with the model as a cache of their
log P; all other counted grams are looked up by a join. A gram that was never counted is scored once,
beside all counted grams that share its last three context bytes: these hold every longer context it
can escape from. Shorter contexts, of which the alphabet bounds the number, go everywhere in full.

The text is scored as its lower-cased (A-Z) words, joined by a space and ended by a newline.

The word unigram (`base_score`) comes from exact counts over all training texts: c + 1 over a number that
is `base_over` if given, else (N + 1) * (V + 1). The contract's is `Model.add_one`, N + V + 1: with it the V
words and one that was never seen add up to 1.
Words that make up at least one of HOT tokens (so HOT at most) travel with the model; the rest are
looked up by a join that holds no frequent key.

Defined cases: null and empty texts have one token, the end. Repeated rows each get their answer.
An empty training set scores every byte 1/256 and the base with N = V = 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import chunks, cut, new_folder, words_of

ORDER, NODES, HOT = 4, 1 << 21, 1 << 19
#: Contexts of up to so many bytes travel in full; longer ones are dealt by their last SHORT + 1 bytes.
SHORT = 2
#: The end token, as the word counts hold it; no word contains white space.
END = "\n"
LOG10_2 = np.log10(2)


def stream_of(words: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of order + 1 bytes of each predicted byte, and where each text's first one is."""
    texts = [b" ".join(w) + b"\n" for w in words]
    pad = b"\n" * order
    raw = np.frombuffer(pad + pad.join(texts), dtype=np.uint8).astype(np.uint64)
    codes = np.zeros(len(raw) - order, dtype=np.uint64)
    for back in range(order + 1):
        codes |= raw[order - back : len(raw) - back] << np.uint64(8 * back)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]).astype(np.int64)
    keep = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return codes[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def low(bytes_kept: int) -> np.uint64:
    return np.uint64((1 << (8 * bytes_kept)) - 1)


class Trie:
    """grams[o], counts[o]: sorted packed grams of o context bytes and a byte, and how often each was seen."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        self.order = len(grams) - 1
        self.levels = [Level(g, c) for g, c in zip(grams, counts, strict=True)]
        for o in range(1, len(grams)):
            self.levels[o].below(self.levels[o - 1], low(o))

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 P of the last byte of each gram of order + 1 bytes."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        # what the context just left excludes: how many symbols, and their count one level below
        gone, weight = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        for o in range(self.order, -1, -1):
            if not len(left):
                return out
            level, code = self.levels[o], codes[left] & low(o + 1)
            at, known = level.context(code >> np.uint64(8))
            total = np.where(known, level.total[at] - weight, 0)
            kinds = np.where(known, level.kinds[at] - gone, 0)
            seen, count = level.count(code)
            hit = known & seen
            share = np.maximum(total + kinds, 1)
            out[left[hit]] += np.log2(count[hit] / share[hit])
            out[left[~hit]] += np.where(known[~hit] & (kinds[~hit] > 0), np.log2(np.maximum(kinds[~hit], 1) / share[~hit]), 0.0)
            miss = ~hit
            gone = np.where(known[miss], level.kinds[at[miss]], gone[miss])
            weight = np.where(known[miss], level.weight[at[miss]], 0)
            left = left[miss]
        out[left] -= np.log2(np.maximum(256 - gone, 1))
        return out


class Level:
    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts.astype(np.int64)
        self.contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
        self.kinds = np.diff(np.append(first, len(grams)))
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0, dtype=np.int64)
        self.first, self.weight = first, np.zeros(len(first), dtype=np.int64)
        if not len(grams):  # so that lookups find something to miss
            self.grams, self.counts, self.contexts = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.full(1, np.iinfo(np.uint64).max, dtype=np.uint64)
            self.kinds = self.total = self.weight = np.zeros(1, dtype=np.int64)

    def below(self, level: Level, mask: np.uint64) -> None:
        """weight: for each context, the count that its symbols have one level below."""
        if len(self.first):
            self.weight = np.add.reduceat(level.count(self.grams & mask)[1], self.first)

    def context(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.contexts, code), len(self.contexts) - 1)
        return at, self.contexts[at] == code

    def count(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        found = (self.grams[at] == code) & (self.counts[at] > 0)
        return found, np.where(found, self.counts[at], 0)


def score_words(trie: Trie, words: list[list[bytes]]) -> np.ndarray:
    """log10 P of each text; equal grams are scored once."""
    codes, starts = stream_of(words, trie.order)
    back, different = pd.factorize(codes)
    return np.add.reduceat(trie.log2(different)[back], starts) * LOG10_2


def adaptive_code_length(text: str | None, order: int = 3) -> float:
    """Bits of the text by a trie that starts empty and counts each byte after it is coded. One text, in memory."""
    seen: dict[bytes, Counter] = {}
    data = b"\n" * order + b" ".join(words_of(text)) + b"\n"
    bits = 0.0
    for k in range(order, len(data)):
        symbol, excluded, done = data[k], set(), False
        for o in range(order, -1, -1):
            found = seen.get(data[k - o : k])
            if not found:
                continue
            live = {s: c for s, c in found.items() if s not in excluded}
            total = sum(live.values()) + len(live)
            if symbol in live:
                bits -= np.log2(live[symbol] / total)
                done = True
                break
            if live:
                bits -= np.log2(len(live) / total)
            excluded |= found.keys()
        if not done:
            bits += np.log2(max(1, 256 - len(excluded)))
        for o in range(order + 1):
            seen.setdefault(data[k - o : k], Counter())[symbol] += 1
    return float(bits)


def shorter(codes: np.ndarray, n: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of o context bytes that grams of longer contexts end in, and their counts."""
    short, at = np.unique(codes & low(o + 1), return_inverse=True)
    total = np.zeros(len(short), dtype=np.int64)
    np.add.at(total, at, n)
    return short, total


class Model:
    """short: all grams of up to SHORT context bytes and their counts, by length; level: DataFrame (code, n) of all grams of
    order + 1 bytes; cached: how often a gram must occur to be cached; codes, logs: log10 P of those; hot: counts of frequent
    words; counts: DataFrame (word, c) of all; tokens N, distinct V."""

    def __init__(self, order: int, short: list[tuple[np.ndarray, np.ndarray]], level: DataFrame, cached: int, codes: np.ndarray, logs: np.ndarray, hot: dict[bytes, int], counts: DataFrame, tokens: int, distinct: int):
        self.order, self.short, self.level, self.cached, self.codes, self.logs = order, short, level, cached, codes, logs
        self.hot, self.counts, self.tokens, self.distinct = hot, counts, tokens, distinct

    def add_one(self) -> int:
        """N + 1 * (V + 1), what c + 1 is divided by in add-one smoothing with one word more than those seen."""
        return self.tokens + self.distinct + 1


def counted(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(word, code, n): word counts (code null) and gram counts (word null) of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            tokens: Counter = Counter()
            parts = []
            for start, end in chunks(texts):
                words = [words_of(t) for t in texts[start:end]]
                for w in words:
                    tokens.update(w)
                parts.append(np.unique(stream_of(words, order)[0], return_counts=True))
            yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in tokens] + [END], "code": None, "n": [*tokens.values(), len(texts)]}).astype({"code": "Int64"})
            if parts:
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pd.DataFrame({"word": None, "code": codes.astype(np.int64), "n": n})

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def seen(level: DataFrame) -> DataFrame:
    """(code, n, lp): log10 P of each counted gram, which its context predicts without an escape."""
    context = Window.partitionBy(F.shiftright("code", 8))
    return level.select("code", "n", F.log10(F.col("n") / (F.sum("n").over(context) + F.count("*").over(context))).alias("lp"))


def unseen(codes: DataFrame, model: Model) -> DataFrame:
    """(code, lp): log10 P of grams that were never counted."""
    short, order = model.short, model.order
    codes = cut(codes)
    shards = max(4 * int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (codes.count() + model.level.count()) >> 17)
    shard = lambda d: d.withColumn("shard", F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND((1 << (8 * (SHORT + 1))) - 1)), F.lit(shards))).groupBy("shard")

    def score(counted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"code": pd.Series(dtype="int64"), "lp": pd.Series(dtype="float64")})
        grams, n = counted["code"].to_numpy(dtype=np.uint64), counted["n"].to_numpy(dtype=np.int64)
        levels = short + [shorter(grams, n, o) for o in range(len(short), order + 1)]
        trie = Trie([g for g, _ in levels], [c for _, c in levels])
        return pd.DataFrame({"code": asked["code"], "lp": trie.log2(asked["code"].to_numpy(dtype=np.uint64)) * LOG10_2})

    return shard(model.level).cogroup(shard(codes)).applyInPandas(score, "code long, lp double")


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, nodes: int = NODES, hot: int = HOT) -> Model:
    """Counts over all docs. The driver gets all grams of short contexts, at most `nodes` of the others and `hot` words as caches."""
    if not 0 <= order <= 6:
        raise ValueError("order: 0 to 6, so that a gram and its sign fit in 64 bits")
    both = cut(counted(docs, text, order))
    counts = both.filter(F.col("code").isNull()).select("word", F.col("n").alias("c"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter(F.col("c") * hot >= tokens).toPandas()
    level = both.filter(F.col("code").isNotNull()).select("code", "n")
    size = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = min(order, SHORT)
    all_short = level.groupBy(F.col("code").bitwiseAND((1 << (8 * (top + 1))) - 1).alias("code")).agg(F.sum("n").alias("n")).toPandas()
    short = [shorter(all_short["code"].to_numpy(dtype=np.uint64), all_short["n"].to_numpy(dtype=np.int64), o) for o in range(top + 1)]
    cached = max(1, -(-size // nodes))
    kept = seen(level).filter(F.col("n") >= cached).select("code", "lp").toPandas().sort_values("code")
    words = {w.encode(): int(c) for w, c in zip(frequent["word"], frequent["c"], strict=True)}
    return Model(order, short, level, cached, kept["code"].to_numpy(dtype=np.uint64), kept["lp"].to_numpy(dtype=np.float64), words, counts, int(tokens), int(distinct))


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", base_over: int | None = None) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) for each row of docs; base_over: what the base divides c + 1 by."""
    order, cache, logs10, hot, kind, spark = model.order, model.codes, model.logs, model.hot, docs.schema[key].dataType, docs.sparkSession
    below = np.log10(model.tokens + 1) + np.log10(model.distinct + 1) if base_over is None else np.log10(base_over)
    schema = "row long, key string, word string, code long, n long, n_tokens long, n_known long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    full = lambda d: d.reindex(columns=names).astype({"key": object, "word": object, "code": "Int64", "n": "Int64", "n_tokens": "Int64", "n_known": "Int64"})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = {w: np.log10(c + 1) - below for w, c in hot.items()}
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            for start, end in chunks(texts):
                part = b.iloc[start:end]
                words = [words_of(t) for t in texts[start:end]]
                codes, starts = stream_of(words, order)
                back, different = pd.factorize(codes)
                at = np.minimum(np.searchsorted(cache, different), max(len(cache) - 1, 0))
                hit = cache[at] == different if len(cache) else np.zeros(len(different), dtype=bool)
                sums = np.add.reduceat(np.where(hit, logs10[at], 0.0)[back] if len(cache) else np.zeros(len(back)), starts)
                rows, rare = [], []
                for row, key_, w, s in zip(part["row"], part["key"], words, sums, strict=True):
                    w.append(END.encode())
                    known = [logs[x] for x in w if x in logs]
                    rows.append((row, key_, len(w), len(known), float(np.sum(known)), s))
                    rare += [(row, x.decode("utf-8", "replace"), n) for x, n in Counter(x for x in w if x not in logs).items()]
                yield full(pd.DataFrame(rows, columns=["row", "key", "n_tokens", "n_known", "base_score", "score"]))
                if rare:
                    yield full(pd.DataFrame(rare, columns=["row", "word", "n"]))
                missed = np.flatnonzero(~hit[back])
                if len(missed):
                    text_of = np.searchsorted(starts, missed, side="right") - 1
                    both, n = np.unique(text_of * len(different) + back[missed], return_counts=True)
                    yield full(pd.DataFrame({"row": part["row"].to_numpy()[both // len(different)], "code": different[both % len(different)].astype(np.int64), "n": n}))

    folder = new_folder(spark, "ppm")  # read more than once: what was never counted is scored before the sums
    docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(score, schema).write.parquet(folder)
    parts = spark.read.schema(schema).parquet(folder)
    texts = parts.filter(F.col("n").isNull()).select("row", "key", "n_tokens", "n_known", "base_score", "score")
    found = parts.filter(F.col("word").isNotNull()).join(model.counts, "word", "left")
    base = F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0) - F.lit(float(below)))
    rare_words = found.select("row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"), base.alias("base_score"))
    missed = parts.filter(F.col("code").isNotNull()).select("row", "code", "n")
    new = unseen(missed.select("code").distinct().join(model.level, "code", "left_anti"), model)
    rare = seen(model.level).filter(F.col("n") < model.cached).select("code", "lp").unionByName(new)
    rare_grams = missed.join(rare, "code").select("row", (F.col("n") * F.col("lp")).alias("score"))
    return (
        texts.unionByName(rare_words, allowMissingColumns=True)
        .unionByName(rare_grams, allowMissingColumns=True)
        .groupBy("row")
        .agg(F.max("key").cast(kind).alias(key), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
        .drop("row")
    )
