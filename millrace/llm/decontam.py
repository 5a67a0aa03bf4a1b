"""Operator 10, benchmark decontamination: the CGK embedding and bit-sampling LSH over windows.

Texts are sequences of tokens: runs of letters and digits, lower-cased, so case, punctuation and
layout don't hide a passage. An item of m tokens is in a document if some run of the document's
tokens is within `max_edits(m)` = m // 5 token edits of it.

The CGK embedding walks over a sequence: at step j it writes the token it stands on and moves on by
one if a random bit of (j, token) says so. Two sequences at edit distance k get embeddings whose
Hamming distance is O(k^2) with good probability. Windows as long as an item are embedded in 2 m
steps; each of TABLES tables samples `width(m)` positions of one of WALKS independent walks, and a
window that agrees with an item in a table is a candidate. An equal window always agrees. The longer
an item, the further edits at the limit drive two walks apart, so long items sample one position a
table, shorter ones two: occurrences at the largest distance, by substitutions, insertions or
deletions, are then found with 0.95 or more for items of 6 to 400 tokens (see the tests).
Candidates are verified by the exact edit distance of the item to any run around the window.

Windows are taken where they can match: an edit spoils at most GRAM of an item's runs of GRAM tokens,
so an occurrence keeps at least `needed(m)` of them, at offsets that differ by no more than twice the
edits. Windows start where such runs put the item's start. This skips no occurrence (items of fewer
than LEAST tokens must occur unchanged).

The items are the stated query set, small beside the documents; the driver reads them all, and they
go to the executors in blocks of `block` items, each block
against all documents. No documents are joined or shuffled.

Defined cases: null or empty document: no match. Null or empty item, or one without letters and
digits: never matched. Equal items are each reported. Repeated rows each get their matches. With no
items, or no documents, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended

WALKS, TABLES = 16, 48
#: So many steps of all walks are held at once.
STEPS = 1 << 20
GRAM, LEAST = 3, 6
#: Odd multipliers that mix 64-bit hashes.
MIX, ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: The base of the polynomial token hash, and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
BACK = pow(BASE, -1, 1 << 64)


def max_edits(m: int) -> int:
    return m // 5 if m >= LEAST else 0


def width(m: int) -> int:
    """How many positions a table samples."""
    return 2 if m < 60 else 1


def needed(m: int) -> int:
    """How many of its runs of GRAM tokens an item of m tokens keeps in any occurrence."""
    return max(1, m - GRAM + 1 - GRAM * max_edits(m))


_is_token = np.array([chr(c).isalnum() for c in range(1 << 16)])
_powers = {BASE: np.ones(1, dtype=np.uint64), BACK: np.ones(1, dtype=np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2^64; kept, and made longer when needed."""
    if len(_powers[base]) < n:
        steps = np.full(2 * n, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of a lower-cased text, and where each starts.

    A token's hash is a polynomial of its mixed characters: the difference of two running sums,
    divided by the power at its start. So a whole text is hashed without taking it apart.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(c):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    ok = _is_token[np.minimum(c, 0xFFFF)]
    if c.max() > 0xFFFF:
        far = np.nonzero(c > 0xFFFF)[0]
        ok[far] = [chr(x).isalnum() for x in c[far]]
    edge = np.diff(ok.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    mixed = (c.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * powers(BASE, len(c)))])
    h = (sums[end] - sums[start]) * powers(BACK, len(c))[start]
    h = (h ^ (h >> np.uint64(32)) ^ (end - start).astype(np.uint64)) * MIX
    return h ^ (h >> np.uint64(29)), start


def hashes(text: str) -> np.ndarray:
    return tokens(text.lower())[0]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n tokens."""
    count = max(0, len(h) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + count]) * MIX
        out ^= out >> np.uint64(29)
    return out


def walks(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """The CGK embeddings (steps x WALKS x windows) of the windows of m tokens that begin at starts; 0 past a window's end."""
    padded = np.append(h, np.uint64(0))
    end = np.minimum(starts + m, len(h))
    at = np.tile(starts, (WALKS, 1))
    out = np.zeros((2 * m, WALKS, len(starts)), dtype=np.uint64)
    for j in range(2 * m):
        here = padded[np.minimum(at, len(h))]
        here[at >= end] = 0
        out[j] = here
        salt = np.array([int(ADD) * (j + 1 + 4096 * n) % (1 << 64) for n in range(WALKS)], dtype=np.uint64)
        at += (((here ^ salt[:, None]) * MIX) >> np.uint64(63)).astype(np.int64)
    return out


_samples: dict[int, list[tuple[int, np.ndarray]]] = {}


def samples(m: int) -> list[tuple[int, np.ndarray]]:
    """(walk, positions) of each table, for windows of m tokens: fixed for all time."""
    if m in _samples:
        return _samples[m]
    chance = np.random.default_rng(m)
    _samples[m] = [(t % WALKS, np.sort(chance.choice(2 * m, width(m), replace=False))) for t in range(TABLES)]
    return _samples[m]


def keys(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """(windows x TABLES) bucket keys, different for each table and length."""
    out = np.zeros((len(starts), TABLES), dtype=np.uint64)
    out += np.uint64(m) << np.uint64(16)
    out += np.arange(TABLES, dtype=np.uint64)
    few = max(1, STEPS // (2 * m * WALKS))
    for k in range(0, len(starts), few):
        steps, part = walks(h, starts[k : k + few], m), out[k : k + few]
        for t, (n, at) in enumerate(samples(m)):
            for p in at:
                part[:, t] = (part[:, t] ^ steps[p, n]) * MIX
                part[:, t] ^= part[:, t] >> np.uint64(31)
    return out


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The edit distance of the item to the nearest run of the text, and where that run ends."""
    n = len(text)
    row, steps = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    for i, x in enumerate(item, 1):
        new = np.empty(n + 1, dtype=np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        # a run of insertions is a running minimum
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """A block of items: their token hashes, the runs that place windows, and the tables."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, h) for i, text in items if text and len(h := hashes(text))]
        self.size = np.array([len(h) for _, h in self.items], dtype=np.int64)
        self.need = np.array([needed(len(h)) for _, h in self.items], dtype=np.int64)
        self.edits = np.array([max_edits(len(h)) for _, h in self.items], dtype=np.int64)
        self.short: dict[int, list[int]] = {}
        runs, offsets, owners, table, holders = [], [], [], [], []
        for m in np.unique(self.size).tolist():
            own = np.nonzero(self.size == m)[0]
            if m < GRAM:
                self.short[m] = own.tolist()
                continue
            h = np.concatenate([self.items[k][1] for k in own])
            starts = np.arange(len(own)) * m
            inside = (starts[:, None] + np.arange(m - GRAM + 1)).ravel()
            runs.append(grams(h, GRAM)[inside])
            offsets.append(np.tile(np.arange(m - GRAM + 1), len(own)))
            owners.append(np.repeat(own, m - GRAM + 1))
            table.append(keys(h, starts, m).ravel())
            holders.append(np.repeat(own, TABLES))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        order = np.argsort(run := join(runs, np.uint64), kind="stable")
        self.run, self.of, self.offset = run[order], join(owners, np.int64)[order], join(offsets, np.int64)[order]
        order = np.argsort(key := join(table, np.uint64), kind="stable")
        self.key, self.holder = key[order], join(holders, np.int64)[order]
        self.some = np.zeros(1 << 16, dtype=bool)
        self.some[self.run >> np.uint64(48)] = True

    def bucket_mates(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, item) for each item that a key's bucket holds."""
        lo, hi = np.searchsorted(self.key, bucket, "left"), np.searchsorted(self.key, bucket, "right")
        n = hi - lo
        return np.repeat(np.arange(len(bucket)), n), self.holder[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def promising(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The documents (by their number for each token) that have as many runs of some item as it must keep."""
        found = []
        if len(h) >= GRAM:
            g = grams(h, GRAM)
            at = np.nonzero(self.some[g >> np.uint64(48)] & (doc[GRAM - 1 :] == doc[: len(g)]))[0]
            lo, hi = np.searchsorted(self.run, g[at], "left"), np.searchsorted(self.run, g[at], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs, count = np.unique(np.repeat(doc[at], n) * max(1, len(self.size)) + self.of[which], return_counts=True)
            found.append(pairs[count >= self.need[pairs % max(1, len(self.size))]] // max(1, len(self.size)) if len(pairs) else pairs)
        for m, items in self.short.items():
            g = grams(h, m)
            if len(g):
                same = np.isin(g, np.concatenate([grams(self.items[k][1], m) for k in items])) & (doc[m - 1 :] == doc[: len(g)])
                found.append(doc[: len(g)][same])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def search_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """search() of each text; all are hashed and screened at once."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        low = [t.lower() if t else "" for t in texts]
        h, start = tokens("\n".join(low))
        ends = np.cumsum([len(t) + 1 for t in low])
        doc = np.searchsorted(ends, start, "right")
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in self.promising(h, doc).tolist():
            out[d] = self.search(h[first[d] : first[d + 1]])
        return out

    def windows(self, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item length, starts) of the windows that may match."""
        g = grams(h, GRAM)
        at = np.nonzero(self.some[g >> np.uint64(48)])[0]
        lo, hi = np.searchsorted(self.run, g[at], "left"), np.searchsorted(self.run, g[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return []
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, start = self.of[which], np.repeat(at, n) - self.offset[which]
        enough = np.bincount(item, minlength=len(self.size))[item] >= self.need[item]
        item, start = item[enough], start[enough]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        # from each run on: whether as many as needed lie within the span that edits allow
        first = np.arange(len(item))
        last = first + self.need[item] - 1
        there = np.minimum(last, len(item) - 1)
        near = (last < len(item)) & (item[there] == item) & (start[there] - start <= 2 * self.edits[item])
        marks = np.zeros(len(item) + 1, dtype=np.int64)
        np.add.at(marks, first[near], 1)
        np.add.at(marks, last[near] + 1, -1)
        kept = np.cumsum(marks[:-1]) > 0
        if not kept.any():
            return []
        pairs = np.unique(np.stack([self.size[item[kept]], np.maximum(start[kept], 0)]), axis=1)
        return [(int(m), pairs[1][pairs[0] == m]) for m in np.unique(pairs[0])]

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, edits, first token, last token + 1) of the items in a text, by its token hashes."""
        best: dict[int, tuple[int, int]] = {}
        for m, starts in self.windows(h):
            found: set[tuple[int, int]] = set()
            for k in range(0, len(starts), 2048):
                part = starts[k : k + 2048]
                which, item = self.bucket_mates(keys(h, part, m).ravel())
                found.update(zip(item.tolist(), part[which // TABLES].tolist(), strict=True))
            edits = max_edits(m)
            for item, start in sorted(found):
                if item in best and best[item][0] == 0:
                    continue
                lo = max(0, start - edits)
                d, end = nearest(self.items[item][1], h[lo : start + m + 2 * edits])
                if d <= edits and (item not in best or d < best[item][0]):
                    best[item] = (d, lo + end)
        for m, items in self.short.items():
            g = grams(h, m)
            for item in items:
                if len(at := np.nonzero(g == grams(self.items[item][1], m)[0])[0]):
                    best[item] = (0, int(at[0]) + m)
        return [(self.items[k][0], d, max(0, end - len(self.items[k][1])), end) for k, (d, end) in sorted(best.items())]


MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("first_token", T.IntegerType()), T.StructField("end_token", T.IntegerType())])


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = 20_000, name: str = "matches") -> DataFrame:
    """docs with `matches`, an array of MATCH structs: the items found in each text. No shuffle. An existing column of this name is replaced."""
    new = T.StructType([T.StructField(name, T.ArrayType(MATCH))])
    parts = list(blocks(items, item_key, item_text, block))

    def make(part: list):
        index = Index(part)  # built once, on the driver

        def start():
            as_dict = lambda r: dict(zip(MATCH.names, r, strict=True))

            def search(texts: list, earlier: list | None = None) -> list[list]:
                found = [[as_dict(r) for r in rows] for rows in index.search_all(texts)]
                return [[[*(old or []), *rows] for old, rows in zip(earlier, found, strict=True)] if earlier is not None else found]

            return search

        return start

    for k, part in enumerate(parts or [[]]):
        docs = appended(docs, [text, name] if k else [text], new, make(part))
    return docs


def blocks(items: DataFrame, key: str, text: str, block: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items, `block` at a time, by rising id (then text)."""
    part: list[tuple[int, str | None]] = []
    for r in items.select(F.col(key).cast("long"), F.col(text)).filter(F.col(key).isNotNull()).orderBy(key, text).toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def found_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(key, item_id, edits, first_token, end_token): a row for each document and item found in it."""
    return matches(docs.select(key, text), items, text, **more).select(key, F.inline("matches"))
