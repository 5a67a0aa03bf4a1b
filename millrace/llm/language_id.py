"""Operator 6, language ID: segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces of the product of their probabilities, which a
forward pass gives; a text's is the product over its words. Pieces never cross words, so this is
the sum over the segmentations of the whole text. The piece probabilities are fitted by EM (the
forward-backward counts of pieces), over a sample of labelled rows bounded by `docs_per_language`.

Words are runs of letters of the lower-cased text, of any length: the passes rescale as they go, so
long runs don't underflow. Spans are found in the vocabulary by 64-bit rolling hashes, for all words
of a group at once.

Defined cases: null text, empty text or no letter: language `und`, score 0. Repeated rows: each
gets the same answer. No labelled row at all: `und` everywhere. Ties: the first language by code.
Rows with a null language are not learned from. More than `most_languages` distinct languages: an
error, as the model has a column for each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, chunks, cut, released, share_of, text_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
MARK = "▁"
#: Probability of a character that the vocabulary lacks, and the count added to every piece.
RARE, ADDED = 1e-6, 0.01
#: Positions after which the passes are rescaled.
RESCALE = 16
#: Words of up to so many letters in all are passed over side by side.
LETTERS = 200_000
#: Longer words are passed over one by one.
LONG = 300
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93

runs = re.compile(r"[^\W\d_]+").findall


def pieces_of(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, without control and byte pieces. Read on the driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p.lower() for p in found})


def letters_of(run: str) -> list[str]:
    """A run's parts: letters only."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def points(words: list[str]) -> np.ndarray:
    """(words x longest) code points; 0 past a word's end."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros((len(words), int(sizes.max(initial=0))), dtype=np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


class Pieces:
    """Numbers of pieces (from 2 on) by hashes of their code points."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        found, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
        for own in by_length(pieces, exact=True):
            n = len(pieces[own[0]])
            found.append(self.hashed(self.sums(points([pieces[k] for k in own])), n)[:, 0])
            at.append(own.astype(np.int32) + 2)
        h, at = np.concatenate(found), np.concatenate(at)
        order = np.argsort(h)
        self.hash, self.number = h[order], at[order]
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[self.hash >> np.uint64(44)] = True

    def sums(self, c: np.ndarray) -> np.ndarray:
        mixed = (c.astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros((c.shape[0], c.shape[1] + 1), dtype=np.uint64)
        for j in range(c.shape[1]):
            out[:, j + 1] = out[:, j] * np.uint64(BASE) + mixed[:, j]
        return out

    def hashed(self, sums: np.ndarray, n: int) -> np.ndarray:
        """The hashes of all spans of n letters."""
        h = sums[:, n:] - sums[:, : sums.shape[1] - n] * np.uint64(pow(BASE, n, 1 << 64))
        h = (h ^ (h >> np.uint64(32)) ^ np.uint64(n)) * MIX
        return h ^ (h >> np.uint64(29))

    def spans(self, c: np.ndarray) -> list[np.ndarray]:
        """For each width from 1 on, (words x starts) numbers. 0: no such piece; 1: a single character that is no piece."""
        sums, out = self.sums(c), []
        for n in range(1, min(self.longest, c.shape[1]) + 1):
            h = self.hashed(sums, n)
            ids = np.zeros(h.shape, dtype=np.int32)
            maybe = np.nonzero(self.some[h >> np.uint64(44)])
            if len(self.hash) and len(maybe[0]):
                x = h[maybe]
                at = np.minimum(np.searchsorted(self.hash, x), len(self.hash) - 1)
                ids[maybe] = np.where(self.hash[at] == x, self.number[at], 0)
            if n == 1:
                ids[ids == 0] = 1
            out.append(ids)
        return out


class Lattice:
    """Words side by side: the piece of every span, then forward and backward passes."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.c = points([MARK + w for w in words])
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        self.n = self.c.shape[1]
        # by end: the width, the words that have a piece there, and its number
        self.ending: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.n + 1)]
        for k, ids in enumerate(pieces.spans(self.c), 1):
            hit = ids.T > 0
            for start in np.nonzero(hit.any(axis=1))[0].tolist():
                w = np.nonzero(hit[start] & (self.size >= start + k))[0]
                if len(w):
                    self.ending[start + k].append((k, w, ids[w, start]))

    def forward(self, p: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """log of each word's probability [word, language]; p: a row for each piece, a column for each language.

        With `every` also alpha[position, word, language] and the logarithms of what it was divided by.
        """
        shape = (self.n + 1, len(self.size), p.shape[1])
        a, logs, scale = np.zeros(shape), np.zeros(shape) if every else None, np.zeros(shape[1:])
        out = np.zeros(shape[1:])
        a[0] = 1
        reach = max((k for found in self.ending for k, _, _ in found), default=1)
        for j in range(1, self.n + 1):
            for k, w, ids in self.ending[j]:
                a[j][w] += a[j - k][w] * p[ids]
            if j % RESCALE == 0:
                # what later positions can still reach is divided by the same
                near = slice(max(0, j - reach + 1), j + 1)
                most = a[near].max(axis=0)
                most[most <= 0] = 1
                a[near] /= most
                scale = scale + np.log(most)
                if every:
                    logs[near] = scale
            elif every:
                logs[j] = scale
            ends = self.size == j
            if ends.any():
                out[ends] = np.log(a[j][ends]) + scale[ends]
        return (out, a, logs) if every else out

    def expected(self, p: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
        """How often each piece is expected in these words, for one language (p has one column)."""
        total, a, up = self.forward(p, every=True)
        a, up, total, p = a[..., 0], up[..., 0], total[:, 0], p[:, 0]
        b, down, scale = np.zeros_like(a), np.zeros_like(a), np.zeros(a.shape[1])
        b[self.size, np.arange(len(self.size))] = 1
        reach = max((k for found in self.ending for k, _, _ in found), default=1)
        out = np.zeros(size)
        for j in range(self.n, -1, -1):
            if j % RESCALE == 0:
                near = slice(max(0, j - reach), j + 1)
                most = np.where((b[j] > 0) & (self.size > j), b[j], 1)
                b[near] /= most
                scale = scale + np.log(most)
                down[near] = scale
            else:
                down[max(0, j - reach) : j + 1] = scale
            for k, w, ids in self.ending[j]:
                i = j - k
                part = p[ids] * b[j][w]
                out += np.bincount(ids, times[w] * a[i][w] * part * np.exp(up[i][w] + down[j][w] - total[w]), size)
                b[i][w] += part
        return out


def long_forward(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The forward pass over one long word, all pieces that end at a position at once."""
    spans = pieces.spans(points([MARK + word]))
    n, reach = len(word) + 1, len(spans)
    ids = np.zeros((n + 1, reach), dtype=np.int32)  # [end, reach - width]
    for k, found in enumerate(spans, 1):
        ids[k:, reach - k] = found[0]
    a, scale = np.zeros((n + 1 + reach, p.shape[1])), np.zeros(p.shape[1])
    a[reach] = 1
    for j in range(1, n + 1):
        a[reach + j] = (a[j : j + reach] * p[ids[j]]).sum(axis=0)
        if j % RESCALE == 0:
            most = a[j + 1 : reach + j + 1].max(axis=0)
            a[j + 1 : reach + j + 1] /= most
            scale += np.log(most)
    return np.log(a[reach + n]) + scale


def by_length(words: list[str], exact: bool = False) -> list[np.ndarray]:
    """The places of words of about the same length (of the same with `exact`), about LETTERS letters in a group."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    sizes, groups, start = sizes[order], [], 0
    while start < len(order):
        least = int(sizes[start])
        end = int(np.searchsorted(sizes, least if exact else least * 1.2, "right"))
        end = min(end, start + max(1, LETTERS // int(sizes[end - 1] + 1)))
        groups.append(order[start:end])
        start = end
    return groups


class Model:
    """langs, and probs[piece + 2, language]; rows 0 and 1 are `no piece` and `unknown character`."""

    def __init__(self, pieces: list[str], langs: list[str], probs: np.ndarray):
        self.pieces, self.langs, self.probs = pieces, langs, probs

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)

    def logs(self, found: list[str]) -> np.ndarray:
        """(words x languages + 1) log probabilities; the last column counts the parts with letters."""
        if all(map(str.isalpha, found)):
            value = np.ones((len(found), len(self.model.langs) + 1))
            for group in by_length(found):
                words = [found[k] for k in group]
                if len(words[0]) > LONG:
                    value[group, :-1] = [long_forward(w, self.pieces, self.model.probs) for w in words]
                else:
                    value[group, :-1] = Lattice(words, self.pieces).forward(self.model.probs)
            return value
        parts = [letters_of(w) for w in found]
        at = {p: k for k, p in enumerate({p for ps in parts for p in ps})}
        value = self.logs(list(at))
        return np.array([value[[at[p] for p in ps]].sum(axis=0) for ps in parts]).reshape(len(parts), value.shape[1])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for start, end in chunks(texts):
            found = [runs(t.lower()) if t else [] for t in texts[start:end]]
            flat = list(chain.from_iterable(found))
            at = dict.fromkeys(flat)
            # a constant row last, so that every text has one
            rows = np.concatenate([self.logs(list(at)), np.zeros((1, len(self.model.langs) + 1))])
            at.update(zip(at, range(len(at)), strict=True))
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.insert(np.fromiter(map(at.__getitem__, flat), dtype=np.int64, count=len(flat)), np.cumsum(sizes), len(at))
            sizes += 1
            totals = np.add.reduceat(rows[flat], np.cumsum(sizes) - sizes)
            known = (totals[:, -1] > 0) & (len(self.model.langs) > 0)
            logs = totals[:, :-1] if len(self.model.langs) else np.zeros((len(totals), 1))
            best = logs.argmax(axis=1)
            sure = 1 / np.exp(logs - logs[np.arange(len(logs)), best, None]).sum(axis=1)
            langs += [self.model.langs[b] if k else UNKNOWN for k, b in zip(known, best, strict=True)]
            scores += np.where(known, sure, 0.0).tolist()
        return langs, scores


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of the letter runs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for t, code in zip(b["text"], b["lang"], strict=True):
                counts[code].update(p for w in runs(t.lower()) for p in letters_of(w))
            rows = [(code, w, n) for code, c in counts.items() for w, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    text_batches(docs.sparkSession)
    pairs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInPandas(released(count), "lang string, word string, n long")
    return pairs.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary: str = VOCABULARY, docs_per_language: int = 1500, rounds: int = 3, most_languages: int = 1000) -> Model:
    """EM over about docs_per_language labelled rows of each language, chosen by a hash of the key.

    What reaches the driver is bounded: a row for each language, and one for each language and piece.
    """
    docs = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang}")
    pieces, langs = pieces_of(vocabulary), sorted(sizes)
    probs = np.zeros((len(pieces) + 2, len(langs)))
    if not langs:
        return Model(pieces, langs, probs)
    rate: Column = F.lit(False)
    for code, n in sizes.items():
        rate = rate | ((F.col(lang) == code) & share_of(F.col(key), docs_per_language / n, 6))
    counts = cut(word_counts(docs.filter(rate), text, lang))
    probs[2:] = 1 / len(pieces)
    probs[1] = RARE
    for _ in range(rounds):
        probs = step(counts, pieces, langs, probs)
    return Model(pieces, langs, probs)


def step(counts: DataFrame, pieces: list[str], langs: list[str], probs: np.ndarray) -> np.ndarray:
    """One round of EM: expected counts on the executors, their sums on the driver."""
    size = len(pieces) + 2

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pieces(pieces)
        total = np.zeros((size, len(langs)))
        for b in batches:
            for code, rows in b.groupby("lang"):
                c, words, times = langs.index(code), rows["word"].tolist(), rows["n"].to_numpy(dtype=float)
                for group in by_length(words):
                    total[:, c] += Lattice([words[k] for k in group], known).expected(probs[:, [c]], times[group], size)
        at, c = np.nonzero(total)
        yield pd.DataFrame({"piece": at, "lang": c, "n": total[at, c]})

    sums = counts.mapInPandas(released(expect), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    new = np.zeros((size, len(langs)))
    new[sums["piece"], sums["lang"]] = sums["n"]
    new[:2] = 0
    new[2:] += ADDED
    new /= new.sum(0)
    new[1] = RARE
    return new


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its posterior probability; no shuffle. Existing columns of these names are replaced."""
    new = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return appended(docs, [text], new, lambda: model.scorer().score)
