"""Operator 9, secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are credential formats, values assigned to a telling name, passwords in URLs, and long runs
of mixed letters and digits. A random forest (bootstrap samples, a random part of the features at each split, Gini
impurity) judges each by its length, character classes and transitions, entropy, dictionary coverage,
the path it was found under and the words beside it. It is trained from labelled findings: a table
given by the user, or `labelled_findings`, which writes findings of both kinds by rule (keys, tokens
and passwords; commit and checksum digests, data URIs, UUIDs, placeholders, identifiers, paths, numbers).

Everything is done within a row; nothing is shuffled. The forest and the dictionary, both bounded,
travel with the tasks.

Defined cases: null and empty texts have no candidate and stay as they are. Candidates that overlap
are judged one by one; accepted ones are masked together. Repeated rows each get their findings. A document without an
accepted finding is returned unchanged.
"""

from __future__ import annotations

import json
import random
import re
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import appended

DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"
MASK = "[SECRET]"
ACCEPT = 0.5

NAMED = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|account[_-]?key|(?:auth|access|refresh|session)[_-]?token|auth(?:orization)?|credentials?"
RULES = (
    ("key_id", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("prefixed", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,})")),
    # up to its end mark; cut off: header lines and lines of base64 only
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]*PRIVATE KEY-----|(?:\s*[A-Z][A-Za-z-]+: [^\n]*)*(?:\s+[A-Za-z0-9+/]{16,}={0,2}(?![^\s]))*)")),
    ("assigned", re.compile(rf"(?i)(?<![a-z])(?:{NAMED})[\"']?(?:\s{{1,2}}is)?\s{{0,2}}(?:=|:|=>)\s{{0,2}}[\"']?(?P<value>[^\s\"'<>,;]{{6,}})")),
    ("mixed", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}")),
    ("phrase", re.compile(rf"(?i)(?<![a-z])(?:{NAMED})[\"']?(?:\s{{1,2}}is)?\s{{0,2}}(?:=|:|=>)\s{{0,2}}(?P<quote>[\"'])(?P<value>(?=[^\"'\n]*\s)[^\"'\n]{{6,}})(?P=quote)")),
    ("url", re.compile(r"://[^\s:/@]*:(?P<value>[^\s:/@]{3,})@")),
)
TELLING = re.compile(rf"(?i)(?:{NAMED}|key|login|bearer)")
DIGEST = re.compile(r"(?i)(?:sha\d*|md5|commit|checksum|digest|etag|integrity|uuid|guid|hash|revision|version|serial|order|invoice|isbn|id|base64|class|href|src)\b")
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|your|placeholder|dummy|sample|xxx|\*\*\*|\.\.\.|<|\$\{|todo|none|null|test|foo|123456|abcdef")
TAME_PATH = re.compile(r"(?i)test|example|sample|docs?/|\.md$|\.lock$|fixture|mock")
CONFIG_PATH = re.compile(r"(?i)\.env|\.ya?ml$|\.ini$|\.cfg$|\.conf|\.properties$|settings|config|secret")
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "transitions", "entropy", "distinct", "longest_run", "hex", "hex_length", "dashes", "slashes", "dots",
    "coverage", "placeholder", "telling_before", "digest_before", "assigned", "quoted", "tame_path", "config_path", "rule", "vowels",
)


def dictionary(path: str = DICTIONARY) -> frozenset[str]:
    """Words of four letters or more of a public vocabulary. Read on the driver only."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(w.removesuffix("</w>") for w in vocab if w.endswith("</w>") and re.fullmatch(r"[a-z]{4,}</w>", w))


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, rule number), by start; one for each span, by the first rule that gives it. Spans may overlap."""
    if not text:
        return []
    found: dict[tuple[int, int], int] = {}
    for k, (_, rule) in enumerate(RULES):
        for m in rule.finditer(text):
            found.setdefault(m.span("value" if "value" in rule.groupindex else 0), k)
    return sorted(((s, e, k) for (s, e), k in found.items()), key=lambda x: (x[0], -x[1], x[2]))


def coverage(value: str, words: frozenset[str]) -> float:
    """The share of the value that dictionary words cover, longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(16, len(low) - at), 3, -1) if low[at : at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(low))


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features_of(value: str, before: str, after: str, rule: int, path: str, words: frozenset[str]) -> list[float]:
    """The FEATURES of one finding; before and after: the text beside it, on its line."""
    n = max(1, len(value))
    kinds = [kind(c) for c in value]
    counts = np.unique(list(value), return_counts=True)[1] / n if value else np.ones(1)
    run = most = 1
    for a, b in pairwise(value):
        run = run + 1 if a == b else 1
        most = max(most, run)
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None
    near = " ".join(before.split()[-3:])
    return [
        float(np.log(n)), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n, sum(a != b for a, b in pairwise(kinds)) / n,
        float(-(counts * np.log2(counts)).sum()), len(set(value)) / n, most / n, float(hexa), float(n if hexa else 0), value.count("-") / n, value.count("/") / n,
        value.count(".") / n, coverage(value, words), float(PLACEHOLDER.search(value) is not None), float(TELLING.search(near) is not None),
        float(DIGEST.search(near) is not None), float(re.search(r"[=:]\s*[\"']?$", before) is not None), float(before.endswith(("'", '"')) and after.startswith(("'", '"'))),
        float(TAME_PATH.search(path) is not None), float(CONFIG_PATH.search(path) is not None), float(rule), sum(c in "aeiouAEIOU" for c in value) / n,
    ]


def beside(text: str, start: int, end: int, reach: int = 60) -> tuple[str, str]:
    before, after = text[max(0, start - reach) : start], text[end : end + reach]
    return before.rpartition("\n")[2], after.partition("\n")[0]


class Tree:
    """A classification tree as arrays; a node with feature -1 is a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, chance: np.random.Generator, depth: int, least: int):
        self.feature, self.cut, self.low, self.value, self.depth = [], [], [], [], []
        self.grow(x, y, chance, depth, least)
        self.feature, self.cut, self.low, self.value = np.array(self.feature), np.array(self.cut), np.array(self.low), np.array(self.value)

    def grow(self, x: np.ndarray, y: np.ndarray, chance: np.random.Generator, depth: int, least: int) -> None:
        """Level by level; the children of a node are low and low + 1."""
        waiting = [(np.arange(len(y)), 0)]
        self.add(y)
        for rows, at in waiting:
            level = self.depth[at]
            if level >= depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
                continue
            split = best_split(x[rows], y[rows], chance.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])))], least)
            if split is None:
                continue
            self.feature[at], self.cut[at] = split
            self.low[at] = len(self.feature)
            below = x[rows, split[0]] <= split[1]
            for part in (rows[below], rows[~below]):
                waiting.append((part, len(self.feature)))
                self.add(y[part], level + 1)

    def add(self, y: np.ndarray, level: int = 0) -> None:
        self.depth.append(level)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.low.append(0)
        self.value.append(float(y.mean()) if len(y) else 0.5)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, self.low[at] + right, at)


def best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[int, float] | None:
    """(feature, cut) with the smallest Gini impurity; None if no cut leaves `least` rows on each side."""
    best, n = None, len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
        bad = np.where(ok, k * p * (1 - p) + (n - k) * q * (1 - q), np.inf)
        i = int(bad.argmin())
        if best is None or bad[i] < best[0]:
            best = (bad[i], int(f), float((v[i] + v[i + 1]) / 2))
    return best and best[1:]


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, least: int = 2, seed: int = 9):
        chance = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = chance.integers(0, len(y), len(y))
            self.trees.append(Tree(x[rows], y[rows], chance, depth, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def labelled_findings(words: frozenset[str], n: int = 3000, seed: int = 9) -> list[tuple[str, str, int]]:
    """(text, path, label): n lines with one finding each, half of them secrets."""
    r = random.Random(seed)
    plain = sorted(w for w in words if len(w) <= 9)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = "0123456789abcdef", low + up + num + "+/"
    word = lambda: r.choice(plain)
    say = lambda k: " ".join(word() for _ in range(k))
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "access_key", "auth", "client_secret", "pwd", "accessToken", "account_key"])
    op = lambda: r.choice(["=", " = ", ": ", ":", "=\"", " = \"", "='"])

    def close(o: str) -> str:
        return o[-1] if o[-1] in "\"'" else ""

    def secret() -> str:
        form = r.randrange(12)
        o = op()
        if form == 10:
            return r.choice(["postgres", "mysql", "https", "amqp"]) + "://" + word() + ":" + pick(low + up + num + "!$%-_", r.randrange(7, 20)) + "@" + word() + "." + r.choice(["com", "internal", "net:5432/main"])
        if form == 11:
            return r.choice(["bearer ", "key ", "secret ", "token ", "password "]) + r.choice(["", "is: "]) + r.choice([pick(hexa, r.choice([24, 32, 40])), word().title() + pick(num, 2) + pick("!#%&", 1) + pick(low + up + num, 16)])
        if form == 0:
            return "AKIA" + pick(up + "234567" + num, 16)
        if form == 1:
            return r.choice(["ghp_" + pick(low + up + num, 36), "sk_live_" + pick(low + up + num, 24), "xoxb-" + pick(num, 12) + "-" + pick(low + up + num, 24)])
        if form in (2, 3):
            return name() + o + pick(hexa, r.choice([12, 16, 18, 20, 24, 32, 40, 64])) + close(o)
        if form == 4:
            return name() + o + pick(b64, r.choice([20, 24, 32, 40])) + close(o)
        if form == 5:
            return name() + o + pick(low + up + num + "!#%&*-_", r.randrange(9, 20)) + close(o)
        if form == 6:
            return r.choice(["bearer ", "key ", "secret ", "token "]) + pick(low + up + num, r.randrange(24, 48))
        if form == 7:
            return name() + o + word() + pick(num, r.randrange(1, 4)) + close(o)
        if form == 8:
            return name() + r.choice(["=", " = ", ": "]) + "\"" + say(r.randrange(2, 4)) + " " + pick(num, r.randrange(1, 3)) + "\""
        return name() + o + r.choice([word() + pick(num, 3) + pick("!#%&", 1) + pick(up, 2), word().title() + pick("!#%&", 1) + pick(num + up, 5)]) + close(o)

    def harmless() -> str:
        form = r.randrange(16)
        o = op()
        if form == 10:
            return r.choice(["integrity: \"sha512-", "integrity=\"sha256-", "sha1 ", "Content-MD5: ", "checksum=\"", "md5: "]) + pick(b64, r.choice([22, 27, 43, 86])) + "=="
        if form == 11:
            return r.choice(["src=\"data:image/png;base64,", "url(data:font/woff;base64,", "href=\"data:image/gif;base64,"]) + pick(b64, r.randrange(30, 90))
        if form == 12:
            return ".".join(word() for _ in range(3)) + "." + "".join(word().title() for _ in range(4)) + pick(num, r.randrange(1, 3)) + word().title()
        if form == 13:
            return r.choice(["class=\"", "src=\"", "href=\""]) + word() + "-" + pick(low + num, r.randrange(6, 20)) + "-" + word() + "-" + word() + "\""
        if form == 14:
            return name() + o + "/" + "/".join(word() for _ in range(r.randrange(2, 5))) + "." + r.choice(["pem", "txt", "key"]) + close(o)
        if form == 15:
            letters = r.choice(["ACGT", "01", up[:6]])
            return pick(letters, r.randrange(22, 60)) + pick(num + up[:1], 2) + pick(letters, 3) + "7A"
        if form == 0:
            return r.choice(["commit ", "sha1 ", "md5 ", "checksum: ", "etag ", "integrity sha256 ", "digest: ", "revision "]) + pick(hexa, r.choice([32, 40, 64]))
        if form == 1:
            return r.choice(["id ", "uuid ", "guid=", "request id: "]) + "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
        if form == 2:
            return name() + o + r.choice(["changeme", "your_password", "xxxxxxxxxx", "example", "placeholder", "********", "${PASSWORD}", "<your-token>", "none", "test1234", "dummy-token", "123456789"]) + close(o)
        if form == 3:
            return word() + "_" + word() + "_" + word() + "_" + pick(num, r.randrange(1, 4))
        if form == 4:
            return "/".join(word() for _ in range(4)) + "/" + word() + pick(num, 2)
        if form == 5:
            return r.choice(["order ", "serial ", "invoice ", "isbn "]) + pick(num, 4) + r.choice(["A", "B", "-X"]) + pick(num, 17)
        if form == 6:
            return name() + o + r.choice([word() + "." + word(), "get_" + word(), word() + "()", "self." + word(), word(), word() + "_" + word()]) + close(o)
        if form == 7:
            return name() + ": " + say(1) + " " + say(2)
        if form == 8:
            return word() + "-" + word() + "-" + word() + "-v" + pick(num, 1) + "-" + pick(num, 8)
        return name() + o + word().title() + word().title() + close(o)

    paths = {1: ["src/app.py", "config/settings.yaml", ".env", "src0", "notes.txt", ""], 0: ["tests/test_app.py", "docs/readme.md", "yarn.lock", "src0", "src/app.py", ""]}
    out = []
    for k in range(n):
        label = k % 2
        line = f"{say(r.randrange(0, 6))} {secret() if label else harmless()} {say(r.randrange(0, 5))}".strip()
        out.append((line, r.choice(paths[label]), label))
    return out


class Model:
    def __init__(self, forest: Forest, words: frozenset[str]):
        self.forest, self.words = forest, words

    def scan(self, text: str | None, path: str | None = "") -> list[tuple[int, int, int, float]]:
        """(start, end, rule number, score) of every candidate of a text."""
        found = candidates(text)
        if not found:
            return []
        x = np.array([features_of(text[s:e], *beside(text, s, e), k, path or "", self.words) for s, e, k in found])
        return [(*f, float(p)) for f, p in zip(found, self.forest.predict(x), strict=True)]


def fit(findings: list[tuple[str, str, int]] | None = None, path: str = DICTIONARY) -> Model:
    """From labelled findings (text, path, label); each text's first candidate is the finding. Small, on the driver."""
    words = dictionary(path)
    x, y = [], []
    for text, where, label in labelled_findings(words) if findings is None else findings:
        if found := candidates(text):
            s, e, k = found[0]
            x.append(features_of(text[s:e], *beside(text, s, e), k, where, words))
            y.append(label)
    return Model(Forest(np.array(x), np.array(y, dtype=float)), words)


FINDING = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("score", T.DoubleType())])


def scan(docs: DataFrame, model: Model, text: str = "text", path: str = "source", accept: float = ACCEPT, names: tuple[str, str] = ("findings", "clean_text")) -> DataFrame:
    """docs with `findings` (an array of FINDING structs: all candidates) and `clean_text`, where the accepted ones are masked. Existing columns of these names are replaced."""
    new = T.StructType([T.StructField(names[0], T.ArrayType(FINDING)), T.StructField(names[1], T.StringType())])

    def find(texts: list, paths: list) -> list[list]:
        all_found, clean = [], []
        for t, p in zip(texts, paths, strict=True):
            found = model.scan(t, p)
            all_found.append([{"start": s, "end": e, "rule": RULES[k][0], "score": score} for s, e, k, score in found])
            clean.append(masked(t, [(s, e) for s, e, _, score in found if score >= accept]))
        return [all_found, clean]

    return appended(docs, [text, path], new, lambda: find)


def masked(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            parts += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*parts, text[at:]])
