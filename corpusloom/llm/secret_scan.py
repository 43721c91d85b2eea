"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of key-like characters of any length from 16 up that holds a digit or changes
case, or the value of an assignment to a telling name, which may be part of a longer name; the value
goes before a run that holds it together with its name. Its features are the length, the
make-up and transitions of its characters, how much of it words of a dictionary cover, its path or
source, and the words next to it. The forest is trained on labelled findings, at most
`max_findings` of them; where none are given, on findings of known truth made from a seed, which
imitate tokens, keys and passwords in assignments as well as the usual false alarms (word
compounds, numbers of cards and phones, addresses, paths, versions, placeholders, checksums).

Everything is one pass over the whole texts without a shuffle. Findings carry offsets in code points.

Cases: null and empty texts have no findings; a run of any length is one candidate, overlapping
ones do not exist; equal candidates at several places are several findings; an empty table gives an
empty result; the path column may be null or missing, other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches

MAX_FINDINGS, TREES, DEPTH, LEAF = 4000, 40, 9, 3

_RUN = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
#: Key-like runs with the punctuation that passwords have; where no plain run is inside, they are candidates.
_WIDE = re.compile(r"[A-Za-z0-9+/_=~.!#$%&*-]{16,}")
#: Any name before an assigned value, of which only the start is looked at, as it may be an assignment itself.
_ASSIGNED = re.compile(r"""(?<![\w-])([\w-]++)["']?\s{0,3}(?::=|=>?|:)\s{0,3}["']?(?=[^\s"',;]{6})""")
_VALUE_END = re.compile(r"""[\s"',;]|\Z""")
_NAMED = re.compile(r"(?i)(?<![^\W_])(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|key|auth|bearer)(?![^\W_])")
_TELLING = re.compile(r"(?i)pass|pwd|secret|token|key|auth|bearer|credential|private|api")
_PLAIN = re.compile(r"(?i)example|sample|dummy|test|placeholder|changeme|your|xxx|commit|sha|md5|checksum|hash|version|http|www|id\b|uuid|card|phone|mail")
_HEX = re.compile(r"[0-9a-fA-F]+")
_PATHS = re.compile(r"(?i)\.(?:env|pem|key|cfg|conf|ini|ya?ml|json|properties|tf|sh)$|config|settings|deploy|secret")

FEATURE_NAMES = (
    "length", "digits", "upper", "lower", "other", "is_hex", "entropy", "class_changes", "transition_surprise", "rare_transitions",
    "dictionary_share", "longest_word", "distinct", "longest_run", "telling_before", "plain_before", "assigned", "quoted", "address_like",
    "dots", "slashes", "numeric", "key_length", "path_telling", "path_known", "word_before_share", "word_after_share", "starts_line",
)


class Language:
    """A dictionary of words and the character transitions seen in them."""

    def __init__(self, words: list[str]):
        self.words = {w for w in words if len(w) >= 4}
        self.longest = max(map(len, self.words), default=0)
        pairs, firsts = Counter(), Counter()
        for w in words:
            for a, b in zip(w, w[1:]):
                pairs[a + b] += 1
                firsts[a] += 1
        self.surprise = {p: -math.log2((n + 0.5) / (firsts[p[0]] + 20)) for p, n in pairs.items()}
        self.unseen = 8.0

    def coverage(self, text: str) -> tuple[float, int]:
        """Share of the characters inside dictionary words, longest first from the left, and the longest word."""
        low, i, covered, longest = text.lower(), 0, 0, 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i), 3, -1):
                if low[i : i + n] in self.words:
                    covered += n
                    longest = max(longest, n)
                    i += n
                    break
            else:
                i += 1
        return covered / max(len(low), 1), longest

    def transitions(self, text: str) -> tuple[float, float]:
        """Mean surprise of neighbouring characters, and the share never seen in words."""
        low = text.lower()
        found = [self.surprise.get(low[i : i + 2], self.unseen) for i in range(len(low) - 1)] or [self.unseen]
        return sum(found) / len(found), sum(x >= self.unseen for x in found) / len(found)


def read_words(path: str) -> list[str]:
    """Lower-case words from a public sentencepiece file: its word-initial pieces of letters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return sorted({p[1:].lower() for p in pieces if p[0] == "▁" and p[1:].isascii() and p[1:].isalpha() and len(p) > 3})


def _values(text: str) -> list[tuple[int, int, int]]:
    """Start of the name, start and end of the value of each assignment to a telling name."""
    found: list[tuple[int, int, int]] = []
    stop = last = 0  # the end of the value at hand, without and with its dots
    for m in _ASSIGNED.finditer(text):
        if not _NAMED.search(m[1]):
            continue
        a = m.end()
        if a >= last:
            stop = last = _VALUE_END.search(text, a).start()
            while stop > a and text[stop - 1] == ".":
                stop -= 1
        b = max(stop, a + 6)
        if found and m.start() == found[-1][1]:  # the value before is this assignment
            found[-1] = (found[-1][0], a, b)
        elif not found or a >= found[-1][2]:
            found.append((m.start(), a, b))
    return found


def _keylike(text: str, a: int, b: int) -> tuple[int, int] | None:
    while b > a and text[b - 1] in ".-~":
        b -= 1
    s = text[a:b]
    if b - a >= 16 and (any(c.isdigit() for c in s) or (s != s.lower() and s != s.upper() and s[1:] != s[1:].lower())):
        return a, b
    return None


def _runs(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    for wide in _WIDE.finditer(text, at, end):
        plain = [r for m in _RUN.finditer(text, *wide.span()) if (r := _keylike(text, *m.span()))]
        if plain:
            yield from plain
        elif r := _keylike(text, *wide.span()):
            yield r


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the candidates of a text, in order, without overlap."""
    at = 0
    for name, a, b in _values(text):
        joined = not any(c.isspace() or c in "\"'" for c in text[name:a])  # one run with its value
        yield from _runs(text, at, name if joined else a)
        yield a, b
        at = b
    yield from _runs(text, at, len(text))


def features(before: str, candidate: str, after: str, path: str | None, language: Language) -> list[float]:
    n = len(candidate)
    counts = Counter(candidate)
    digits, upper, lower = (sum(map(f, candidate)) for f in (str.isdigit, str.isupper, str.islower))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in candidate]
    run = best = 1
    for a, b in zip(candidate, candidate[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    surprise, rare = language.transitions(candidate)
    share, longest = language.coverage(candidate)
    near, tail = before[-32:], before[-4:].rstrip()
    words_before, words_after = before[-60:].split(), after[:60].split()
    alpha = lambda some: sum(w.strip(".,;").isalpha() for w in some) / len(some) if some else 0.0
    return [
        min(n, 400), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, float(bool(_HEX.fullmatch(candidate))),
        -sum(c / n * math.log2(c / n) for c in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, surprise, rare,
        share, longest, len(counts) / min(n, 64), best, float(bool(_TELLING.search(near))), float(bool(_PLAIN.search(near))),
        float(tail[-1:] in ("=", ":", ">") or before[-1:] in "\"'" and before[:-1].rstrip()[-1:] in ("=", ":", ">")),
        float(before[-1:] in ("\"", "'") and after[:1] in ("\"", "'")), float("@" in before[-1:] + candidate + after[:1] or "://" in before[-8:] + candidate),
        candidate.count(".") / n, candidate.count("/") / n, float(digits == n), float(n in (20, 24, 32, 36, 40, 44, 48, 64, 86, 88, 128)),
        float(bool(path and _PATHS.search(path))), float(bool(path)), alpha(words_before), alpha(words_after), float(not before or before[-1:] == "\n"),
    ]


def made_findings(language: Language, n: int = MAX_FINDINGS, seed: int = 20) -> list[tuple[str, str, str, str | None, int]]:
    """Labelled findings of known truth: before, candidate, after, path, label. Half are secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda some: some[int(rng.integers(len(some)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    words = sorted(language.words) or ["word"]
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    prose = lambda k: " ".join(pick(words) for _ in range(k))
    names = ("token", "api_key", "secret", "password", "access_key", "auth", "SECRET_KEY", "client_secret", "bearer", "TOKEN", "key")
    out = []
    for i in range(n):
        label, path = i % 2, pick([None, "src0", "app/config.yaml", ".env", "docs/readme.md", "main.py", "src12"])
        before, after = prose(3) + pick([" ", "\n"]), pick([" ", "\n", ". "]) + prose(3)
        if label:
            s = pick([
                lambda: chars("0123456789abcdef", pick([32, 40, 64])),
                lambda: chars("0123456789ABCDEF", pick([32, 40, 64])),
                lambda: chars(mixed, int(rng.integers(20, 65))),
                lambda: chars(mixed + "+/", pick([43, 86])) + "=",
                lambda: pick(["AK", "SK", "pk_", "tok-", "gx_"]) + chars(mixed, pick([16, 24, 36])),
                lambda: chars(mixed + "!#$%&*", int(rng.integers(10, 24))),
            ])()
            quote = pick(["", '"', "'"])
            if rng.random() < 0.85 or len(s) < 16:
                before += pick(names) + pick([" = ", "=", ": ", " := ", " => "]) + quote
                after = quote + after
        else:
            s = pick([
                lambda: "".join(pick(words) for _ in range(int(rng.integers(3, 6)))) + pick(["", "1", "42"]),
                lambda: "".join(pick(words).title() for _ in range(int(rng.integers(3, 5)))),
                lambda: chars("0123456789", int(rng.integers(16, 20))),
                lambda: "/".join([*(pick(words) for _ in range(3)), pick(words) + ".2.txt"]),
                lambda: pick(words) + str(rng.integers(100)) + ".mail" + str(rng.integers(10)) + ".example.com",
                lambda: ".".join(str(rng.integers(1000)) for _ in range(6)),
                lambda: "-".join(pick(words) for _ in range(3)) + "-" + str(rng.integers(2030)),
                lambda: pick(["x", "0", "=", "-", "_", "A1"]) * int(rng.integers(16, 40)),
                lambda: chars("0123456789abcdef", pick([32, 40, 64])),
                lambda: pick(words) + pick(words),
            ])()
            if _HEX.fullmatch(s) and len(s) in (32, 40, 64) and not s.isdigit():
                before += pick(["commit ", "sha1 ", "checksum: ", "md5 ", "rev "])
            elif rng.random() < 0.25:
                before += pick(names) + pick([" = ", ": "]) + pick(["", '"'])
                s = pick([s, "your_" + pick(words) + "_here", "changeme_" + pick(words), "${" + pick(words) + "}", pick(words)])
        out.append((before, s, after, path, label))
    return out


class Forest:
    """Random forest of Gini trees over bootstrap samples, a random share of features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, leaf, rng, nodes)
            self.trees.append(np.array(nodes))  # feature (-1: leaf), threshold, left, right, share of ones

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng: np.random.Generator, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        n = len(y)
        if depth == 0 or n < 2 * leaf or y.min() == y.max():
            return at
        best = (1e-12, -1, 0.0)
        base = 2 * y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1]) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
            gain = base - (k * 2 * p * (1 - p) + (n - k) * 2 * q * (1 - q)) / n
            gain[(v[1:] == v[:-1]) | (k < leaf) | (n - k < leaf)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[at][:2] = [best[1], best[2]]
            nodes[at][2] = self._grow(x[left], y[left], depth - 1, leaf, rng, nodes)
            nodes[at][3] = self._grow(x[~left], y[~left], depth - 1, leaf, rng, nodes)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                here = at[inner]
                right = x[inner, f[inner]] > t[here, 1]
                at[inner] = np.where(right, t[here, 3], t[here, 2]).astype(int)
            total += t[at, 4]
        return total / len(self.trees)


def train(language: Language, findings: DataFrame | None = None, max_findings: int = MAX_FINDINGS) -> Forest:
    """findings: columns before, candidate, after, path, label (0 or 1); rows beyond the bound, by hash, are not used."""
    if findings is None:
        rows = made_findings(language, max_findings)
    else:
        few = findings.select("before", "candidate", "after", "path", "label").filter("candidate is not null and label is not null")
        rows = [tuple(r) for r in few.orderBy(F.xxhash64("before", "candidate", "after")).limit(max_findings).collect()]
    x = np.array([features(b or "", c, a or "", p, language) for b, c, a, p, _ in rows if c])
    return Forest(x, np.array([r[4] for r in rows if r[1]], float))


def _scanner(language: Language, forest: Forest, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, spans, x, sha = [], [], [], []
            for i, (t, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for a, b in candidates(t or ""):
                    doc.append(i)
                    spans.append((a, b))
                    x.append(features(t[max(a - 64, 0) : a], t[a:b], t[b : b + 64], path, language))
                    sha.append(hashlib.sha256(t[a:b].encode()).hexdigest())
            p = forest.probability(np.array(x)) if x else np.empty(0)
            at = np.array(spans, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(sha, pa.string()), pa.array(p), pa.array(p >= threshold)],
                ["doc_id", "start", "end", "candidate_sha256", "score", "is_secret"],
            )

    return scan


def scan(docs: DataFrame, language: Language, forest: Forest, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, candidate_sha256, score, is_secret: one row per candidate."""
    small_batches(docs.sparkSession)
    where = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, start long, end long, candidate_sha256 string, score double, is_secret boolean"
    return docs.select("doc_id", "text", where.alias("path")).mapInArrow(_scanner(language, forest, threshold), out)
