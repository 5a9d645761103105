"""Secrets in texts: fixed patterns, and a battery of randomness tests for what has no pattern.

A candidate is a long run of characters that encodings use. Its encoding is
inferred, and three tests look at its characters there: chi-squared against a
uniform alphabet, runs above and below the middle, and serial correlation.
None may speak against randomness. Then chi-squared, and the number of runs of
letters of one case and of digits, are held against what ordinary strings of
the corpus with the same encoding and length would give; both chances,
combined by Fisher's method, are the candidate's p-value. Short strings can
hardly get a small one, so length takes care of itself, and the false
discovery rate is controlled over all candidates of the corpus, separately
for each encoding.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import map_columns, replace_column
from ambry.llm.spans import Covered, Span, matches

KINDS = ["assign", "access", "hex", "random"]
SHORTEST = 16
FALSE_DISCOVERIES = 0.01
VETO = 1e-4
BINS = 600
PER_BIN = 0.1

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ASSIGN_PARTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}+")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % SHORTEST)

DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: fixed values: the alphabets of common encodings, in the order of their digits
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + UPPER.lower(),
    "base36_upper": DIGITS + UPPER,
    "base62": DIGITS + UPPER + UPPER.lower(),
    "base64": UPPER + UPPER.lower() + DIGITS + "+/",
    "base64_url": UPPER + UPPER.lower() + DIGITS + "-_",
}
NAMES = list(ALPHABETS)
_SETS = [(k, frozenset(a)) for k, a in ALPHABETS.items()]
_PLACE = {k: {c: i for i, c in enumerate(a)} for k, a in ALPHABETS.items()}


def base_spans(text: str | None) -> list[Span]:
    """Secrets of the three fixed kinds."""
    if not text:
        return []
    out: list[Span] = []
    small = text.lower()
    if any(x in small for x in _ASSIGN_PARTS):
        out += matches(_ASSIGN, text, "assign", lambda m: len(m[2]) >= 8)
    if "AKIA" in text:
        out += matches(_ACCESS, text, "access", lambda m: m.end() - m.start() >= 16)
    # a run of 32 or more is found whole: what precedes it cannot be part of it
    out += matches(_HEX, text, "hex", lambda m: True)
    return out


def candidates(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)] if text else []


def encoding(string: str) -> str | None:
    """The narrowest alphabet that holds all characters, padding aside."""
    used = frozenset(string.rstrip("="))
    return next((k for k, alphabet in _SETS if used <= alphabet), None)


def digits(string: str, name: str) -> np.ndarray:
    place = _PLACE[name]
    return np.array([place[c] for c in string.rstrip("=")], float)


def chi_squared(values: np.ndarray, size: int) -> float:
    counts = np.bincount(values.astype(int), minlength=size)
    return float(size / values.size * (counts.astype(float) ** 2).sum() - values.size)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def runs_p(values: np.ndarray, size: int) -> float:
    """Chance of so many or so few runs above and below the middle of the alphabet."""
    above = values >= size / 2
    n1 = int(above.sum())
    n2 = values.size - n1
    if n1 == 0 or n2 == 0:
        return 2.0 ** (1 - values.size)
    n = n1 + n2
    expected = 2 * n1 * n2 / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    found = 1 + int((above[1:] != above[:-1]).sum())
    return two_sided((found - expected) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_p(values: np.ndarray) -> float:
    """Chance of such a correlation between neighbours."""
    n = values.size
    away = values - values.mean()
    spread = float((away**2).sum())
    if spread == 0:
        return 0.0
    r = float((away[1:] * away[:-1]).sum()) / spread
    return two_sided((r + 1 / n) * math.sqrt(n))


def uniform_p(statistic: float, size: int) -> float:
    """Chance of so great a chi-squared under a uniform alphabet, by Wilson and Hilferty."""
    free = 2 / (9 * (size - 1))
    z = ((statistic / (size - 1)) ** (1 / 3) - (1 - free)) / math.sqrt(free)
    return 0.5 * math.erfc(z / math.sqrt(2))


def _class(mark: str) -> int:
    return 0 if mark.isdigit() else 1 if mark.islower() else 2 if mark.isupper() else 3


def switches(string: str) -> int:
    """How often neighbours are of different classes: digits, small letters, capitals, others."""
    kinds = list(map(_class, string.rstrip("=")))
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def log10_poisson_upper(found: int, mean: float) -> float:
    """Bound on log10 of the chance of at least ``found`` rare events, by Chernoff."""
    if found <= mean:
        return 0.0
    return (found - mean - found * math.log(found / mean)) / math.log(10)


def ordinary(shares: np.ndarray, n: int, size: int) -> tuple[float, float]:
    """Mean and standard deviation of chi-squared over ordinary strings of ``n`` characters."""
    p2, p3 = float((shares**2).sum()), float((shares**3).sum())
    pairs = n * (n - 1) * p2
    spread = 2 * n * (n - 1) * (p2 - p2**2) + 4 * n * (n - 1) * (n - 2) * (p3 - p2**2)
    return size / n * (n + pairs) - n, size / n * math.sqrt(max(spread, 1e-12))


def log10_lower(z: float) -> float:
    """log10 of the normal chance below z, far into the tail."""
    if z > -30:
        return math.log10(max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300))
    return (-z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))) / math.log(10)


@dataclass
class Ordinary:
    """Shares of characters in ordinary strings, per encoding."""

    shares: dict[str, np.ndarray]

    def evidence(self, string: str) -> tuple[str, float] | None:
        """(encoding, -log10 p) against an ordinary string; None where a test rules randomness out."""
        name = encoding(string)
        if name is None or len(string.rstrip("=")) < SHORTEST:
            return None
        values, size = digits(string, name), len(ALPHABETS[name])
        statistic = chi_squared(values, size)
        if min(uniform_p(statistic, size), runs_p(values, size), serial_p(values)) < VETO:
            return None
        shares = self.shares[name]
        mean, spread = ordinary(shares, values.size, size)
        by_class = np.bincount([_class(c) for c in ALPHABETS[name]], weights=shares)
        expected = (values.size - 1) * max(1e-6, 1 - float((by_class**2).sum()))
        unlike = log10_lower((statistic - mean) / spread) + log10_poisson_upper(switches(string), expected)
        s = -unlike * math.log(10)
        return name, (s - math.log1p(s)) / math.log(10)


def corpus_characters(docs: DataFrame) -> Ordinary:
    """Learns ordinary strings from the characters of all texts.

    One number per character leaves the executors. Where an encoding's
    characters hardly occur, it is taken to be uniform, which finds nothing.
    """
    every = sorted({c for a in ALPHABETS.values() for c in a})

    def make():
        place = {ord(c): i for i, c in enumerate(every)}
        table = np.full(128, len(every))
        for code, i in place.items():
            table[code] = i

        def apply(texts):
            total = np.zeros(len(every) + 1, np.int64)
            for text in texts:
                # other bytes of UTF-8 belong to no encoding
                raw = np.frombuffer((text or "").encode(), np.uint8)
                total += np.bincount(table[raw[raw < 128]], minlength=len(every) + 1)
            return {"place": list(range(len(every))), "n": total[:-1].tolist()}

        return apply

    seen = map_columns(docs.select("text"), make, "place int, n long", text="text")
    found = {r["place"]: r["n"] for r in seen.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    number = {c: found.get(i, 0) for i, c in enumerate(every)}
    shares = {}
    for name, alphabet in ALPHABETS.items():
        counts = np.array([number[c] for c in alphabet], float)
        shares[name] = (counts + 1) / (counts.sum() + len(alphabet)) if counts.sum() >= 1000 else np.full(len(alphabet), 1 / len(alphabet))
    return Ordinary(shares)


def thresholds(docs: DataFrame, model: Ordinary, rate: float = FALSE_DISCOVERIES) -> dict[str, float]:
    """Least -log10 p that counts as a secret, per encoding.

    Benjamini and Hochberg's step-up over all candidates, from a histogram of
    ``BINS`` steps: the least evidence at which the expected number of ordinary
    strings is no more than ``rate`` of what is found. Where an encoding has
    none, it is the evidence at which a single one would count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        ordinary_strings = shared.value

        def apply(texts):
            total: dict[tuple[str, int], int] = {}
            for text in texts:
                for start, end in candidates(text):
                    string = text[start:end]
                    name = encoding(string)
                    if name is not None:
                        found = ordinary_strings.evidence(string)
                        step = -1 if found is None else min(BINS - 1, int(found[1] / PER_BIN))
                        total[name, step] = total.get((name, step), 0) + 1
            keys = list(total)
            return {"name": [k[0] for k in keys], "step": [k[1] for k in keys], "n": list(total.values())}

        return apply

    seen = map_columns(docs.select("text"), make, "name string, step int, n long", text="text")
    histogram: dict[str, dict[int, int]] = {k: {} for k in NAMES}
    for row in seen.groupBy("name", "step").agg(F.sum("n").alias("n")).collect():
        histogram[row["name"]][row["step"]] = row["n"]
    out = {}
    for name, steps in histogram.items():
        total = sum(steps.values())
        above, out[name] = 0, math.log10((total + 1) / rate)
        for step in range(BINS - 1, -1, -1):
            above += steps.get(step, 0)
            if above and total * 10 ** (-step * PER_BIN) <= rate * above:
                out[name] = step * PER_BIN
    return out


@dataclass
class Scanner:
    model: Ordinary
    least: dict[str, float]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(fixed kinds, added): added ones never overlap the fixed ones."""
        base = base_spans(text)
        taken = Covered(base)
        added: list[Span] = []
        for start, end in candidates(text):
            if taken.touches(start, end):
                continue
            found = self.model.evidence(text[start:end])
            if found is not None and found[1] >= self.least[found[0]]:
                added.append((start, end, "random"))
        return base, added


def fit(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> Scanner:
    """A scanner whose ordinary strings and thresholds come from all of ``docs`` (text)."""
    model = corpus_characters(docs)
    return Scanner(model, thresholds(docs, model, rate))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, base, added): spans as arrays of (start, end, kind) in code points.

    A null or empty text has none. Rows are looked at one by one, so repeated
    ones repeat their answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def make():
        spans = shared.value.spans

        def apply(ids, texts):
            found = [spans(t) for t in texts]
            keys = ("start", "end", "kind")
            return {
                "doc_id": ids,
                "base": [[dict(zip(keys, s, strict=True)) for s in x[0]] for x in found],
                "added": [[dict(zip(keys, s, strict=True)) for s in x[1]] for x in found],
            }

        return apply

    kind = "array<struct<start: int, end: int, kind: string>>"
    return map_columns(docs.select("doc_id", "text"), make, f"doc_id long, base {kind}, added {kind}", text="text")


def redact(docs: DataFrame, scanner: Scanner, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping ones by one mark.

    All other columns stay as they are, and so do null texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def make():
        spans = shared.value.spans

        def clean(text):
            base, added = spans(text)
            out, at = [], 0
            for start, end, _ in sorted(base + added):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]]) if at else text

        return lambda texts: [clean(t) for t in texts]

    return replace_column(docs, make)
