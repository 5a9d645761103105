"""Toxicity of texts: a learned lexicon, met through its misspellings and read in context.

Words that labelled toxic texts prefer form a lexicon, held as a trie. A word
of a text is looked up by a universal Levenshtein automaton that walks the
trie: its states are bands of edit counts, its moves are remembered once for
all words. Every hit is looked at in the window around it, where quotation
marks tell quoting from abuse, and a logistic model turns what was found into
a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import map_columns

#: labelled texts of each label that are learned from, about
SAMPLE = 4_000
#: ordinary words that may be taken for lexicon words, over all words of the sample
MISTAKE = 1.0
WINDOW = 160
CACHED_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")
#: fixed values: marks that open and close quotations
_OPEN, _CLOSE, _BOTH = "“«„‹‘", "”»‟›", "\""


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def allowed(length: int) -> int:
    """Edits in which a word may differ from a lexicon word of ``length`` letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


class Automaton:
    """The universal Levenshtein automaton for up to ``most`` edits.

    A state is the band of edit counts between a trie path and the word's
    prefixes of nearly the same length; what a letter does to it depends only
    on which letters of the word's window it equals.
    """

    def __init__(self, most: int):
        self.most = most
        self.dead = most + 1
        self.width = (1 << 2 * most + 1) - 1
        self.states = [tuple(d if d >= 0 else self.dead for d in range(-most, most + 1))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def move(self, state: int, equal: int) -> int:
        """The next state, or -1; ``equal`` has a bit for each place of the band where the letters agree."""
        key = state << 8 | equal
        if key not in self.moves:
            costs = self.states[state]
            out: list[int] = []
            for k, cost in enumerate(costs):
                best = cost + (not equal >> k & 1)
                if k + 1 < len(costs):
                    best = min(best, costs[k + 1] + 1)
                if out:
                    best = min(best, out[-1] + 1)
                out.append(min(best, self.dead))
            after = tuple(out)
            if min(after) > self.most:
                self.moves[key] = -1
            else:
                if after not in self.numbers:
                    self.numbers[after] = len(self.states)
                    self.states.append(after)
                self.moves[key] = self.numbers[after]
        return self.moves[key]


class Trie:
    """Lexicon words as nested letters, one tree for each number of edits that they allow."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.exact = {t: i for i, t in enumerate(terms)}
        self.bits: dict[str, int] = {}
        #: automaton, root, and by a word's length the letter sets of the terms it may be near
        self.trees: dict[int, tuple[Automaton, dict, dict[int, set[int]]]] = {}
        for number, term in enumerate(terms):
            most = allowed(len(term))
            if not most:
                continue
            _, node, letters = self.trees.setdefault(most, (Automaton(most), {}, {}))
            for length in range(len(term) - most, len(term) + most + 1):
                letters.setdefault(length, set()).add(self._letters(term))
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = number

    def near(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest lexicon word within what its length allows; the first of equals."""
        if word in self.exact:
            return self.exact[word], 0
        best = used = None
        for automaton, root, letters in self.trees.values():
            terms = letters.get(len(word))
            if not terms:
                continue
            if used is None:
                used = self._letters(word)
            # an edit takes away and brings in one letter at most
            most = 2 * automaton.most
            if any([(used ^ term).bit_count() <= most for term in terms]):
                for found in self._walk(word, automaton, root):
                    best = found if best is None else min(best, found)
        return None if best is None else (best[1], best[0])

    def _letters(self, word: str) -> int:
        """The set of a word's letters, as bits."""
        out = 0
        for letter in word:
            bit = self.bits.get(letter)
            if bit is None:
                bit = self.bits[letter] = 1 << min(len(self.bits), 63)
            out |= bit
        return out

    def _walk(self, word: str, automaton: Automaton, root: dict):
        """(edits, term) of all words of a tree within reach."""
        most, width, moves, n = automaton.most, automaton.width, automaton.moves, len(word)
        # where each letter stands, moved up by ``most`` so that a band never begins below bit 0
        places: dict[str, int] = {}
        for i, letter in enumerate(word, most):
            places[letter] = places.get(letter, 0) | 1 << i
        stack = [(root, 0, 0)]
        while stack:
            node, state, depth = stack.pop()
            for letter, below in node.items():
                if not letter:
                    reach = n - depth + most
                    costs = automaton.states[state]
                    if 0 <= reach < len(costs) and costs[reach] <= most:
                        yield costs[reach], below
                    continue
                equal = places.get(letter, 0) >> depth & width
                after = moves.get(state << 8 | equal)
                if after is None:
                    after = automaton.move(state, equal)
                if after >= 0:
                    stack.append((below, after, depth + 1))


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation is open at ``start`` and closed after ``end``, within the window and line."""
    before = text[max(0, start - WINDOW):start].rpartition("\n")[2]
    after = text[end:end + WINDOW].partition("\n")[0]
    opened = before.count(_BOTH) % 2 == 1 and _BOTH in after
    for left, right in zip(_OPEN, _CLOSE + "’", strict=True):
        at = before.rfind(left)
        opened = opened or (at >= 0 and right not in before[at:] and right in after)
    return opened


@dataclass
class Model:
    terms: list[str]
    #: weight of a hit by term and by edits
    weights: np.ndarray
    coefficients: np.ndarray
    trie: Trie | None = field(default=None, repr=False, compare=False)
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "coefficients": self.coefficients}

    def __setstate__(self, state):
        self.__init__(**state)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int, bool]]]:
        """(number of words, [(term, edits, quoted), ...])."""
        if not text:
            return 0, []
        if self.trie is None:
            self.trie = Trie(self.terms)
        words = words_of(text)
        found = {}
        for word in set(words):
            if word in self.known:
                near = self.known[word]
            else:
                near = self.trie.near(word)
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = near
            if near is not None:
                found[word] = near
        if not found:
            return len(words), []
        small = text.lower()
        out = []
        for m in _WORD.finditer(small):
            if m[0] in found:
                out.append((*found[m[0]], quoted(small, m.start(), m.end())))
        return len(words), out

    def features(self, n_words: int, hits: list[tuple[int, int, bool]]) -> np.ndarray:
        plain = sum(self.weights[t, d] for t, d, q in hits if not q)
        cited = sum(self.weights[t, d] for t, d, q in hits if q)
        dense = 100 * plain / max(n_words, 20)
        return np.array([1.0, math.log1p(plain), math.log1p(cited), math.log1p(dense)])

    def score(self, text: str | None) -> float:
        z = float(self.features(*self.hits(text)) @ self.coefficients)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _distinct_uses(sample: DataFrame) -> DataFrame:
    """(word, n_toxic, n_clean): with how many different words before it a word occurs.

    Copies of a text give a word the same neighbour again, so they count once.
    """

    def make():
        def apply(texts, labels):
            out = {"word": [], "before": [], "toxic": []}
            for text, label in zip(texts, labels, strict=True):
                words = words_of(text)
                uses = set(zip(words, ["", *words[:-1]], strict=True))
                out["word"] += [w for w, _ in uses]
                out["before"] += [b for _, b in uses]
                out["toxic"] += [label] * len(uses)
            return out

        return apply

    uses = map_columns(sample.select("text", "toxic"), make, "word string, before string, toxic int", text="text", rows=64)
    return uses.distinct().groupBy("word").agg(
        F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean")
    )


def _lexicon(counted: DataFrame, mistake: float) -> list[str]:
    """Words that toxic texts use so much more often that chance is ruled out.

    The bound is Chernoff's on a binomial tail, corrected for the number of
    words. What comes back is bounded by the sample: each word needs several
    toxic uses of its own.
    """
    total = counted.agg(F.sum("n_toxic"), F.sum("n_clean"), F.count(F.lit(1))).first()
    toxic, clean, words = (int(x or 0) for x in total)
    if not toxic or not clean:
        return []
    rate = toxic / (toxic + clean)
    n = F.col("n_toxic") + F.col("n_clean")
    share = F.col("n_toxic") / n
    gain = F.col("n_toxic") * F.log(share / rate)
    loss = F.when(F.col("n_clean") > 0, F.col("n_clean") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    sure = (share > rate) & (share > 0.5) & (gain + loss > math.log(words / mistake)) & (F.length("word") > 2)
    found = counted.where((F.col("n_toxic") > 1) & sure).select("word").orderBy("word").collect()
    return [r["word"] for r in found]


def _fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Newton's method with a normal prior around ``prior``."""
    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - strength * (b - prior)
        bend = (x.T * (p * (1 - p))) @ x + np.diag(strength)
        step = np.linalg.solve(bend, slope)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mistake: float = MISTAKE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    About ``sample`` texts of each label are read, chosen by the hash of
    doc_id; lexicon, weights and coefficients come from them alone, which bounds what reaches the driver.
    Null labels and texts teach nothing. Without labels of both kinds every
    text scores the same.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, sample / sizes.get(1, 1)).otherwise(sample / sizes.get(0, 1))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # about twice ``sample`` ids at most, so they go to the texts and not the texts to them
    taught = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    terms = _lexicon(_distinct_uses(taught), mistake)
    model = Model(terms, np.ones((max(1, len(terms)), 3)), np.zeros(4))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        find = shared.value.hits

        def apply(texts, labels):
            found = [find(t) for t in texts]
            return {
                "toxic": labels, "n_words": [n for n, _ in found],
                "hits": [[{"term": t, "edits": d, "quoted": q} for t, d, q in h] for _, h in found],
            }

        return apply

    schema = "toxic int, n_words long, hits array<struct<term: int, edits: int, quoted: boolean>>"
    rows = map_columns(taught, make, schema, text="text").collect()
    hits = [[(h["term"], h["edits"], h["quoted"]) for h in r["hits"]] for r in rows]
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        model.coefficients = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0, 0.0, 0.0])
        return model
    # a term counts by how much more often toxic texts hold it, at each distance
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for label, found in zip(y.astype(int).tolist(), hits, strict=True):
        held[label].update({(t, d) for t, d, _ in found})
    n1, n0 = y.sum(), len(y) - y.sum()
    for term in range(len(terms)):
        for edits in range(3):
            odds = (held[1][term, edits] + 0.5) / (n1 + 1) / ((held[0][term, edits] + 0.5) / (n0 + 1))
            model.weights[term, edits] = max(0.0, math.log(odds))
        # a misspelling never seen is taken for half of what the next nearer form says
        for edits in (1, 2):
            if not held[0][term, edits] and not held[1][term, edits]:
                model.weights[term, edits] = model.weights[term, edits - 1] / 2
    x = np.array([model.features(r["n_words"], h) for r, h in zip(rows, hits, strict=True)])
    # prior: plain hits speak for toxicity, quoted ones hardly
    model.coefficients = _fit_logistic(
        x, y, np.array([-2.0, 1.0, 0.1, 0.5]), np.array([0.01, 1.0, 5.0, 1.0])
    )
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_hits) for every row of ``docs``; null and empty texts score what no words score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value

        def apply(ids, texts):
            out = {"doc_id": ids, "score": [], "n_hits": []}
            for text in texts:
                n, hits = held.hits(text)
                z = float(held.features(n, hits) @ held.coefficients)
                out["score"].append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                out["n_hits"].append(len(hits))
            return out

        return apply

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, score double, n_hits long", text="text")
