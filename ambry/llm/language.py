"""Language identification by Bloom filters whose slots hold a bit per language.

One filter serves all languages: every slot is a bit mask, an n-gram sets its
language's bit in a few slots, and the masks of those slots, combined by AND,
name all languages that contain an n-gram in one look-up. A text's languages
are counted bit by bit over its n-grams, each count is corrected for the share
that false positives alone would give, and the greatest decides.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.llm.batches import filter_rows, map_columns

UNDETERMINED = "und"
ORDERS = (3, 4)
#: documents of each language from which n-grams are learned, about
SAMPLE = 400
#: n-grams rarer than this in their language are not held; so at most 1 / RARE of each order are
RARE = 4e-5
SLOT_BITS = 20
PROBES = 2
#: lengths, in letters, at which cutoffs are taken; shorter texts have none
LENGTHS = (128, 256, 512)
#: documents of each language set aside for cutoffs, about
ASIDE = 1000
#: share of a language's texts that its bound may leave out, and the chance that it leaves out more
TAIL = 0.05
RISK = 0.05
#: fewer texts than this give no bound
ENOUGH = math.ceil(math.log(RISK) / math.log(1 - TAIL))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _letters(size: int) -> np.ndarray:
    """For each code point its small letter, or a space where it is no letter."""
    out = np.full(size, 32, np.uint32)
    for code in range(size):
        mark = chr(code)
        if mark.isalpha():
            low = mark.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def letters(text: str | None) -> np.ndarray:
    """Small letters of a text, runs of anything else as one space, spaces at both ends."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not codes.size:
        return codes
    table = _letters(0x10000 if codes.max() < 0x10000 else 0x110000)
    codes = np.concatenate(([np.uint32(32)], table[codes], [np.uint32(32)]))
    blank = codes == 32
    keep = np.ones(codes.size, bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = codes[keep]
    return codes if codes.size > 1 else codes[:0]


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of all n-grams of one order, in their places."""
    n = codes.size - order + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    total = np.full(n, order, np.uint64)
    for k in range(order):
        total = (total ^ wide[k:k + n]) * np.uint64(_ODD[k % len(_ODD)])
        total ^= total >> np.uint64(29)
    return total


def _slots(hashed: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOT_BITS)
    return [(hashed * np.uint64(_ODD[(k + 1) % 4]) >> shift).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filters:
    """``masks[w]`` holds languages 64w to 64w + 63 in as few bytes as they need."""

    languages: list[str]
    masks: list[np.ndarray]
    false_rate: np.ndarray
    usual: int
    #: of each language, how many documents there are and the share that n-grams were learned from
    learned: dict[str, tuple[int, float]] = field(default_factory=dict)

    def counts(self, codes: np.ndarray) -> tuple[int, np.ndarray]:
        """How many n-grams a text has, and how many each language contains."""
        total = 0
        hits = np.zeros(len(self.languages))
        for order in ORDERS:
            hashed = grams(codes, order)
            total += hashed.size
            slots = _slots(hashed)
            for word, masks in enumerate(self.masks):
                found = masks[slots[0]]
                for more in slots[1:]:
                    found = found & masks[more]
                here = range(64 * word, min(64 * word + 64, len(self.languages)))
                for lang in here:
                    hits[lang] += np.count_nonzero(found & found.dtype.type(1 << (lang - 64 * word)))
        return total, hits

    def known(self, codes: np.ndarray, without: int | None = None) -> float:
        """The share of n-grams that any language contains, beyond chance; ``without`` leaves one language out."""
        total = hits = 0
        for order in ORDERS:
            hashed = grams(codes, order)
            total += hashed.size
            slots = _slots(hashed)
            held = np.zeros(hashed.size, bool)
            for word, masks in enumerate(self.masks):
                found = masks[slots[0]]
                for more in slots[1:]:
                    found = found & masks[more]
                if without is not None and without // 64 == word:
                    found = found & ~found.dtype.type(1 << (without % 64))
                held |= found != 0
            hits += np.count_nonzero(held)
        rates = self.false_rate if without is None else np.delete(self.false_rate, without)
        false = 1 - float(np.prod(1 - rates))
        return max(0.0, (hits - total * false) / (1 - false)) / max(total, 1)

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, coverage) of a text.

        Score is how far the best language is ahead of the second, from 0 to
        1; coverage is the share of n-grams that the best one contains, beyond
        chance. A tie goes to the language that sorts first.
        """
        codes = letters(text)
        if not codes.size or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        total, hits = self.counts(codes)
        real = np.maximum(0.0, (hits - total * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(real))
        if real[best] <= 0:
            return self.languages[self.usual], 0.0, 0.0
        second = np.partition(real, -2)[-2] if len(real) > 1 else 0.0
        return self.languages[best], float(1 - second / real[best]), float(min(1.0, real[best] / max(total, 1)))


def _hash_below(key: Column, share: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share * 1_000_000


def learn(docs: DataFrame, sample: int = SAMPLE, rare: float = RARE, aside: bool = False) -> Filters:
    """Filters of the languages in ``docs`` (doc_id, text, lang).

    About ``sample`` documents of each language are read, chosen by the hash of
    doc_id. What is collected is bounded: languages, and for each at most
    1 / ``rare`` n-grams of an order. Rows without text or language teach nothing.
    With ``aside``, at least half of a language that has enough documents is
    left for ``cutoffs``.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], [], np.zeros(0), 0)
    most = {k: 0.5 if aside and sizes[k] >= 2 * ENOUGH else 1.0 for k in languages}
    learned = {k: (sizes[k], min(most[k], sample / sizes[k])) for k in languages}
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, learned[k][1])])
    chosen = known.where(_hash_below(F.coalesce("doc_id", F.lit(-1)), shares[F.col("lang")]))

    def make():
        def apply(langs, texts):
            out = {"lang": [], "size": [], "gram": [], "n": []}
            for lang, text in zip(langs, texts, strict=True):
                codes = letters(text)
                for order in ORDERS:
                    found, times = np.unique(grams(codes, order).view(np.int64), return_counts=True)
                    out["lang"] += [lang] * found.size
                    out["size"] += [order] * found.size
                    out["gram"] += found.tolist()
                    out["n"] += times.tolist()
            return out

        return apply

    seen = map_columns(chosen.select("lang", "text"), make, "lang string, size int, gram long, n long", text="text", rows=64)
    counted = seen.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    held = counted.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") >= F.col("total") * rare)

    width = next(w for w in (8, 16, 32, 64) if min(64, len(languages)) <= w)
    masks = [np.zeros(1 << SLOT_BITS, f"u{width // 8}") for _ in range(math.ceil(len(languages) / 64))]
    number = {k: i for i, k in enumerate(languages)}
    by_language: dict[str, list[int]] = {k: [] for k in languages}
    for row in held.select("lang", "gram").toLocalIterator():
        by_language[row["lang"]].append(row["gram"])
    fill = np.zeros(len(languages))
    for lang, found in by_language.items():
        word, bit = divmod(number[lang], 64)
        mask = masks[word]
        one = mask.dtype.type(1 << bit)
        for slots in _slots(np.array(found, np.int64).view(np.uint64)):
            mask[slots] |= one
        fill[number[lang]] = np.count_nonzero(mask & one) / mask.size
    usual = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    return Filters(languages, masks, fill**PROBES, usual, learned)


def bound_rank(n: int, tail: float = TAIL, risk: float = RISK) -> int:
    """The greatest r for which the r-th least of ``n`` draws lies above the quantile ``tail`` at a chance of at most ``risk``; 0 if none."""
    below = 0.0
    for r in range(n):
        below += math.exp(
            math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1) + r * math.log(tail) + (n - r) * math.log1p(-tail)
        )
        if below > risk:
            return r
    return 0


def cutoffs(docs: DataFrame, filters: Filters, aside: int = ASIDE) -> dict[str, dict[int, float]]:
    """For each language and length, the least share of known n-grams that a text must have.

    About ``aside`` documents of each language from which nothing was learned
    are cut to each length. How much of them the filters know is bounded from
    below; how much is known of them when their own language is left out, which
    makes them texts of a language never learned, is bounded from above. Both
    are exact bounds of a quantile by ranks. The cutoff is midway, and there is
    none where the bounds cross or too few documents are long enough.
    """
    number = {k: n for n, k in enumerate(filters.languages)}
    free = {k: (share, share + min(1 - share, aside / size)) for k, (size, share) in filters.learned.items() if share < 1}
    if not free:
        return {}
    at = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_000))
    low, high = (F.create_map(*[F.lit(x) for k, v in free.items() for x in (k, v[end] * 1_000_000)]) for end in (0, 1))
    held = docs.where(F.col("text").isNotNull() & F.col("lang").isin(*free)).where(
        (at >= low[F.col("lang")]) & (at < high[F.col("lang")])
    )
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        model = shared.value

        def apply(langs, texts):
            out = {"lang": [], "size": [], "own": [], "other": []}
            for lang, text in zip(langs, texts, strict=True):
                codes = letters(text)
                for size in LENGTHS:
                    if codes.size >= size:
                        begun = zlib.crc32(codes.tobytes()) % (codes.size - size + 1)
                        cut = codes[begun:begun + size]
                        out["lang"].append(lang)
                        out["size"].append(size)
                        out["own"].append(model.known(cut))
                        out["other"].append(model.known(cut, number[lang]))
            return out

        return apply

    seen = map_columns(held.select("lang", "text"), make, "lang string, size int, own double, other double", text="text")
    own, other = defaultdict(list), defaultdict(list)
    for row in seen.collect():
        own[row["lang"], row["size"]].append(row["own"])
        other[row["lang"], row["size"]].append(row["other"])
    out: dict[str, dict[int, float]] = {}
    for lang, size in own:
        rank = bound_rank(len(own[lang, size]))
        if rank:
            least, most = sorted(own[lang, size])[rank - 1], sorted(other[lang, size])[-rank]
            if least > most:
                out.setdefault(lang, {})[size] = (least + most) / 2
    return out


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Adds lang_pred, score and coverage to ``docs``, which needs doc_id and text.

    A null text, and one without a letter, is ``und`` with score and coverage 0.
    Where letters are there but no n-gram is known, the language most often
    learned is named, with score 0. Other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        model = shared.value

        def apply(ids, texts):
            found = [model.identify(t) for t in texts]
            return {
                "doc_id": ids, "lang_pred": [x[0] for x in found],
                "score": [x[1] for x in found], "coverage": [x[2] for x in found],
            }

        return apply

    return map_columns(
        docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, coverage double", text="text"
    )


def in_known_language(
    docs: DataFrame, filters: Filters, coverage: float = 0.1, least: dict[str, dict[int, float]] | None = None
) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that the filters know; all columns stay.

    Rejected are texts without a letter, those of which no language contains
    the share ``coverage`` of n-grams beyond chance, and those of which all
    languages together contain less than ``least`` says for the likeliest
    language and the text's length (``cutoffs``). Together, so that a text in
    two known languages stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters, least or {}))

    def make():
        model, cuts = shared.value

        def known(text):
            lang, _, covered = model.identify(text)
            if lang == UNDETERMINED or covered < coverage:
                return False
            codes = letters(text)
            sizes = [size for size in cuts.get(lang, ()) if size <= codes.size]
            return not sizes or model.known(codes) >= cuts[lang][max(sizes)]

        return lambda texts: [known(t) for t in texts]

    return filter_rows(docs, make)
