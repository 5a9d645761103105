"""Personal data in texts: fixed patterns, and a semi-Markov random field for what they miss.

The patterns find the plainly written addresses and numbers. A field trained
on those, and on the same ones written in other usual ways (without a plus
sign, spelled out, spaced), scores whole candidate spans in the windows around
digits and signs, and adds the spans that it cuts out where no pattern matched.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.llm import semicrf
from ambry.llm.batches import map_columns
from ambry.llm.spans import Covered, Span, matches

KINDS = ["email", "ip", "card", "phone"]
#: tokens in the longest entity
LONGEST = 24
#: characters around a trigger that a window holds
MARGIN = 40
#: characters of a piece of a window, and of what two pieces share
PIECE = 480
OVERLAP = 96
#: texts with fixed matches, and texts with other digits, that are learned from, about
SAMPLE = 300
#: windows of each sort that are learned from, at most, out of the sample
WINDOWS = 100
SEED = 7

# possessive, so that a long run is read once; what precedes a run cannot belong to it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_FOURS = re.compile(r"[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3}")
_TRIGGER = re.compile(r"@|[0-9](?:[\x20()\[\]./-]{0,3}[0-9]){4}|" + _FOURS.pattern)
_SPELLED = re.compile(r"[(\[]at[)\]]|\x20at\x20[A-Za-z0-9-]+\x20dot\x20", re.IGNORECASE)


def passes_luhn(number: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _n_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def emails(text: str) -> Iterator[Span]:
    """Leftmost addresses: for each @ the longest local part since the last match, then the domain."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _is_ip(m: re.Match) -> bool:
    parts = (p.lstrip("0") for p in m[0].split("."))
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _is_card(m: re.Match) -> bool:
    if m.end() - m.start() > 40:
        return False
    digits = re.sub("[^0-9]", "", m[0])
    return 14 <= len(digits) <= 19 and passes_luhn(digits)


def base_spans(text: str | None) -> list[Span]:
    """Personal data of the four fixed patterns."""
    if not text:
        return []
    out = list(emails(text))
    out += matches(_IP, text, "ip", _is_ip)
    out += matches(_CARD, text, "card", _is_card)
    if "+" in text:
        out += matches(_PHONE, text, "phone", lambda m: 10 <= _n_digits(m[0]) <= 15)
    return out


def triggers(text: str) -> list[tuple[int, int]]:
    """Where personal data may be: signs of addresses, five digits close together, and four groups between dots."""
    out = [m.span() for m in _TRIGGER.finditer(text)]
    low = text.lower()
    if "at)" in low or "at]" in low or " dot " in low:
        out = sorted(out + [m.span() for m in _SPELLED.finditer(text)])
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers; long ones in pieces that overlap by more than an entity."""
    begun = ended = -1
    for start, end in [*triggers(text), (len(text) + 2 * MARGIN, 0)]:
        low, high = max(0, start - MARGIN), min(len(text), end + MARGIN)
        if begun >= 0 and low <= ended:
            ended = high
            continue
        while begun >= 0 and ended - begun > PIECE:
            yield begun, begun + PIECE
            begun += PIECE - OVERLAP
        if begun >= 0:
            yield begun, ended
        begun, ended = low, high


@dataclass
class Window:
    """Tokens of a stretch of text: (start, end) each, in code points of the whole text."""

    text: str
    tokens: list[tuple[int, int]]

    @classmethod
    def of(cls, text: str, low: int, high: int) -> Window:
        return cls(text, [(low + m.start(), low + m.end()) for m in _TOKEN.finditer(text[low:high])])

    def segments(self) -> list[semicrf.Candidate]:
        """All candidate segments: each token outside, and spans that could be an entity."""
        out: list[semicrf.Candidate] = []
        tokens, text = self.tokens, self.text
        for i, (start, end) in enumerate(tokens):
            out.append((i, i + 1, semicrf.OUTSIDE, (_sort(text[start:end]),)))
            first = text[start:end]
            if first.isspace() or not (first[0].isalnum() or first[0] in "+(["):
                continue
            for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
                last = text[tokens[j - 1][0]:tokens[j - 1][1]]
                if j > i + 1 and ("\n" in last or (len(last) > 2 and last.isspace())):
                    break
                if not (last[-1].isalnum()):
                    continue
                span = text[start:tokens[j - 1][1]]
                if len(span) > 80:
                    break
                kinds = ("ip", "card", "phone") if _n_digits(span) >= 7 else ("ip",) if _FOURS.fullmatch(span) else ()
                if kinds:
                    shared = _number_features(span, text, start, tokens[j - 1][1])
                    out += [(i, j, kind, shared) for kind in kinds]
                if "@" in span or _SPELLED.search(span) or " at " in span.lower():
                    out.append((i, j, "email", _address_features(span, text, start, tokens[j - 1][1])))
        return out


_ADDRESS = re.compile(
    r"[\w.%+-]+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[\w-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[\w-]+)+\Z", re.IGNORECASE
)


def _sort(token: str) -> str:
    """What sort of token stands outside."""
    if token.isspace():
        return "space"
    if token.isdigit():
        return f"digits{min(len(token), 8)}"
    return "word" if token.isalpha() else f"sign{token}"


def _edge(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    mark = text[at]
    return "space" if mark.isspace() else "letter" if mark.isalpha() else "digit" if mark.isdigit() else mark


def _number_features(span: str, text: str, start: int, end: int) -> tuple[str, ...]:
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    signs = "".join(sorted(set(re.sub("[0-9]", "", span))))
    fours = span.count(".") == 3 and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return (
        "bias", f"digits{min(len(digits), 20)}", f"luhn{passes_luhn(digits)}{14 <= len(digits) <= 19}",
        f"groups{min(len(groups), 7)}", f"signs{signs if len(signs) < 5 else 'many'}", f"plus{span[0] == '+'}",
        f"bracket{'(' in span}{span.count('(') == span.count(')')}", f"fours{fours}",
        f"shape{'-'.join(str(len(g)) for g in groups) if len(groups) < 6 else 'long'}",
        f"letters{any(c.isalpha() for c in span)}", f"before{_edge(text, start - 1)}", f"after{_edge(text, end)}",
    )


def _address_features(span: str, text: str, start: int, end: int) -> tuple[str, ...]:
    whole = bool(_ADDRESS.match(span))
    ending = re.split(r"[.\x20\])]", span)[-1].lower()
    return (
        "bias", f"whole{whole}", f"sign{'@' in span}", f"ending{ending if 2 <= len(ending) <= 4 else 'other'}",
        f"spaces{min(span.count(' '), 5)}", f"before{_edge(text, start - 1)}", f"after{_edge(text, end)}",
    )


def rewritten(span: str, kind: str, draw: random.Random) -> str:
    """Another usual way to write the same thing."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = draw.choice([(" at ", " dot "), (" (at) ", "."), ("[at]", "."), ("(at)", "(dot)"), (" [at] ", " [dot] ")])
        return local.replace(".", draw.choice([".", "_"])) + at + domain.replace(".", dot)
    if kind == "phone":
        groups = re.findall("[0-9]+", span)
        form = draw.randrange(4)
        if form == 0 and len(groups) >= 4:
            return f"({groups[1]}) {'-'.join(groups[2:])}"
        if form == 1 and len(groups) >= 4:
            return "-".join(groups[1:])
        if form == 2 and len(groups) >= 4:
            return ".".join(groups[1:])
        return "00" + " ".join(groups)
    if kind == "card":
        digits = re.sub("[^0-9]", "", span)
        mark = draw.choice([".", "  ", "/"])
        return mark.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    return span.replace(".", draw.choice([" . ", "[.]", "(.)"]))


def ordinary_number(draw: random.Random) -> str:
    """Numbers that are nobody's: dates, amounts, versions, codes."""
    n = draw.randrange
    return draw.choice([
        f"{n(1950, 2030)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1950, 2030)}",
        f"{n(1, 999)},{n(1000):03},{n(1000):03}.{n(100):02}", f"{n(10)}.{n(20)}.{n(20)}", f"{n(10**7, 10**9)}",
        f"{n(10**13, 10**16)}1", f"{n(1950, 2030)}-{n(1, 13):02}-{n(1, 29):02} {n(24):02}:{n(60):02}:{n(60):02}",
        f"{n(256, 999)}.{n(256, 999)}.{n(256, 999)}.{n(256, 999)}", f"{n(1950, 2030)}-{n(1950, 2030)} {n(1950, 2030)}",
        f"978-{n(10)}-{n(100, 999)}-{n(10000, 99999)}-{n(10)}",
    ])


@dataclass
class Field:
    """A trained field: the numbers of its features and their weights."""

    numbers: dict[str, int]
    weights: np.ndarray

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(fixed matches, added): added ones overlap none of the fixed."""
        base = base_spans(text)
        if not text or not self.numbers:
            return base, []
        taken = Covered(base)
        added: list[Span] = []
        open_triggers = Covered((a, b, "") for a, b in triggers(text) if not taken.touches(a, b))
        last = 0
        for low, high in windows(text):
            if open_triggers.touches(low, high):
                for span in self.decode(text, low, high):
                    # pieces overlap: what an earlier one has found stays
                    if span[0] >= last and not taken.touches(span[0], span[1]):
                        added.append(span)
                        last = span[1]
        return base, added

    def decode(self, text: str, low: int, high: int) -> list[Span]:
        window = Window.of(text, low, high)
        segments = window.segments()
        if all(s[2] == semicrf.OUTSIDE for s in segments):
            return []
        x = semicrf.lattice(len(window.tokens), segments, self.numbers.get)
        return [
            (window.tokens[x.starts[k]][0], window.tokens[x.ends[k] - 1][1], x.kinds[k])
            for k in semicrf.best(x, self.weights) if x.kinds[k] != semicrf.OUTSIDE
        ]


def _right(window: Window, segments: list[semicrf.Candidate], entities: list[Span], x: semicrf.Lattice) -> list[int] | None:
    """The candidates of the right segmentation, or None where an entity is no candidate."""
    by_place = {(int(s), int(e), k): n for n, (s, e, k) in enumerate(zip(x.starts, x.ends, x.kinds, strict=True))}
    starts = {t[0]: i for i, t in enumerate(window.tokens)}
    ends = {t[1]: i + 1 for i, t in enumerate(window.tokens)}
    out, at = [], 0
    for start, end, kind in sorted(entities):
        i, j = starts.get(start), ends.get(end)
        if i is None or j is None or i < at or (i, j, kind) not in by_place:
            return None
        out += [by_place[k, k + 1, semicrf.OUTSIDE] for k in range(at, i)] + [by_place[i, j, kind]]
        at = j
    return out + [by_place[k, k + 1, semicrf.OUTSIDE] for k in range(at, len(window.tokens))]


def examples(texts: list[str], limit: int = WINDOWS) -> list[tuple[str, list[Span]]]:
    """Short texts with their entities: as found, rewritten, and with ordinary numbers in their place."""
    draw = random.Random(SEED)
    found: list[tuple[str, list[Span]]] = []
    other: list[tuple[str, list[Span]]] = []
    for text in texts:
        base = base_spans(text)
        taken = Covered(base)
        for start, end, kind in base:
            low, high = max(0, start - MARGIN), min(len(text), end + MARGIN)
            inside = [s for s in base if s[0] < high and low < s[1]]
            if len(inside) > 1:
                continue
            before, after = text[low:start], text[end:high]
            for span, label in (
                (text[start:end], kind), (rewritten(text[start:end], kind, draw), kind), (ordinary_number(draw), None),
            ):
                at = len(before)
                found.append((before + span + after, [(at, at + len(span), label)] if label else []))
        other += [
            (text[low:high], []) for low, high in windows(text) if not taken.touches(low, high)
        ]
    draw.shuffle(found)
    draw.shuffle(other)
    return found[:3 * limit] + other[:limit]


def train(texts: list[str], limit: int = WINDOWS) -> Field:
    """A field from sample texts; one that adds nothing where they hold no fixed match."""
    rows = []
    numbers: dict[str, int] = {}
    for text, entities in examples(texts, limit):
        window = Window.of(text, 0, len(text))
        segments = window.segments()
        x = semicrf.lattice(len(window.tokens), segments, lambda name: numbers.setdefault(name, len(numbers)))
        right = _right(window, segments, entities, x)
        if right is not None:
            rows.append((x, right))
    if not any(any(x.kinds[k] != semicrf.OUTSIDE for k in right) for x, right in rows):
        return Field({}, np.zeros(0))
    return Field(numbers, semicrf.fit(rows, len(numbers)))


def learn(docs: DataFrame, sample: int = SAMPLE, limit: int = WINDOWS) -> Field:
    """Trains on about ``sample`` texts that hold an @ or five digits, chosen by the hash of the text.

    The sample's bound is what keeps the driver's share bounded: ``limit``
    windows of each sort are learned from.
    """
    likely = docs.select("text").where(F.col("text").rlike(r"@|[0-9]{4}"))
    size = likely.count()
    share = min(1.0, sample / max(1, size))
    chosen = likely.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def make():
        def apply(texts):
            # only what surrounds a trigger is learned from
            cuts = []
            for text in texts:
                for low, high in windows(text):
                    cuts.append(text[max(0, low - MARGIN):high + MARGIN])
            return {"text": cuts}

        return apply

    cuts = map_columns(chosen, make, "text string", text="text").distinct()
    held = cuts.orderBy(F.xxhash64("text"), "text").limit(4 * limit).collect()
    return train([r["text"] for r in held], limit)


def find(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, base, added): spans as arrays of (start, end, kind) in code points.

    A null or empty text has none; repeated rows repeat their answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

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
