"""Portuguese suffix stripping on folded words, after the published Snowball algorithm.

The words reach the stemmer without accents, so of the published suffixes only
the plain spellings can ever match; those are the ones listed. Each step is a
few generated regular expressions over a column of *distinct* words.
``stem_word`` does the same to one word, for tasks that hold a passage's words already.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffixes of the published algorithm in plain spelling.
STANDARD = (
    "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos "
    "imento imentos adora ador adoras adores ante antes"
).split()
LOGIC = ["logia", "logias"]
ADVERB_A, ADVERB = "amente", "mente"
STATE = ["idade", "idades"]
ACTIVE = ["iva", "ivo", "ivas", "ivos"]
AGENT = ["ira", "iras"]
VERB = (
    "ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei "
    "am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando "
    "endo indo ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes irdes "
    "ares eres ires asses esses isses astes estes istes is ais eis areis ereis ireis ados idos amos "
    "emos aremos eremos iremos imos armos ermos irmos eu iu ou"
).split()


def _ending(word: Column, suffixes: list[str]) -> Column:
    """The longest of the suffixes a word ends in, '' if none."""
    return F.regexp_extract(word, f"(?:{'|'.join(sorted(suffixes, key=len, reverse=True))})$", 0)


def _drop(word: Column, ending: Column) -> Column:
    return F.left(word, F.length(word) - F.length(ending))


def _inside(word: Column, ending: Column, region: Column) -> Column:
    """Does a non-empty ending lie wholly in the region that starts at an offset?"""
    return (ending != "") & (F.length(word) - F.length(ending) >= region)


def stem(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Adds the stem of each folded word."""
    w = F.col(word)
    n = F.length(w)

    def offset(pattern: str, text: Column) -> Column:
        hit = F.length(F.regexp_extract(text, pattern, 0))
        return F.when(hit > 0, hit)

    second = F.substring(w, 2, 1)
    opening = (
        F.when(~second.rlike("[aeiou]"), offset("^..[^aeiou]*[aeiou]", w))
        .when(F.left(w, F.lit(1)).rlike("[aeiou]"), offset("^..[aeiou]*[^aeiou]", w))
        .otherwise(F.when(n >= 3, F.lit(3)))
    )
    region = "^[^aeiou]*[aeiou]+[^aeiou]"
    df = words.withColumn("_r1", F.coalesce(offset(region, w), n)).withColumn("_rv", F.coalesce(opening, n))
    inner = F.substring(w, F.col("_r1") + 1, n)
    df = df.withColumn("_r2", F.coalesce(F.col("_r1") + offset(region, inner), n))
    r1, r2, rv = F.col("_r1"), F.col("_r2"), F.col("_rv")

    # step 1: the longest standard ending decides, whether or not its region allows it
    every = [*STANDARD, *LOGIC, ADVERB_A, ADVERB, *STATE, *ACTIVE, *AGENT]
    df = df.withColumn("_e", _ending(w, every))
    e = F.col("_e")
    cut = _drop(w, e)

    def also(base: Column, suffixes: list[str], after: dict[str, list[str]] | None = None) -> Column:
        """Drops one more ending in R2, and behind it another one."""
        more = _ending(base, suffixes)
        out_col = F.when(_inside(base, more, r2), _drop(base, more)).otherwise(base)
        for first, then in (after or {}).items():
            shorter = _drop(base, F.lit(first))
            again = _ending(shorter, then)
            out_col = F.when(
                (more == first) & _inside(base, more, r2) & _inside(shorter, again, r2), _drop(shorter, again)
            ).otherwise(out_col)
        return out_col

    in_r2 = _inside(w, e, r2)
    step1 = (
        F.when(e.isin(STANDARD) & in_r2, cut)
        .when(e.isin(LOGIC) & in_r2, F.concat(cut, F.lit("log")))
        .when((e == ADVERB_A) & _inside(w, e, r1), also(cut, ["iv", "os", "ic", "ad"], {"iv": ["at"]}))
        .when((e == ADVERB) & in_r2, also(cut, ["ante"]))
        .when(e.isin(STATE) & in_r2, also(cut, ["abil", "ic", "iv"]))
        .when(e.isin(ACTIVE) & in_r2, also(cut, ["at"]))
        .when(e.isin(AGENT) & _inside(w, e, rv) & cut.endswith("e"), F.concat(cut, F.lit("ir")))
    )
    df = df.withColumn("_s1", step1)
    # step 2: verb endings, the longest that lies in RV
    tail = F.substring(w, rv + 1, n)
    verb = _ending(tail, VERB)
    df = df.withColumn("_s2", F.when(F.col("_s1").isNull() & (verb != ""), _drop(w, verb)))
    changed = F.coalesce("_s1", "_s2")
    # step 3 after a removal, step 4 without one
    trimmed = F.when(
        changed.isNotNull(),
        F.when(changed.endswith("ci") & (F.length(changed) - 1 >= rv), _drop(changed, F.lit("i"))).otherwise(changed),
    )
    rest = _ending(w, ["os", "a", "i", "o"])
    plain = F.when(_inside(w, rest, rv), _drop(w, rest)).otherwise(w)
    df = df.withColumn("_s4", F.coalesce(trimmed, plain))
    # step 5: a final e, with the u of gu or the i of ci before it
    s = F.col("_s4")
    size = F.length(s)
    bare = _drop(s, F.lit("e"))
    soft = (bare.endswith("gu") | bare.endswith("ci")) & (size - 2 >= rv)
    last = F.when(
        s.endswith("e") & (size - 1 >= rv), F.when(soft, F.left(s, size - 2)).otherwise(bare)
    ).otherwise(s)
    return df.withColumn(out, last).drop("_r1", "_r2", "_rv", "_e", "_s1", "_s2", "_s4")


def _suffixes(*groups: list[str]) -> dict[int, frozenset[str]]:
    """Suffixes by length, the longest first."""
    every = [x for group in groups for x in group]
    return {n: frozenset(x for x in every if len(x) == n) for n in sorted({len(x) for x in every}, reverse=True)}


_STEP1 = _suffixes(STANDARD, LOGIC, [ADVERB_A, ADVERB], STATE, ACTIVE, AGENT)
_STEP2, _STEP4 = _suffixes(VERB), _suffixes(["os", "a", "i", "o"])
_AFTER_A, _AFTER_IV, _AFTER_MENTE = _suffixes(["iv", "os", "ic", "ad"]), _suffixes(["at"]), _suffixes(["ante"])
_AFTER_STATE, _AFTER_ACTIVE = _suffixes(["abil", "ic", "iv"]), _suffixes(["at"])
_REGION = re.compile("[^aeiou]*[aeiou]+[^aeiou]")
_TO_VOWEL, _TO_CONSONANT = re.compile("..[^aeiou]*[aeiou]"), re.compile("..[aeiou]*[^aeiou]")
_STANDARD, _LOGIC, _STATE, _ACTIVE, _AGENT = map(frozenset, (STANDARD, LOGIC, STATE, ACTIVE, AGENT))


def _longest(word: str, suffixes: dict[int, frozenset[str]]) -> str:
    for n, held in suffixes.items():
        if word[-n:] in held:
            return word[-n:]
    return ""


def _less(base: str, suffixes: dict[int, frozenset[str]], region: int) -> str:
    """Without one more ending, if that lies in the region."""
    more = _longest(base, suffixes)
    return base[: len(base) - len(more)] if len(base) - len(more) >= region else base


def stem_word(w: str) -> str:
    """The stem of one folded word; the same steps as ``stem``."""
    n = len(w)

    def offset(pattern: re.Pattern, text: str) -> int | None:
        hit = pattern.match(text)
        return hit.end() if hit else None

    if w[1:2] not in {"a", "e", "i", "o", "u"}:
        opening = offset(_TO_VOWEL, w)
    elif w[0] in "aeiou":
        opening = offset(_TO_CONSONANT, w)
    else:
        opening = 3 if n >= 3 else None
    rv = n if opening is None else opening
    first = offset(_REGION, w)
    r1 = n if first is None else first
    second = offset(_REGION, w[r1:])
    r2 = n if second is None else r1 + second

    e = _longest(w, _STEP1)
    cut, at = w[: n - len(e)], n - len(e)
    s: str | None = None
    if not e:
        pass
    elif e in _STANDARD and at >= r2:
        s = cut
    elif e in _LOGIC and at >= r2:
        s = cut + "log"
    elif e == ADVERB_A and at >= r1:
        s = _less(cut, _AFTER_A, r2)
        if _longest(cut, _AFTER_A) == "iv" and s != cut:
            s = _less(s, _AFTER_IV, r2)
    elif e == ADVERB and at >= r2:
        s = _less(cut, _AFTER_MENTE, r2)
    elif e in _STATE and at >= r2:
        s = _less(cut, _AFTER_STATE, r2)
    elif e in _ACTIVE and at >= r2:
        s = _less(cut, _AFTER_ACTIVE, r2)
    elif e in _AGENT and at >= rv and cut.endswith("e"):
        s = cut + "ir"
    if s is None:
        verb = _longest(w[rv:], _STEP2)
        if verb:
            s = w[: n - len(verb)]
    if s is None:
        rest = _longest(w, _STEP4)
        s = w[: n - len(rest)] if n - len(rest) >= rv else w
    elif s.endswith("ci") and len(s) - 1 >= rv:
        s = s[:-1]
    size = len(s)
    if s.endswith("e") and size - 1 >= rv:
        soft = s[:-1].endswith(("gu", "ci")) and size - 2 >= rv
        s = s[:-2] if soft else s[:-1]
    return s
