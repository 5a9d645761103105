import random
import re
from fractions import Fraction

import pytest

from ambry.llm.components import components
from ambry.llm.minhash import Shingler, banding, near_duplicates, without_near_duplicates

TIGHT = Fraction(85, 100)


def by_hand(rows, words, similarity):
    sets = {}
    for doc_id, text in rows:
        w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets[doc_id] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and similarity.denominator * common >= similarity.numerator * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def compare(spark, rows, words, similarity):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, words, similarity).collect()}
    want = by_hand(rows, words, similarity)
    assert got == want
    return want


def edited(draw, words, times):
    out = list(words)
    for _ in range(times):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("words", "similarity"), [(3, TIGHT), (5, Fraction(4, 5))])
def test_groups_of_near_copies(spark, words, similarity):
    """Copies at all distances around the threshold, in one large group and many small ones."""
    draw = random.Random(words)
    rows = []
    big = [f"w{draw.randrange(500)}" for _ in range(120)]
    for _ in range(150):
        rows.append(edited(draw, big, draw.randrange(0, 8)))
    for _ in range(60):
        base = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(1, 150))]
        rows += [edited(draw, base, draw.randrange(0, 6)) for _ in range(3)]
    rows += [rows[0]] * 30 + ["", None, "one", "one", "One two", "a b c", "A\tB\nC"]
    draw.shuffle(rows)
    want = compare(spark, list(enumerate(rows)), words, similarity)
    sizes = sorted((list(r for _, r in want.values()).count(k) for k in {r for _, r in want.values()}), reverse=True)
    assert sizes[0] > 40 and len(sizes) > 50


def test_chains_are_followed(spark):
    """Each text is like its neighbours only, so the group's ends are far apart."""
    words = [f"w{k}" for k in range(100)]
    rows = [(100 - k, " ".join(words[:100 - 3 * k] + [f"x{j}" for j in range(3 * k)])) for k in range(30)]
    want = compare(spark, rows, 3, TIGHT)
    assert len({r for _, r in want.values()}) == 1


def test_copies_that_share_much_but_not_enough_stay_apart(spark):
    draw = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, edited(draw, base, 14)) for k in range(80)]
    want = compare(spark, rows, 3, TIGHT)
    assert len({r for _, r in want.values()}) > 70


def test_banding_misses_as_seldom_as_it_says():
    for similarity in (0.5, 0.7, 0.8, 0.85, 0.95, 1.0):
        bands, rows = banding(similarity)
        assert bands * rows <= 360
        assert (1 - similarity**rows) ** bands <= 1e-6
    assert Shingler(3)("a b c d").size == 2 and Shingler(3)("A B").size == 1 and not Shingler(3)(None).size


def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(3000, 3200)] + [(None, 1), (2, None), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect()}
    assert (7, 3, 6, False) in got and (6, 3, 6, True) in got and (1, 0, 1, True) in got and (9, 0, 9, True) in got
    assert any(d is None and c is None and k for d, _, c, k in got)
    assert near_duplicates(none).count() == 0 and without_near_duplicates(none).count() == 0
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(str(x) for x in [1, 2, 3, None, 5, 6, 8, 9, 10])
