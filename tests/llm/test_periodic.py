import random

import numpy as np

from ambry.llm import periodic
from ambry.llm.recompression import Grammar


def by_hand(words, least=24):
    """Runs found by comparing all words at every distance."""
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 3 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((a, size, p) for (a, size), p in found.items()), key=lambda r: (r[0], r[2]))


def drawn(draw, n, kinds):
    out = [draw.randrange(kinds) for _ in range(n)]
    for _ in range(draw.randint(0, 3)):
        if n > 30:
            a, p = draw.randrange(n), draw.randint(1, 40)
            for i in range(a + p, min(n, a + draw.randint(10, 200))):
                out[i] = out[i - p]
    return out


def test_runs_are_those_of_all_comparisons():
    draw = random.Random(8)
    for grids in (periodic.Grids(60), periodic.Grids(400)):
        for _ in range(60):
            texts = [drawn(draw, draw.choice([0, 1, 24, 30, 60, 150, 300]), draw.choice([1, 2, 3, 10])) for _ in range(5)]
            got = periodic.runs_of([np.array(t, np.int64) for t in texts], grids)
            for text, runs in zip(texts, got, strict=True):
                assert [tuple(r) for r in runs.tolist()] == by_hand(text)
                gone = {i for a, size, p in by_hand(text) for i in range(a + p, a + size)}
                assert np.flatnonzero(periodic.dropped(len(text), runs)).tolist() == sorted(gone)


def test_extensions_on_the_grammar():
    draw = random.Random(9)
    for _ in range(60):
        codes = [900, *drawn(draw, draw.choice([3, 40, 300]), draw.choice([1, 2, 5])), 901]
        n = len(codes)
        pairs = [(a, b) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(80)) if a != b]
        a, b = (np.array([p[k] for p in pairs]) for k in (0, 1))
        grammar = Grammar(np.array(codes))
        for x, y, ahead, back in zip(a, b, grammar.forward(a, b), grammar.backward(a, b), strict=True):
            k = 0
            while max(x, y) + k < n and codes[x + k] == codes[y + k]:
                k += 1
            m = 0
            while min(x, y) - m >= 0 and codes[x - m] == codes[y - m]:
                m += 1
            assert (ahead, back) == (k, m)


def test_a_grammar_of_repeats_is_small():
    codes = np.append(np.tile([1, 2, 3, 4, 5], 4000), 9)
    grammar = Grammar(np.append(8, codes))
    assert len(grammar.levels) < 60 and grammar.names < 400
    assert grammar.forward(np.array([1]), np.array([6])).tolist() == [19_995]


def test_a_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", 500)
    words = [f"w{k}" for k in range(700)] + ["a", "b", "c"] * 300 + [f"v{k}" for k in range(100)]
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    (runs,) = periodic.runs_of([np.array([code[w] for w in words])], periodic.Grids(64))
    assert runs.tolist() == [[700, 900, 3]]


def test_documents(frame, odd, none):
    rows = [
        (1, " ".join(["x"] * 30), "a"), (2, "p q r " * 9 + "s", "b"), (3, "one\ttwo\nthree\x0bfour\x0cfive\rsix", "c"), (4, None, "d"), (5, "", "e"),
        (6, "a\xa0b " * 24, "f"), (None, "y " * 23, "g"), (2, "p q r " * 9 + "s", "b"),
    ]
    got = {(r.doc_id, r.n_words): r for r in periodic.find(frame(rows, "doc_id long, text string, runs string")).collect()}
    assert [tuple(x) for x in got[1, 30].runs] == [(0, 30, 1)] and got[1, 30].collapsed == "x"
    assert [tuple(x) for x in got[2, 28].runs] == [(0, 27, 3)] and got[2, 28].collapsed == "p q r s"
    assert not got[3, 6].runs and got[3, 6].collapsed == "one two three four five six"
    assert got[4, 0].collapsed == "" and got[5, 0].collapsed == ""
    assert got[6, 24].collapsed == "a\xa0b" and got[None, 23].collapsed == "y " * 22 + "y"
    assert periodic.find(odd).count() == odd.count()
    assert periodic.find(none).count() == 0
