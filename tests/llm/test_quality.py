import math
import random

import pytest
from pyspark.sql import functions as F

from ambry.llm import quality


def by_hand(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, odd):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "b", "c\n", "d#", "e|\n\n", "\té"]) for _ in range(draw.randrange(0, 60))) for _ in range(150)]
    texts += ["a b c d e f g h " * 9, "x\nx\nx\n \n\n", "one\x0btwo\x0cthree\rfour", *[r.text for r in odd.collect()]]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.measured(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_tail(spark):
    cases = [(0, 50, 0.1), (3, 200, 0.05), (40, 1000, 0.05), (900, 100_000, 0.01), (0, 10, 0.5), (4, 10, 0.5)]
    for x, n, p in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(x + 1))
        got = spark.range(1).select(quality.log_binomial_tail(F.lit(float(x)), F.lit(float(n)), p)).first()[0]
        assert got == pytest.approx(math.log(exact), abs=1e-6)


def test_cutoffs_keep_their_promise(spark):
    """Good texts seldom have symbols, bad ones do; a stratum with few labels gets no cutoff."""
    draw = random.Random(9)
    rows, labels = [], []
    for k in range(9000):
        stratum = "big" if k < 8800 else "few"
        good = draw.random() < 0.8
        symbols = 0.8 if not good and draw.random() < 0.9 else 0.1 * draw.random() + (0.7 if draw.random() < 0.0005 else 0)
        rows.append((k, stratum, symbols, 0.0, 0.0, 0.3))
        labels.append((k, int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, stratum string, symbols double, dup_lines double, repeats double, long_words double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    chosen = quality.cutoffs(frame, marks)
    found = {(r.stratum, r.signal): r.cutoff for r in chosen.collect()}
    assert {s for s, _ in found} == {"big"}
    assert 0.1 < found["big", "symbols"] <= 0.75
    judged = quality.judge(frame, chosen).collect()
    good = dict(labels)
    wrong = sum(bool(r.rejected_by) for r in judged if good[r.doc_id])
    assert wrong <= 0.01 * sum(good.values())
    assert sum(bool(r.rejected_by) for r in judged if not good[r.doc_id]) > 1000


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (None, 1), (5, None), (6, 0), (6, 1)], "doc_id long, quality int")
    got = quality.rated(odd, labels).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.kept for r in got}[5] is True
    assert not any(r.kept for r in got if r.doc_id in (1, 2, 9))
    assert quality.rated(none, labels).count() == 0
    assert quality.rated(odd, labels.limit(0)).count() == odd.count()
