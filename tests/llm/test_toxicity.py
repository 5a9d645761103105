import random

import pytest

from ambry.llm import toxicity
from ambry.llm.toxicity import Model, Trie, allowed, quoted


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lookup_is_that_of_comparing_all():
    draw = random.Random(6)
    terms = sorted({"".join(draw.choice("abcde") for _ in range(draw.randrange(3, 12))) for _ in range(60)})
    trie = Trie(terms)
    near = 0
    for _ in range(3000):
        word = list(draw.choice(terms)) if draw.random() < 0.8 else [draw.choice("abcde") for _ in range(draw.randrange(1, 13))]
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at:at + draw.randrange(2)] = draw.choice(["", "a", "x"])
        word = "".join(word)
        close = [(distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= allowed(len(t))]
        want = (min(close)[1], min(close)[0]) if close else None
        assert trie.near(word) == want, word
        near += want is not None
    assert near > 1000


def test_quotations():
    text = 'he said "you fool" and left\n"open fool'
    assert quoted(text, 13, 17) and not quoted(text, 33, 37)
    assert quoted("«un fool» là", 4, 8) and not quoted("«un» fool «là»", 5, 9)


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(3)
    plain = ["".join(draw.choice("lmnoprstuv") for _ in range(draw.randrange(3, 9))) for _ in range(300)]
    bad = ["grobian", "dummkopf", "wicht"]
    rows, labels = [], []
    for k in range(900):
        words = [draw.choice(plain) for _ in range(40)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(40), draw.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_terms_and_their_misspellings(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs.where("doc_id % 4 <> 0"), labels)
    assert set(model.terms) == {"grobian", "dummkopf", "wicht"}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs.where("doc_id % 4 = 0"), model).collect()
    assert sum((r.score >= 0.7) == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert model.score("you dumkopf and grobiann and w1cht") >= 0.7
    said = 'they called it "dummkopf" and "grobian"'
    assert model.score(said) < model.score(said.replace('"', ""))
    assert model.score("") == model.score(None) < 0.5


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (None, 1), (5, None), (6, 0), (6, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.learn(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).count() == odd.count()
    assert isinstance(Model([], __import__("numpy").ones((1, 3)), __import__("numpy").zeros(4)).score("x" * 100_000), float)
