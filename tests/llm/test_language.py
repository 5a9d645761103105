import random

import numpy as np
import pytest

from ambry.llm import language
from ambry.llm.language import Filters, grams, letters

SYLLABLES = {"aa": ["ba", "do", "ki", "lu", "me"], "bb": ["tion", "ment", "eux", "oir", "que"], "cc": ["schl", "ung", "keit", "zwi", "ver"]}


def text_in(draw, lang, n=40):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    rows = [(k, text_in(draw, lang), lang) for k, lang in enumerate(list(SYLLABLES) * 100)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(corpus):
    filters = language.learn(corpus.where("doc_id % 4 <> 0"))
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    got = language.identify(corpus.where("doc_id % 4 = 0"), filters).collect()
    assert len(got) == 75 and all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in got)
    assert filters.identify("12345 --- 🙂")[0] == filters.identify(None)[0] == "und"
    assert filters.identify("жжж ъъъ")[1] == 0.0


def test_counts_are_right_but_for_false_positives(corpus):
    """The filters never miss what was put in, and what they add is as rare as they say."""
    filters = language.learn(corpus, rare=1e-9)
    draw = random.Random(2)
    held = {lang: set() for lang in filters.languages}
    for r in corpus.collect():
        for order in language.ORDERS:
            held[r.lang].update(grams(letters(r.text), order).tolist())
    codes = letters(text_in(draw, "aa", 300) + " " + "".join(chr(draw.randrange(97, 123)) for _ in range(20_000)))
    total, hits = filters.counts(codes)
    every = np.concatenate([grams(codes, order) for order in language.ORDERS]).tolist()
    for k, lang in enumerate(filters.languages):
        true = sum(g in held[lang] for g in every)
        assert true <= hits[k] <= true + 4 + 3 * total * filters.false_rate[k]


def test_more_languages_than_bits_in_a_word():
    names = [f"l{k:03}" for k in range(70)]
    masks = [np.zeros(1 << language.SLOT_BITS, "u8"), np.zeros(1 << language.SLOT_BITS, "u8")]
    codes = letters("some words here")
    for order in language.ORDERS:
        for slots in language._slots(grams(codes, order)):
            masks[1][slots] |= np.uint64(1 << 3)
    assert Filters(names, masks, np.zeros(70), 0).identify("some words here")[0] == "l067"


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in language.identify(odd, language.learn(odd)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[8].lang_pred == got[9].lang_pred == "und"
    assert got[10].lang_pred in ("en", "fr")
    assert language.identify(none, language.learn(none)).count() == 0
    assert language.identify(odd, language.learn(none)).count() == odd.count()
    kept = language.in_known_language(odd, language.learn(odd))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {5, 6, 7}
    assert letters("Ab-1c").tolist() == [ord(c) for c in " ab c "]


def test_a_language_never_learned_is_rejected_and_clean_texts_stay(spark):
    """The fifth language shares letters, endings and words with the others; some clean texts are in two languages."""
    draw = random.Random(4)
    marks = "abcdefghijklmnoprstuv"
    every = ["".join(draw.choice(marks) for _ in range(draw.randrange(2, 4))) for _ in range(150)]
    held = {f"l{k}": every[30 * k:30 * k + 30] for k in range(4)}
    held["fifth"] = every[120:] + every[:8] + every[30:38] + every[60:64]

    def text(lang, n):
        return " ".join("".join(draw.choice(held[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))

    langs = [f"l{k}" for k in range(4)]
    taught = [(k, text(langs[k % 4], draw.choice([5, 60, 120])), langs[k % 4]) for k in range(1200)]
    clean = [(2000 + k, text(langs[k % 4], draw.choice([2, 30, 60, 400])), None) for k in range(200)]
    mixed = [(3000 + k, text(langs[k % 4], 60) + " " + text(langs[(k + 1) % 4], 50), None) for k in range(40)]
    foreign = [(4000 + k, text("fifth", draw.choice([30, 60, 400])), None) for k in range(60)]
    docs = spark.createDataFrame(taught + clean + mixed + foreign, "doc_id long, text string, lang string")
    filters = language.learn(docs, aside=True)
    least = language.cutoffs(docs, filters)
    assert set(least) == set(langs) and all(0.1 < x < 1 for cuts in least.values() for x in cuts.values())
    before = {r.doc_id for r in language.in_known_language(docs, filters).collect()}
    assert before >= {r[0] for r in foreign}
    after = {r.doc_id for r in language.in_known_language(docs, filters, least=least).collect()}
    assert after == {r[0] for r in taught + clean + mixed}


def test_bounds_by_rank():
    assert language.bound_rank(language.ENOUGH - 1) == 0 and language.bound_rank(language.ENOUGH) == 1
    for n in (100, 999):
        draw = np.random.default_rng(n)
        r = language.bound_rank(n)
        above = np.mean([np.partition(draw.random(n), r - 1)[r - 1] > language.TAIL for _ in range(4000)])
        assert above <= language.RISK + 0.015
