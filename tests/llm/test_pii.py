import random
import re

import pytest

from ambry.llm import pii
from ambry.llm.queries import span_digests

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    draw = random.Random(1)
    texts = []
    for _ in range(120):
        n = draw.randrange
        texts.append(draw.choice([
            f"some words +1 ({n(200, 999)}) 555-{n(1000, 9999)} and more words",
            f"some words {draw.choice('abc')}x.{n(99)}@mail{n(9)}.example.com and more words",
            f"some words {n(256)}.{n(256)}.{n(256)}.{n(256)} and more words",
            "some words 4041894974608795 and more words",
        ]))
    return pii.train(texts, 60)


def test_fixed_patterns_are_those_of_a_plain_search():
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choice("aB1.@+- ()9.0%x4") for _ in range(50))
        assert sorted(pii.base_spans(text)) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+1" + " " * 60_000, "x@" * 20_000, "1 2 " * 8_000])
def test_long_runs_take_linear_time(field, text):
    base, added = field.spans(text)
    assert all(text[s:e] for s, e, _ in base + added)


def test_added_spans_touch_no_fixed_ones_and_fixed_ones_stay(field):
    texts = ["call (743) 555-3824 now", "a@b.com, 743-555-3824", "+1 (269) 555-3296 4524132264652876 and", "on 2021-05-06 it was 1,234,567.00"]
    for text in texts:
        base, added = field.spans(text)
        assert sorted(base) == plain(text)
        assert not any(a[0] < b[1] and b[0] < a[1] for a in added for b in base)
    assert field.spans(texts[0])[1] == [(5, 19, "phone")]
    assert not field.spans(texts[3])[1]


def test_decoding_is_the_best_of_all_segmentations(field):
    import itertools

    from ambry.llm import semicrf
    window = pii.Window.of("at (743) 555-3824 x", 0, 19)
    segments = window.segments()
    x = semicrf.lattice(len(window.tokens), segments, field.numbers.get)
    scores = [sum(field.weights[f] for f, o in zip(x.features, x.owner, strict=True) if o == k) for k in range(len(x.starts))]
    def every(at):
        if at == x.size:
            yield 0.0
        for k in range(len(x.starts)):
            if x.starts[k] == at:
                yield from (scores[k] + rest for rest in every(x.ends[k]))
    best = max(itertools.islice(every(0), 2_000_000))
    assert sum(scores[k] for k in semicrf.best(x, field.weights)) == pytest.approx(best)


def test_odd_rows(spark, odd, none, field):
    got = span_digests(pii.find(odd, field), pii.KINDS, pii.KINDS).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.spans for r in got}[1] == ""
    assert span_digests(pii.find(none, pii.learn(none)), pii.KINDS, pii.KINDS).count() == 0
    assert pii.learn(odd).spans("a@b.com")[0] == [(0, 7, "email")]


PLAIN = [
    ("email", "ax.66@mail9.example.com"), ("ip", "192.168.10.24"), ("ip", "10.0.0.1"), ("ip", "8.8.8.8"),
    ("card", "4041894974608795"), ("card", "4524 1322 6465 2876"), ("phone", "+1 (743) 555-3824"),
]


@pytest.mark.parametrize("kind, span", PLAIN)
@pytest.mark.parametrize("change", [str, str.upper])
def test_every_rewritten_form_is_a_candidate(kind, span, change):
    draw = random.Random(5)
    for form in {pii.rewritten(span, kind, draw) for _ in range(200)}:
        form = change(form)
        text = f"{'nothing else is in this text ' * 5}{form}{' and nothing follows but words' * 5}"
        start = text.index(form)
        proposed = set()
        for low, high in pii.windows(text):
            window = pii.Window.of(text, low, high)
            proposed |= {(window.tokens[i][0], window.tokens[j - 1][1], k) for i, j, k, _ in window.segments()}
        assert (start, start + len(form), kind) in proposed, form


def test_rewritten_numbers_are_found(field):
    for span in ("192[.]168[.]10[.]24", "10(.)0(.)0(.)1", "4041/8949/7460/8795", "4041  8949  7460  8795"):
        text = f"some plain words {span} and more plain words"
        assert [text[s:e] for s, e, _ in field.spans(text)[1]] == [span]
