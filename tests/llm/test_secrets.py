import random
import re
import string

import pytest

from ambry.llm import secrets
from ambry.llm.queries import span_digests

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(2)
    parts = ["the", "ing", "and", "ver", "ung", "sch", "tion", "ment", "que", "ist"]
    rows = []
    for k in range(600):
        words = ["".join(draw.choice(parts) for _ in range(draw.choice([1, 2, 2, 3, 3, 7]))) for _ in range(60)]
        if k % 20 == 0:
            words.insert(5, "".join(draw.choice(string.ascii_letters + string.digits) for _ in range(32)))
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_fixed_patterns():
    draw = random.Random(1)
    bits = ["password", "PassWd", "api_key", "token", "=", ": ", "\"", "'", " ", "AKIA", "AKIA9", "0123456789abcdef", "deadbeef", "zz", "ſecret", "Q7", "/+.", "secret"]
    for _ in range(4000):
        text = "".join(draw.choice(bits) for _ in range(14))
        assert sorted(secrets.base_spans(text)) == plain(text), text


def test_random_strings_are_found_and_words_are_not(spark, corpus):
    scanner = secrets.fit(corpus)
    found = secrets.scan(corpus, scanner).collect()
    texts = {r.doc_id: r.text for r in corpus.collect()}
    hits = {(r.doc_id, texts[r.doc_id][s.start:s.end]) for r in found for s in r.added}
    planted = {(k, texts[k].split()[5]) for k in range(0, 600, 20)}
    assert len(hits & planted) >= 27 and len(hits - planted) <= 1
    for ordinary in ("abcdefghijklmnopqrstuvwxyz0123456789", "a" * 40, "verungschtionmentqueistandtheing", "1" * 30, "0123456789" * 3):
        assert not scanner.spans(ordinary)[1]


def test_tests_of_the_battery():
    draw = random.Random(8)
    values = [secrets.digits("".join(draw.choice(secrets.ALPHABETS["base62"]) for _ in range(40)), "base62") for _ in range(300)]
    for p in (lambda v: secrets.runs_p(v, 62), secrets.serial_p, lambda v: secrets.uniform_p(secrets.chi_squared(v, 62), 62)):
        low = sum(p(v) < 0.1 for v in values)
        assert 5 <= low <= 65
    rising = secrets.digits(secrets.ALPHABETS["base62"], "base62")
    assert secrets.serial_p(rising) < 1e-6 and secrets.runs_p(rising, 62) < 1e-6
    assert secrets.encoding("DEADBEEF") == "hex_upper" and secrets.encoding("dead beef") is None


def test_odd_rows_and_redaction(spark, odd, none):
    scanner = secrets.fit(odd)
    rows = span_digests(secrets.scan(odd, scanner), secrets.KINDS[:3], secrets.KINDS).collect()
    assert len(rows) == odd.count() and not any(r.n_assign for r in rows)
    assert secrets.redact(odd, scanner).columns == odd.columns
    assert sorted(map(repr, secrets.redact(odd, scanner).collect())) == sorted(map(repr, odd.collect()))
    one = spark.createDataFrame([(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'), (2, None)], "root int, text string")
    assert [r.text for r in secrets.redact(one, scanner).collect()] == ['x [SECRET]" y', None]
    assert secrets.scan(none, secrets.fit(none)).count() == 0
    huge = "ab" * 100_000
    assert scanner.spans(huge) is not None
