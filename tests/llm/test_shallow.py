import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ambry.llm import shallow
from ambry.llm.byte_tokens import BYTE_BPE, ByteEncoder
from ambry.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def encode():
    return ByteEncoder(vocabulary(BYTE_BPE))


def test_ids_are_those_of_the_tokenizer(encode):
    texts = [
        "a  b", "a\n\nb", " a", "a ", "\n", "", "a\tb", "a \nb", "a\n b", "a\x1cb ,\x1cb", "x<|endoftext|>y <|endoftext|>  <|endoftext|>\n",
        "don't we'll it's '", "日本語 テスト 🙂 é́", "a\r\nb", "\t\t a \t b c", "12 3,4. -- a_b\n\n\n  c", "a \x1fb\x85 c", "naïve, ÀÉ. ª º µ ß× ÷",
        "w" * 300 + " " + "é" * 90,
    ]
    draw = random.Random(4)
    marks = ["a", "b1", ".", "'s", " ", " ", "\n", "\t", "\xa0", "\x1c", "　", "<|endoftext|>", "é"]
    texts += ["".join(draw.choice(marks) for _ in range(draw.randint(0, 12))) for _ in range(500)]
    for text, ids in zip(texts, encode.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def checked(histogram, capacity=2048):
    """(sequences, cut pieces) of a plan that holds every token once and pads nothing."""
    plan = shallow.Plan(histogram, capacity)
    lengths = [k for k in sorted(histogram) for _ in range(histogram[k])]
    parts, held = defaultdict(list), defaultdict(list)
    for _, at, count, start, length, sequence, offset in plan.rows:
        for k in range(count):
            parts[at + k].append((start, length))
            held[sequence + k].append((offset, length))
    assert len(parts) == len(lengths)
    for k, length in enumerate(lengths):
        at = 0
        for start, size in sorted(parts[k]):
            assert start == at
            at += size
        assert at == length
    short = Counter()
    for found in held.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at == capacity or at & (at - 1) == 0
        short[at] += at < capacity
    assert max(short.values(), default=0) <= 1  # at most one of each smaller power of two
    return len(held), sum(len(p) > 1 for p in parts.values())


def test_plans_hold_every_token_without_padding():
    draw = random.Random(5)
    for _ in range(60):
        checked(Counter(draw.randint(1, 16) for _ in range(draw.randint(0, 60))), 16)
    assert checked({}) == (0, 0)
    assert checked({2048: 7}) == (7, 0)
    assert checked({3: 4096})[0] == 6
    checked({1500: 301})
    assert checked({1025: 99, 1023: 99}) == (99, 0)


def test_few_pieces_are_cut():
    draw = random.Random(6)
    lengths = Counter(min(2048, int(draw.lognormvariate(6.3, 0.9)) + 1) for _ in range(30_000))
    sequences, cuts = checked(lengths)
    assert sequences <= sum(k * n for k, n in lengths.items()) // 2048 + 12
    assert cuts <= 300


def test_least_squares_meet_the_conditions_of_an_optimum():
    draw = random.Random(7)
    demand = np.zeros(33)
    for _ in range(4000):
        demand[draw.randint(1, 32)] += 1
    columns = shallow.combinations(np.flatnonzero(demand), 32)
    assert {tuple(c) for c in columns.tolist()} == {
        (a, b, 32 - a - b) for a in range(33) for b in range(a + 1) if 0 <= 32 - a - b <= b and demand[a] and (not b or demand[b])
        and (a + b == 32 or demand[32 - a - b])
    }
    weight = np.sqrt(0.1 + np.arange(33) / 32)
    chosen, times = shallow.repeats(columns, demand, weight)
    assert (times > 0).all()

    def error(x):
        return float((weight**2 * (demand - shallow._totals(columns, x, 33)) ** 2)[1:].sum())

    # a plain projected gradient does no better
    x = np.zeros(len(columns))
    for _ in range(4000):
        short = weight**2 * (demand - shallow._totals(columns, x, 33))
        short[0] = 0
        x = np.maximum(0, x + 0.01 * short[columns].sum(axis=1))
    whole = np.zeros(len(columns))
    where = {tuple(c): k for k, c in enumerate(columns.tolist())}
    for c, t in zip(chosen.tolist(), times, strict=True):
        whole[where[tuple(c)]] = t
    assert error(whole) <= error(x) + 1e-4 * float((weight**2 * demand**2).sum())


def test_documents(odd, none, encode):
    rows = shallow.pack_documents(odd).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault((r.doc_id, len(encode.encode([r.text])[0]) // 4 + 1), []).append(r.text)
    held, at = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        held[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert set(held) == set(texts)
    for key, parts in held.items():
        copies = texts[key]
        data = encode.encode(copies[:1])[0] + (1).to_bytes(4, "little")
        assert sum(p[1] for p in parts) == key[1] * len(copies)
        for start, length, crc in parts:
            assert crc == zlib.crc32(data[4 * start:4 * (start + length)])
    assert all(size == 2048 or size & (size - 1) == 0 for size in at.values())
    assert shallow.pack_documents(none).count() == 0
