import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ambry.llm import packing
from ambry.llm.tokens import WordEncoder, vocabulary


@pytest.fixture(scope="module")
def encode():
    return WordEncoder(vocabulary())


def test_ids_are_those_of_the_tokenizer(encode):
    texts = [
        "a\tb c\x1cd e\xa0f", "<|endoftext|>x y<|startoftext|>", "don't we'll  it's. x'., ab.,", "é ́a", "ΣΑΣ. İi", "", "  \n ",
        "x" * 200 + " y" + "z" * 90 + ".", " 12,3 4. 5.", "日本語, テスト. ", "a\r\nb\x0bc\x85d", "µ ª º ÀÉÎ ß ÿ ÿ. x×y ñ,é Ñandú, straße. STRASSE ẞ ŉ ǰ",
    ]
    for text, ids in zip(texts, encode.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    small = WordEncoder(vocabulary(), kept=5)
    assert small.encode(texts * 3) == encode.encode(texts) * 3
    assert len(small.known) <= 5


def checked(histogram, capacity=2048, **more):
    runs = packing.plan(histogram, capacity, **more)
    held = Counter()
    for run in runs:
        assert sum(run.lengths) + run.gap == capacity and run.gap >= 0 and run.count > 0
        for length in run.lengths:
            held[length] += run.count
    assert held == Counter({k: n for k, n in histogram.items() if n})
    return sum(r.count for r in runs)


def test_plans_hold_all_pieces_in_few_sequences():
    draw = random.Random(3)
    for size in (0, 1, 5, 70, 3_000, 200_000):
        lengths = Counter(min(2048, int(draw.lognormvariate(6.3, 0.9)) + 1) for _ in range(size))
        count = checked(lengths)
        least = -(-sum(k * n for k, n in lengths.items()) // 2048)
        assert least <= count <= 1.02 * least + 4
    assert checked({2048: 7}) == 7
    assert checked({1: 5000}) == 3
    assert checked({1024: 10, 1025: 3}) == 8
    assert checked({3: 4, 4: 4, 5: 4}, 12, groups=3) == 4


def test_linear_grouping_finds_the_best_mix():
    # 7 + 3 and 4 + 3 + 3 fill every sequence of 10; 4 + 4 would not
    assert checked({7: 100, 4: 100, 3: 300}, 10, groups=5, small=0.2) == 200


def test_documents(spark, odd, none, encode):
    rows = packing.pack_documents(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(encode.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    assert packing.pack_documents(none).count() == 0
