import zlib

import numpy as np
import pytest

from ambry.llm import records
from ambry.llm.tokens import WordEncoder, vocabulary
from ambry.session import scratch_path


def test_frames_come_back_and_damage_is_seen():
    bodies = [records.payload(7, np.array([1, 10, 65535], "<u4").tobytes()), records.payload(None, b""), records.payload(-2, np.array([1 << 20], "<u4").tobytes())]
    data = b"".join(map(records.frame, bodies))
    found = list(records.unframed(data))
    assert [records.decoded(b)[0] for _, b in found] == [7, None, -2]
    assert [records.decoded(b)[1].tolist() for _, b in found] == [[1, 10, 65535], [], [1 << 20]]
    assert [bytes(b) for _, b in records.unframed(data, found[2][0])] == [bodies[2]]
    for at in (0, 9, 14, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(records.unframed(bytes(broken)))
    with pytest.raises(ValueError):
        list(records.unframed(data[:-4]))


def test_round_trip(spark, odd, none):
    encode = WordEncoder(vocabulary()).tokenizer.encode
    folder = records.write(odd, scratch_path(spark, "records-test"), file_chars=40_000)
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(records.read_digests(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    for (doc_id, text), r in zip(texts, got, strict=True):
        ids = np.array(encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert records.read_index(spark, folder).select("file").distinct().count() > 1
    one, other = ([(r.doc_id, bytes(r.ids)) for r in records.shuffled(spark, folder, seed, block=2).collect()] for seed in (1, 2))
    assert one != other and sorted(one, key=repr) == sorted(other, key=repr)
    assert len(one) == odd.count()
    empty = records.write(none, scratch_path(spark, "records-test"))
    assert records.read_digests(spark, empty).count() == 0
