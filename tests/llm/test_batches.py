import pytest

from ambry.llm import batches


@pytest.mark.parametrize("given, kept", [("64m", "8000000"), ("67108864b", "8000000"), ("1m", "1m"), ("500000", "500000")])
def test_arrow_batches_are_made_smaller_never_larger(spark, given, kept):
    before = spark.conf.get(batches._SETTING)
    spark.conf.set(batches._SETTING, given)
    try:
        batches._small_batches(spark.range(1))
        assert spark.conf.get(batches._SETTING) == kept
    finally:
        spark.conf.set(batches._SETTING, before)


def test_slices_keep_all_rows(spark):
    rows = [(k, "x" * (k % 50) if k % 7 else None) for k in range(300)]

    def make():
        return lambda ids, texts: {"id": ids, "size": [len(t or "") for t in texts]}

    got = batches.map_columns(spark.createDataFrame(rows, "id long, t string"), make, "id long, size long", text="t", rows=11, chars=90)
    assert sorted(map(tuple, got.collect())) == sorted((k, len(t or "")) for k, t in rows)
