"""Quoted records in splits, and changes between snapshots."""

import random

import pytest

from ambry.operators import snapshots
from ambry.session import scratch_path
from ambry.sources import records, splits


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    yield
    spark.conf.set(key, before)


def test_records_are_those_of_the_whole_file_reader(spark, frame, small_splits):
    rng = random.Random(4)
    parts = ["a", " ", ",", '"', "\n", "\r\n", "é", "x" * 40, '""', "\n\n"]
    cell = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    rows = [(str(i), cell(), cell() + "\n" * rng.choice([0, 0, 90])) for i in range(60)] + [("", "", ""), (" ", "  ", "")]
    path = scratch_path(spark, "split-csv")
    records.write_csv(frame(rows, "k string, a string, b string").coalesce(2), path, ["k", "a", "b"])
    got = splits.read_split_csv(spark, path, ["k", "a", "b"])
    blocks = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start").distinct()
    assert blocks.count() > 20
    want = records.read_csv(spark, path, ["k", "a", "b"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(r for r in rows if "".join(r).strip(" "))


def test_texts_of_records(frame):
    texts = frame(
        [(1, 'h,i\r\n1,"two\n""lines"""\r\n,\nlast,one'), (2, ""), (3, None), (4, 'only,"never closed\nto the end')], "id long, t string"
    )
    got = sorted(map(tuple, splits.parse_texts(texts, "id", "t", ["x", "y"]).collect()))
    assert got[:3] == [(1, 0, "h", "i"), (1, 1, "1", 'two\n"lines"'), (1, 4, "last", "one")]
    assert [g[:3] for g in got[3:]] == [(4, 0, "only")]
    assert splits.parse_texts(texts.where("id > 9"), "id", "t", ["x"]).count() == 0


def test_changes_between_snapshots(frame):
    shown = {0: ["c", "b", "a"], 1: ["d", "c", "a"], 2: ["e", "d", "b"], 3: []}
    age = {x: k for k, x in enumerate("edcba")}
    rows = frame([(k, s, age[s]) for k, names in shown.items() for s in names], "snapshot int, slug string, place int")
    got = sorted((r.snapshot, r.slug, r.change) for r in snapshots.changes(rows.unionByName(rows)).collect())
    assert got == [
        (0, "a", "new"), (0, "b", "new"), (0, "c", "new"), (1, "b", "died"), (1, "d", "new"),
        (2, "a", "aged"), (2, "b", "back"), (2, "c", "died"), (2, "e", "new"),
    ]
    last = {r.slug: r.change for r in snapshots.state(snapshots.changes(rows)).collect()}
    assert last == {"a": "aged", "b": "back", "c": "died", "d": "new", "e": "new"}
