"""Ordered computations, sources, sinks and streams."""

import gzip
import json
import random
import statistics

from pyspark.sql import functions as F

from ambry.operators import catalogue, labelling, limits, ordering, quality
from ambry.sources import records, site, transcripts
from ambry.streaming import ingest


def accepted(hits, limit, width):
    out, windows = {}, {}
    for key, t, event in sorted(hits):
        resets, used = windows.get(key, (None, 0))
        if resets is None or t >= resets:
            windows[key] = (t + width, 1)
            out[event] = True
        else:
            out[event] = used < limit
            windows[key] = (resets, used + out[event])
    return out


def test_rate_limit_equals_the_sequential_rule_on_skewed_keys(spark):
    rng = random.Random(2)
    hits = [(0 if i % 3 == 0 else rng.randint(1, 6), rng.randint(0, 400), i) for i in range(400)]
    rows = spark.createDataFrame(hits, "key long, t long, event long").repartition(5)
    got = {r.event: r.accepted for r in limits.rate_limit(rows, 3, 25).collect()}
    assert got == accepted(hits, 3, 25)


def test_position_carry_median_and_shards(spark):
    rng = random.Random(4)
    data = [(rng.choice("aab"), rng.randint(0, 50), i) for i in range(300)]
    rows = spark.createDataFrame(data, "g string, v int, i long").repartition(7)
    placed = ordering.with_position(rows, "g", "v", "i")
    assert [(r.g, r.v, r.i) for r in placed.orderBy("position").collect()] == sorted(data)
    value = F.when(F.col("i") % 10 == 0, F.col("i"))
    want, last = {}, (None, None)
    for g, v, i in sorted(data):
        last = (g, i) if i % 10 == 0 else (g, last[1] if last[0] == g else None)
        want[i] = last[1]
    assert {r.i: r["x"] for r in ordering.carry_last(placed, ["g"], value, "x").collect()} == want
    medians = {r.g: r["median"] for r in ordering.grouped_median(rows, ["g"], "v", "i").collect()}
    assert medians == {g: statistics.median(v for h, v, _ in data if h == g) for g in "ab"}
    for count in (1, 7, 300, 301):
        shards = [r.shard for r in ordering.shard(rows, count, "i").orderBy("i").collect()]
        sizes = [shards.count(s) for s in sorted(set(shards))]
        assert shards == sorted(shards) and max(sizes) - min(sizes) <= 1 and len(sizes) == min(count, 300)


def test_spread(spark):
    rows = spark.range(103).toDF("i")
    for count in (1, 10, 103, 200):
        got = sorted(r.i for r in ordering.spread(rows, count, "i").collect())
        assert got == sorted({i * 103 // count for i in range(count)})


def test_quality_metrics(frame):
    stamps = frame([("a", float(t), t) for t in (0, 2, 4, 10, 12)] + [("b", 1.0, 0)], "k string, t double, i int")
    assert {r.k: r.seconds for r in quality.content_seconds(stamps, "k", "t", "i").collect()} == {"a": 10.0, "b": None}
    segments = frame([("f", [("Olá,", 0.5), ("e", None)]), ("g", [("...", 0.9)])], "file string, words array<struct<word:string,score:double>>")
    assert {r.file: r.score for r in quality.weighted_score(segments, "file").collect()} == {"f": 37.5, "g": 0.0}
    replies = frame([('{"usage":{"prompt_tokens":200,"prompt_tokens_details":{"cached_tokens":50}}}',), ("{}",), ("x",)], "payload string")
    assert tuple(quality.usage_totals(replies).first()) == (1, 200, 0, 50, 0.0, 25)


def test_csv_keeps_commas_quotes_and_line_breaks(spark, frame, tmp_path):
    rows = [('a,"b"', "line\nbreak", " x "), ("", None, "1"), (None, "", " ")]
    records.write_csv(frame(rows, "p string, q string, r string"), str(tmp_path / "t"), ["p", "q", "r"])
    got = sorted(tuple(r) for r in records.read_csv(spark, str(tmp_path / "t")).collect())
    assert got == [("", "", "1"), ('a,"b"', "line\nbreak", " x ")]
    line = records.csv_lines(frame([(1, 'a "b"', None)], "i int, t string, n string"), ["t", "i", "n"]).first()[0]
    assert line == '"a ""b""",1,'


def test_transcripts_alignments_and_store(spark, frame, tmp_path):
    (tmp_path / "a b.txt").write_text("[0] Um \n[1] dois\n", encoding="utf-8")
    texts = transcripts.read_texts(spark, str(tmp_path))
    docs = frame([(1, "a b.txt"), (2, "../a b.txt"), (3, "none.txt")], "id int, transcript_file string")
    got = {r.id: r.text for r in transcripts.with_transcripts(docs, texts).collect()}
    assert got == {1: "[0] Um \n[1] dois\n", 2: None, 3: None}
    assert texts.select(transcripts.clean_lines(F.col("text"))).first()[0] == "Um dois"
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump({"segments": [{"text": "t", "end": 9.0, "words": [{"word": "Um", "score": 0.8}, {"word": "7"}]}]}, f)
    aligned = transcripts.read_alignments(spark, str(tmp_path / "x.json.gz"))
    assert aligned.select("file", transcripts.last_end(F.col("segments"))).first() == ("x.json.gz", 9.0)
    assert quality.weighted_score(transcripts.spoken_words(aligned), "file").first()[1] == 53.3
    share = aligned.select(quality.coverage(transcripts.last_end(F.col("segments")), F.lit(10.0)), quality.coverage(F.lit(1.0), F.lit(0.0), F.lit(64044)))
    assert tuple(share.first()) == (0.9, 0.5)
    metas = frame([("f", ["a", "b"]), ("g", ["a"])], "file string, metas array<string>")
    vectors = frame([("f", [[1.0], [2.0]]), ("g", [[1.0], [2.0]])], "file string, vectors array<array<double>>")
    assert [tuple(r) for r in transcripts.zip_store(metas, vectors).collect()] == [("f", 0, "a", [1.0]), ("f", 1, "b", [2.0])]
    names = frame([("Um [x] dia [123].txt",), ("solto.txt",)], "f string").select(*transcripts.stem_and_id(F.col("f")))
    assert [r[1] for r in names.collect()] == ["123", None]
    assert frame([("0.0,\n0.5\n\n",)], "t string").select(transcripts.packet_times(F.col("t"))).first()[0] == [0.0, 0.5]


def test_stream_replays_change_nothing_and_the_last_version_counts(spark, frame, tmp_path):
    schema = "id int, v string, n int"
    inbox, table = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (2, "d", 3)]):
        frame(rows, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        ingest.ingest(stream, table, str(tmp_path / "progress")).awaitTermination()
    kind = frame([], schema).schema
    state = lambda t: sorted((r.id, r.v) for r in ingest.current(spark, t, kind, ["id"], "n").collect())
    assert state(table) == [(1, "a"), (2, "d")]
    ingest.compact(spark, table, str(tmp_path / "small"), kind, ["id"], "n")
    assert state(str(tmp_path / "small")) == [(1, "a"), (2, "d")]


def test_agreement_counts_silent_documents(frame):
    docs = frame([(i,) for i in range(4)], "doc_id int")
    labels = frame([(0, "x", "a"), (0, "y", "a"), (1, "x", "a"), (1, "x", "b"), (1, "y", "b"), (2, "y", "c")], "doc_id int, config string, topic string")
    assert tuple(labelling.agreement(docs, labels, "x", ["x", "y"]).first()) == ("y", 2, 0.625, 4)
    assert sorted(r.doc_id for r in labelling.divergent(labels, ["x", "y"]).collect()) == [1, 2]


def test_failed_calls_are_rows(frame):
    got = catalogue.run_batch(frame([("2",), ("x",)], "t string"), "t", lambda v: str(1 / int(v))).collect()
    assert got[0].answer == "0.5" and got[1].answer is None and got[1].error.startswith("ValueError")


def test_site(frame):
    rows = frame([("/a&b", None), ("/c", "2024-01-02")], "path string, lastmod string")
    assert [r[0] for r in site.url_tags(rows, "https://x").collect()] == [
        "  <url>\n    <loc>https://x/a&amp;b</loc>\n  </url>",
        "  <url>\n    <loc>https://x/c</loc>\n    <lastmod>2024-01-02</lastmod>\n  </url>",
    ]
    pages = frame([("2024", None), ("2024", "2"), ("1999", None), ("2024", "13"), ("x", None)], "s string, m string")
    got = [tuple(map(str, r)) for r in pages.select(*site.date_leaf(F.col("s"), F.col("m"))).collect()]
    assert got == [("2024-01-01", "2024-12-31"), ("2024-02-01", "2024-02-29")] + [("None", "None")] * 3
    head = frame([('T "q"', "d", "/p")], "t string, d string, p string")
    assert "<title>T &quot;q&quot;</title>" in head.select(site.page_head(F.col("t"), F.col("d"), F.col("p"), "https://x")).first()[0]


def test_cleaning(frame):
    from ambry.functions.cleaning import clean_texts

    long = "um " * 34 + "fim, e depois, porém tarde; existe."
    got = clean_texts(frame([(f"olá mundo, e só. {long}",), ("",)], "text string")).collect()
    tail = "Um " + "um " * 33 + "fim. E depois. Porém tarde; existe."
    assert got[0].cleaned == f"Olá mundo, e só. {tail}"
    assert (got[0].sentences_before, got[0].sentences, got[0].sentence_ratio) == (2, 4, 2.0)
    assert (got[1].words, got[1].sentence_ratio) == (0, 0.0)


def test_pages_are_read_side_by_side(spark):
    from ambry.sources.paged import PagedSource

    class Numbers(PagedSource):
        page_size = 4

        @classmethod
        def name(cls):
            return "numbers"

        def schema(self):
            return "n int"

        def total(self):
            return 10

        def fetch(self, offset, limit):
            return [(n,) for n in range(offset, min(offset + limit, 10))]

    spark.dataSource.register(Numbers)
    rows = spark.read.format("numbers").load()
    assert sorted(r.n for r in rows.collect()) == list(range(10))


def test_suggestions_sidecars_and_forgetting(spark, frame, tmp_path):
    path = str(tmp_path / "s")
    records.add_suggestion(spark, path, " mais temas ")
    try:
        records.add_suggestion(spark, path, "  ")
        raise AssertionError
    except ValueError:
        pass
    back = records.read_json_lines(spark, path, "id string, suggestion string, created_at timestamp")
    assert [r.suggestion for r in back.collect()] == ["mais temas"]
    assert records.forget(back, back.select("id")).count() == 0
    (tmp_path / "T [7].info.json").write_text('{"id": "7", "duration": 3.5, "other": 1}')
    side = transcripts.read_sidecars(spark, str(tmp_path / "*.info.json")).first()
    assert (side.file, side.id, side.duration, side.title) == ("T [7].info.json", "7", 3.5, None)
    try:
        records.write_checked(frame([], "i int"), str(tmp_path / "w"))
        raise AssertionError
    except ValueError:
        pass


def test_liveness_is_refused_on_a_short_feed_and_on_a_jump(frame):
    from ambry.operators import matching

    link = r'https://a\.example/chan/([^<"\s]+)'
    feed = lambda n: frame([(1, " ".join(f"<u>https://a.example/chan/t{i}</u>" for i in range(n)))], "feed int, body string")
    records_ = frame([(i, f"e{i}" if i else " ", f"t{i * 20}") for i in range(7)], "id int, episode string, slug string")
    before = frame([(True,)] * 4, "alive boolean")
    got = matching.refresh_liveness(records_, feed(121), before, link)
    # record 0 has no episode
    assert {r.id: r.alive for r in got.collect()} == dict.fromkeys(range(1, 7), True)
    for bad_feed, previous in ((feed(99), before), (feed(101), before)):
        try:
            matching.refresh_liveness(records_.withColumn("slug", F.lit("gone")), bad_feed, previous, link)
            raise AssertionError
        except ValueError:
            pass


def test_a_busy_key_is_spread_over_blocks(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key"), F.lit(5).alias("v"), F.col("id").alias("i"))
    # rows this few would be merged into one task again; keep the range partitions apart to see them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.with_position(rows.repartition(6), "key", "v", "i")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    busy = placed.where("key = 0").groupBy("_block").count().collect()
    # two thirds of the rows share a key and a value; no block may hold more than its fair part of them
    assert len(busy) > 2 and max(r["count"] for r in busy) < 1000
