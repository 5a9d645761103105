"""The stored index, compiled queries and versioned tables."""

import pytest
from pyspark.sql import functions as F

from ambry.functions.analysis import PLAIN, PORTUGUESE, Analyser
from ambry.operators import lexical, textindex
from ambry.operators.filters import Filters, SearchRequest
from ambry.session import scratch_path
from ambry.sources.versions import Versions, some_rows

DOCS = "doc_id long, title string, text string"
ROWS = [
    (1, "Carta aos Efésios", "a graça de deus e a lei da graça"),
    (2, "Outro título", "lei e graça lei de graça efesios"),
    (3, None, "nada de novo"),
    (4, "Vazio", ""),
    (5, "A lei", "palavra " * 200 + "lei final"),
]


@pytest.fixture(scope="module")
def held(spark):
    store = Versions(spark, scratch_path(spark, "index"))
    textindex.build(store, spark.createDataFrame(ROWS, DOCS), PORTUGUESE)
    return textindex.open_index(store)


def asked(spark, text, analyser=PORTUGUESE):
    return lexical.compile_query(spark, text, analyser)


def test_compiled_queries(spark):
    q = asked(spark, 'Graça or "lei de graça" -"da lei" -nada o', PORTUGUESE)
    assert [(p.lexemes, p.offsets) for p in q.alternatives] == [(("grac",), (0,)), (("lei", "grac"), (0, 2))]
    assert [(p.lexemes, p.offsets) for p in q.excluded] == [(("lei",), (0,)), (("nad",), (0,))]
    assert asked(spark, "de o a").alternatives == () and asked(spark, "").alternatives == ()
    assert asked(spark, "de Graça", PLAIN).lexemes == ("de", "graca")


def ranks(spark, held, text, scope=None):
    rows = lexical.ranked(held.postings, asked(spark, text), scope).collect()
    return {(r.doc_id, r.chunk_index): r.lexical_rank for r in rows}


def test_matches_and_cover_density(spark, held):
    assert ranks(spark, held, "Efésios") == {(2, 0): 0.1}
    assert ranks(spark, held, "efesios graça") == {(1, 0): 0.2, (2, 0): 0.3}
    # a stop word stands between: half a match
    assert ranks(spark, held, '"lei de graça"') == {(1, 0): 0.05, (2, 0): 0.1}
    assert ranks(spark, held, '"lei graça"') == {}
    assert ranks(spark, held, 'graça "lei de graça"') == {(1, 0): 0.2, (2, 0): 0.2}
    assert ranks(spark, held, "lei -efesios") == {(1, 0): 0.1, (5, 1): 0.1}
    assert ranks(spark, held, '-lei') == {} and ranks(spark, held, "de") == {}


def test_all_arms_take_phrases_exclusions_and_scopes(spark, held, frame):
    q = asked(spark, '"lei de graça" -efesios')
    assert [r.doc_id for r in lexical.lexical_arm(held, q, 5).collect()] == [1]
    assert [r.doc_id for r in lexical.bm25_arm(held, q, 5).collect()] == [1]
    assert lexical.title_arm(held, q, 5).count() == 0
    lei = asked(spark, "lei")
    assert [(r.doc_id, r.chunk_index) for r in lexical.title_arm(held, lei, 5).collect()] == [(5, 1)]
    only = frame([(2,)], "doc_id long")
    assert [r.doc_id for r in lexical.bm25_arm(held, lei, 5, only).collect()] == [2]
    assert lexical.title_arm(held, lei, 5, only).count() == 0
    for arm in (lexical.lexical_arm, lexical.bm25_arm, lexical.title_arm):
        assert arm(held, asked(spark, "o"), 5).count() == 0


def test_a_search_reads_its_filters(spark, held, frame):
    items = frame([(k, f"P{k % 2}", "x", None, None) for k in range(1, 6)], "item_id long, person string, kind string, collection string, date date")
    refs = frame([(1, "w", 1, "t")], "item_id long, work string, chapter int, topic string")
    vectors = held.passages.select("doc_id", "chunk_index", F.array(F.lit(1.0), F.col("doc_id").cast("float")).alias("embedding"))

    def found(**filters):
        request = SearchRequest("lei graça", 3, Filters(**filters))
        return {r.doc_id for r in lexical.search(held, vectors, items, refs, request, [1.0, 0.0], PORTUGUESE).collect()}

    assert len(found()) == 3
    assert found(people=("P0",)) == {2}
    assert found(works=("w",), chapter=1) == {1}
    assert found(works=("w",), chapter=2) == set() and found(people=("nobody",)) == set()


def test_terms_reach_the_scan(held, spark):
    plan = lexical.ranked(held.postings, asked(spark, "lei"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lexeme), EqualTo(lexeme,lei)]" in plan


def test_refresh_equals_a_new_index(spark):
    store, fresh = (Versions(spark, scratch_path(spark, "index")) for _ in range(2))
    textindex.build(store, spark.createDataFrame([*ROWS, (9, "t", "lei que sai")], DOCS), PORTUGUESE)
    now = spark.createDataFrame([(1, "Carta", "outra lei"), *ROWS[1:4], (6, "novo", "texto novo")], DOCS)
    assert textindex.refresh(store, now, PORTUGUESE) == 2
    textindex.build(fresh, now, PORTUGUESE)
    one, other = textindex.open_index(store), textindex.open_index(fresh)
    for name in textindex.TABLES:
        a, b = getattr(one, name), getattr(other, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_places_survive_their_steps(frame):
    rows = frame([([0, 3, 4, 90],), ([7],), (None,)], "at array<int>")
    got = rows.select("at", textindex.places(textindex.steps(F.col("at"))).alias("back")).collect()
    assert [r.back for r in got] == [[0, 3, 4, 90], [7], []]


def test_versions_change_whole_or_not_at_all(spark, frame):
    store = Versions(spark, scratch_path(spark, "versions"))
    with pytest.raises(LookupError):
        store.read("a")
    one = frame([(1,), (2,)], "x int")
    assert store.publish({"a": one, "b": one.limit(1)}, some_rows()) == 1
    before = store.read("a")
    with pytest.raises(ValueError, match="refusing"):
        store.publish({"a": one.where("x = 1"), "b": one.where("x > 9")}, some_rows())
    assert store.current().version == 1 and store.read("a").count() == 2
    assert store.publish({"a": one.where("x = 1"), "b": one}, some_rows("a")) == 2
    assert store.read("a").count() == 1 and before.count() == 2
    assert [r.version for r in store.manifest().orderBy("version").collect()] == [1, 2]


def test_stop_words_are_those_without_accents():
    assert "de" in PORTUGUESE.stop and "nao" not in PORTUGUESE.stop and "não" not in PORTUGUESE.stop
    assert Analyser().stop == ()
