"""Search answers, filters and paging."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ambry.functions.vectors import cosine_to, vector_text
from ambry.operators import index, retrieval
from ambry.operators.filters import Filters, ListRequest, SearchRequest, restrict
from ambry.operators.facets import drill_sideways, year_month_tree
from ambry.operators.listing import number_aware, page

split = lambda text: text.lower().split()


def test_queries_are_alternatives_phrases_and_exclusions():
    q = retrieval.lexical_query('Alpha or "beta gamma" -delta the', split, {"the"})
    assert (q.terms, q.phrases, q.excluded) == (("alpha",), (("beta", "gamma"),), ("delta",))


def test_match_positions(frame):
    q = retrieval.lexical_query('a "b c" -z', split)
    rows = frame([(["a", "b", "c", "a"],), (["c", "b"],), (["a", "z"],)], "t array<string>")
    got = [r[0] for r in rows.select(retrieval.match_positions(F.col("t"), q)).collect()]
    assert got == [4, 0, 0]


def test_page_counts_documents_and_keeps_further_passages(frame):
    ranked = frame([("A", 1), ("A", 2), ("B", 3), ("C", 4), ("D", 5), ("B", 6)], "doc_id string, rank int")
    got = retrieval.page_by_doc(ranked, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in got] == [("A", 1), ("A", 2), ("B", 3), ("C", 4), ("B", 6)]


def candidates(frame):
    return frame(
        [("A", 0, "x y", 0.9, 1), ("B", 0, "q q", 0.8, 2), ("C", 0, "q x", 0.7, 3)],
        "doc_id string, chunk_index int, content string, score double, rank int",
    )


def test_rerank_orders_by_the_scorer(frame):
    got = retrieval.rerank(candidates(frame), "q", lambda query, texts: texts.str.count(query), 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.reranked) for r in got] == [("B", 2.0, True), ("C", 1.0, True)]


def test_rerank_failure_keeps_the_given_order(frame):
    def broken(query: str, texts: pd.Series) -> pd.Series:
        raise TimeoutError

    got = retrieval.rerank(candidates(frame), "q", broken, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.reranked) for r in got] == [("A", 0.9, False), ("B", 0.8, False), ("C", 0.7, False)]


def corpus(frame):
    docs = frame([(i, "alpha" if i == 3 else "other", "en" if i < 5 else "fr") for i in range(8)], "doc_id int, title string, lang string")
    rows = [(i, c, ["alpha"] * (i + 1) if i >= 5 else ["beta"], [1.0, float(i)]) for i in range(8) for c in range(3)]
    return docs, frame(rows, "doc_id int, chunk_index int, tokens array<string>, embedding array<float>")


def test_restrictions_apply_before_the_cut(frame):
    docs, passages = corpus(frame)
    q = retrieval.lexical_query("alpha", split)
    mine = docs.where("lang = 'en'")
    seen = passages.join(mine.select("doc_id"), "doc_id", "left_semi")
    got = retrieval.hybrid_search(mine, seen, q, [1.0, 0.0], 4).collect()
    # were the filter applied after the cut, only the lexical hits in fr would have been left to it
    assert len(got) == 4 and {r.doc_id for r in got} <= set(range(5))


def test_at_most_two_passages_of_one_document(frame):
    docs, passages = corpus(frame)
    got = retrieval.hybrid_search(docs, passages, retrieval.lexical_query("alpha", split), [1.0, 7.0], 6).collect()
    counts = pd.Series([r.doc_id for r in got]).value_counts()
    assert len(got) == 6 and counts.max() == 2


def test_recall_needs_every_expected_document_and_enough_rows(frame):
    found = frame([(1, "a"), (1, "b"), (2, "a")], "query_id int, doc_id string")
    expected = frame([(1, "a"), (2, "z"), (3, "q")], "query_id int, doc_id string")
    asked = frame([(1, 2), (2, 0), (3, 0), (4, 1), (5, 0)], "query_id int, min_results int")
    got = {r.query_id: r.passed for r in retrieval.recall(found, expected, asked).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_cosine_of_a_zero_vector_is_null(frame):
    rows = frame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [r[0] for r in rows.select(cosine_to(F.col("v"), [0.6, 0.8])).collect()]
    assert got[0] is None and abs(got[1] - 1) < 1e-9
    assert rows.select(vector_text(F.col("v"))).collect()[1][0] == "[3.000000,4.000000]"


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 17, 18, 24, 25, 26, 60])
@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 8)])
def test_windows_cover_the_text(frame, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    want, at = [], 0
    while at < n:
        piece = words[at:at + size]
        if len(piece) < overlap and want:
            break
        want.append(" ".join(piece))
        if at + size >= n:
            break
        at += size - overlap
    rows = frame([(words,)], "w array<string>")
    assert rows.select(index.windows(F.col("w"), size, overlap)).first()[0] == want


def test_prune_refuses_to_empty_the_index(frame):
    ids = lambda n: frame([(i,) for i in range(n)], "doc_id int")
    assert index.prune(ids(100), ids(97)).count() == 3
    for corpus_size in (0, 90):
        with pytest.raises(ValueError):
            index.prune(ids(100), ids(corpus_size))
    with pytest.raises(ValueError):
        index.require_matched(5, 0, "rows")
    index.require_matched(0, 0, "rows")


def browse(frame):
    items = frame(
        [(1, "P", "culto", "s", "2024-01-05"), (2, "P", None, None, "2024-03-01"), (3, "Q", "ebd", "s", "2023-12-31")],
        "item_id int, person string, kind string, collection string, date string",
    ).withColumn("date", F.to_date("date"))
    refs = frame([(1, "gn", 1, "fe"), (1, "gn", 2, "fe"), (2, "ex", 0, "fe"), (3, "gn", 5, "amor")],
                 "item_id int, work string, chapter int, topic string")
    return items, refs


def counted(frame, f):
    return {(r.dimension, r["value"]): r.total for r in drill_sideways(*browse(frame), f).collect()}


def test_a_dimension_is_not_narrowed_by_itself(frame):
    got = counted(frame, Filters(people=("P",), since="2024-01-01", until="2024-12-31"))
    assert got["people", "P"] == 2 and ("people", "Q") not in got
    assert got["years", "2024"] == 2 and got["total", ""] == 2
    # one item in two chapters of a work counts once, null kinds are no value
    assert got["works", "gn"] == 1 and got["kinds", "culto"] == 1 and len([k for k in got if k[0] == "kinds"]) == 1


def test_the_chapter_belongs_to_the_work(frame):
    items, refs = browse(frame)
    ids = lambda f: sorted(r.item_id for r in restrict(items, refs, f).collect())
    assert ids(Filters(works=("gn",), chapter=5)) == [3]
    assert ids(Filters(chapter=5)) == [1, 2, 3]
    assert ids(Filters(kinds=("culto", "ebd"))) == [1, 3]


def test_filter_algebra_and_validation():
    f = Filters.from_params({"people": "a,,b", "chapter": "3", "since": "2024-13", "until": "2024-01-31"})
    assert f == Filters(people=("a", "b"), until="2024-01-31")
    g = f.add("works", "gn").add("works", "gn")
    assert g.works == ("gn",) and g.count() == 4
    assert Filters(works=("gn",), chapter=2).drop("works", "gn") == Filters()
    assert f.with_year(2020).without_dates().until is None
    assert Filters.from_params(g.to_params()) == g
    assert f.chips({("people", "a"): "Ana"}) == [
        ("people", "a", "Ana"), ("people", "b", "b"), ("years", "até 2024-01-31", "até 2024-01-31")]
    assert Filters(works=("gn",), chapter=3).with_year(2020).chips({}) == [("works", "gn", "gn 3"), ("years", "2020", "2020")]
    for bad in (SearchRequest("x"), SearchRequest("ok", 51), ListRequest(page=0), ListRequest(sort="size"),
                ListRequest(Filters(works=("a",), chapter=151)), ListRequest(Filters(kinds=tuple("abcdefghijk")))):
        with pytest.raises(ValueError):
            bad.validate()


def test_course_order_puts_the_unnumbered_first(frame):
    rows = frame([(1, 2, "2024-01-01"), (2, None, "2024-05-01"), (3, 1, "2024-03-01")], "item_id int, part int, date string")
    assert [(r.item_id, r.total) for r in page(rows, "collection").collect()] == [(2, 3), (3, 3), (1, 3)]
    assert [r.item_id for r in page(rows, "work", number=2, per_page=2).collect()] == [1]


def test_year_totals_and_number_order(frame):
    items, _ = browse(frame)
    assert [tuple(r)[1:] for r in year_month_tree(items).select("year", "month", "total", "year_total").collect()] == [
        (3, 1, 2), (1, 1, 2), (12, 1, 1)]
    names = frame([("Parte 10",), ("parte 9",), ("Párte 2b",)], "name string")
    assert [r.name for r in names.orderBy(number_aware(F.col("name"))).collect()] == ["Párte 2b", "parte 9", "Parte 10"]
    far = frame([("n 1000000000000",), ("n 5",), ("n 007",), ("n 999999999999",)], "name string")
    assert [r.name for r in far.orderBy(number_aware(F.col("name"))).collect()] == ["n 5", "n 007", "n 999999999999", "n 1000000000000"]


def test_facet_tree_keeps_empty_members_and_hides_chapter_zero(frame):
    from ambry.operators.facets import facet_tree

    items, refs = browse(frame)
    works = frame([("gn", "old", 1), ("ex", "old", 2)], "work string, section string, position int")
    tree = facet_tree(items, refs, works, frame([("s",), ("none",)], "collection string"), frame([("fe",), ("paz",)], "topic string"))
    rows = {name: df.collect() for name, df in tree.items()}
    chapters = {r.work: [(c.chapter, c.total) for c in r.chapters] for r in rows["works"]}
    assert chapters == {"gn": [(1, 1), (2, 1), (5, 1)], "ex": []}
    assert {r.work: r.total for r in rows["works"]} == {"gn": 2, "ex": 1}
    assert {r.collection: r.total for r in rows["collections"]} == {"s": 2, "none": 0}
    assert {r.topic: r.total for r in rows["topics"]} == {"fe": 2, "paz": 0}
    assert {r.person: r.total for r in rows["people"]} == {"P": 2, "Q": 1}
