"""Many queries at once over the stored index."""

from __future__ import annotations

import math

from ambry.functions.analysis import PORTUGUESE
from ambry.operators import lexical, textindex
from ambry.sources.versions import Versions


def test_many_queries_shuffle_only_what_they_keep(spark, tmp_path):
    """Each task keeps the best documents of a query; the pairs of passages and queries never meet a shuffle."""
    rows = spark.createDataFrame([(i, "", ("sol " * (i % 7 + 1) + "gato mar ") * (1 + i % 3)) for i in range(60)], "doc_id long, title string, text string")
    store = Versions(spark, str(tmp_path / "many"))
    textindex.build(store, rows, PORTUGUESE)
    held = textindex.open_index(store)
    asked = spark.createDataFrame([(q, x) for q in range(300) for x in ("sol", "gat")[: 1 + q % 2]], "query_id long, lexeme string")
    best = lexical.best_of_many(held, asked, 3)
    got = {q: [] for q in range(300)}
    for r in best.orderBy("query_id", "place").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    total, df = held.totals.first(), {r["lexeme"]: r["passages"] for r in held.frequencies.collect()}
    scores = {}
    for r in held.postings.collect():
        weight = math.log(1 + (total["passages"] - df[r["lexeme"]] + 0.5) / (df[r["lexeme"]] + 0.5))
        tf = len(r["steps"])
        scores[r["lexeme"], r["doc_id"]] = weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * r["length"] / total["mean"]))
    for q in range(300):
        words = ("sol", "gat")[: 1 + q % 2]
        each = [(-round(sum(scores[x, d] for x in words), 6), d) for d in range(60)]
        assert got[q] == [(d, -s) for s, d in sorted(each)[:3]]
    assert "terms" in held.passages.columns
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan
