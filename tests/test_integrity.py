"""Integrity rules: what is found, and how the rows are dealt."""

from ambry.operators import integrity


def test_rows_are_dealt_to_as_many_tasks_as_they_need(frame, monkeypatch):
    monkeypatch.setattr(integrity, "ROWS_A_TASK", 4, raising=False)
    docs = frame([(i,) for i in range(12)], "doc_id long")
    facets = frame([(i, "") for i in [*range(11), 10, 99]], "doc_id long, raw_slug string")
    refs = frame([(i % 13, "w", i // 26) for i in range(40)], "doc_id long, work string, chapter int")
    works = frame([("w", 1)], "work string, chapters int")
    none = frame([], "slug string, parent_slug string")
    found = integrity.problems(docs, facets, refs, works, none, frame([], "variant_slug string, slug string"))
    got = sorted((r.rule, r.key) for r in found.collect())
    assert got == sorted([
        ("facets of an unknown document", "99"), ("document has facets twice", "10"), ("document without facets", "11"),
        *[("reference of an unknown document", "12")] * 3,
        *[("reference given twice", f"{i}|w|0") for i in range(13)], ("reference given twice", "0|w|1"),
    ])
    # 40 references at 4 a task: the number of tasks grows with the rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {line.rsplit(", ", 1)[1] for line in plan.split("\n") if "RepartitionByExpression [doc_id" in line} == {"10"}
