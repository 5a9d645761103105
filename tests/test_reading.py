"""Titles, references, values, loading, text functions."""

from pyspark.sql import functions as F

from ambry.functions import paragraphs as P
from ambry.functions import snippets as S
from ambry.functions import text as T
from ambry.functions import titles
from ambry.functions import values as V
from ambry.functions.references import Catalogue, Work, parse_reference
from ambry.functions.titles import parse_title, with_part
from ambry.operators import loader

BOOKS = Catalogue([
    Work(1, "genesis", "Gênesis", 50, ("Gn",)), Work(46, "1-corintios", "1 Coríntios", 16, ("1Co",), ("Primeira aos Coríntios",)),
    Work(43, "joao", "João", 21, ("Jo",)), Work(62, "1-joao", "1 João", 5, ("1Jo",)), Work(19, "salmos", "Salmos", 150, ("Sl",), ("Salmo",)),
])


def refs(frame, *texts):
    rows = frame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    read = parse_reference(rows, "t", BOOKS).orderBy("i").collect()
    return [(r.ref_work, r.ref_chapter_start, r.ref_chapter_end, r.ref_verse_start, r.ref_verse_end) for r in read]


def test_reference_grammar(frame):
    got = refs(
        frame, "Gênesis 3.5-7", "GENESIS 1-3", "Gn 1.26-2.3", "Salmo 23", "sem livro 3", "João", "1 João 2:1",
        "I João 4", "1ª Coríntios 13.1,4 e 7", "1co13", "Jo e nada", "Gênesis 51.2", "João 3.16 - 2024", "Genesis 5-2", "Sl 1,2",
    )
    assert got == [
        ("genesis", 3, 3, 5, 7), ("genesis", 1, 3, None, None), ("genesis", 1, 2, 26, 3), ("salmos", 23, 23, None, None),
        (None,) * 5, ("joao", None, None, None, None), ("1-joao", 2, 2, 1, 1), ("1-joao", 4, 4, None, None),
        ("1-corintios", 13, 13, 1, 7), ("1-corintios", 13, 13, None, None), (None,) * 5,
        ("genesis", None, None, None, None), ("joao", 3, 3, 16, 16), ("genesis", 5, 5, None, None), ("salmos", 1, 1, 2, 2),
    ]


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_read_once_a_text(frame):
    rows = frame([(1, "João 3.16"), (2, "João 3.16"), (3, None), (4, "")], "i int, t string")
    read = parse_reference(rows, "t", BOOKS)
    got = {r.i: (r.ref_work, r.ref_chapter_start, r.ref_verse_end) for r in read.collect()}
    assert got == {1: ("joao", 3, 16), 2: ("joao", 3, 16), 3: (None,) * 3, 4: (None,) * 3}
    lines = [line.strip(" :+-") for line in optimised(read).split("\n")]
    join, rows_end = (next(i for i, line in enumerate(lines) if line.startswith(w)) for w in ("Join LeftOuter", "LogicalRDD"))
    # numbers are read beside the distinct texts, not after each row has met its text
    assert join < rows_end < next(i for i, line in enumerate(lines) if "aggregate(" in line)
    # and no text is taken apart before they are distinct
    assert not [line for line in lines if line.startswith("Filter") and "isnotnull(t#" in line and "regexp" in line]


def test_title_grammar(frame):
    rows = frame(
        [
            (0, "12-05-2024 - EBD - Vida no Deserto - Aula 3", None),
            (1, "IV Conferência Missionária - 1/2/20245 - João 3", None),
            (2, "EBD - João 3", None),
            (3, "cfw 07 e algo - CFW 7 - tema", None),
            (4, "Diaconia hoje (2)", None),
            (5, "Um tema - Salmo 1", "No II Congresso Jovem de maio"),
            (6, "O Caminho Parte IV", None),
        ],
        "i int, title string, about string",
    )
    got = {r.i: r for r in parse_title(rows, BOOKS, description="about").collect()}
    assert (got[0].kind, got[0].collection_name, got[0].part, got[0].display) == (
        "ebd", "Vida no Deserto", 3, "EBD - Vida no Deserto - Aula 3")
    assert (got[1].kind, got[1].event, got[1].display, got[1].ref_work) == (
        "conferencia", "IV Conferência Missionária", "João 3", "joao")
    assert (got[2].kind, got[2].collection_name) == ("ebd", None)
    assert (got[3].kind, got[3].collection_name) == ("culto", "CFW 7")
    assert (got[4].kind, got[4].collection_name, got[4].part) == ("diaconia", "Diaconia", 2)
    assert (got[5].kind, got[5].collection_name, got[5].ref_chapter_start) == ("congresso", "II Congresso Jovem", 1)
    assert (got[6].kind, got[6].collection_name, got[6].part) == ("culto", None, 4)


def test_titles_are_read_once(frame, monkeypatch):
    kept = []
    monkeypatch.setattr(titles, "cut", lambda df: kept.append(df.count()) or df)
    rows = frame(
        [(i, f"1{i % 3}-05-2024 - EBD - Vida no Deserto - João 3" if i < 30 else None, "I Congresso Jovem" if i % 2 else None)
         for i in range(32)], "i int, title string, about string",
    )
    got = {r.i: r for r in parse_title(rows, BOOKS, description="about").collect()}
    assert len(got) == 32 and {r.display for r in got.values()} == {"EBD - Vida no Deserto - João 3", None}
    assert {(r.kind, r.collection_name, r.event, r.ref_work, r.ref_chapter_start) for r in got.values() if r.i < 30} == {
        ("ebd", "Vida no Deserto", None, "joao", 3), ("ebd", "Vida no Deserto", "I Congresso Jovem", "joao", 3)}
    assert [(r.kind, r.collection_name, r.part, r.ref_work) for r in (got[30], got[31])] == [
        ("culto", None, None, None), ("congresso", "I Congresso Jovem", None, None)]
    # what is written holds displayed titles, not rows
    assert max(kept) <= 2


def test_part_notations(frame):
    titles = ["x Parte 12", "Aula 4 - x", "x (pt. 3)", "x (7)", "Da Vida III", "Capítulo", "A V", "Da Vida V"]
    rows = frame([(i, t) for i, t in enumerate(titles)], "i int, t string").orderBy("i")
    assert [r.part for r in with_part(rows, "t").collect()] == [12, 4, 3, 7, 3, None, None, 5]


def one(frame, value, fn, schema="t string"):
    return frame([(value,)], schema).select(fn(F.col("t"))).first()[0]


def test_values_read_from_text(frame):
    assert [one(frame, v, V.number_or_zero) for v in ("12abc", " 3.5 ", "", "x", None, "-2e1")] == [12, 3.5, 0, 0, 0, -20]
    assert [one(frame, v, V.int_or_null) for v in ("7.9", " 12x", "", "a")] == [7, 12, None, None]
    assert [one(frame, v, V.confidence) for v in ("0.4", "0", "zero", None)] == [0.4, 1, 1, 1]
    assert [one(frame, v, V.half_up, "t double") for v in (2.5, -2.5, 1.4)] == [3, -2, 1]
    assert [one(frame, v, V.short_date) for v in ("2024-03-09", "bad", "2024-13-01")] == ["09 mar 2024", "bad", "2024-13-01"]
    assert [one(frame, v, V.strip_leading_date) for v in ("09-03-2024 - Tema", "0903-24 – ", "Tema")] == ["Tema", "0903-24 –", "Tema"]
    assert [one(frame, v, lambda c: V.link_suffix(c, "chan")) for v in ("//chan/a/b", " chan/ ", None, "x")] == ["a/b", None, None, "x"]


def test_dates(frame):
    rows = frame(
        [("2024-02-30", "1700000000"), ("2031-01-01", "0"), ("2020-05-06", ""), ("x", "99")], "d string, ts string"
    )
    got = [str(r[0]) for r in rows.select(V.resolve_date(F.col("d"), F.col("ts"))).collect()]
    assert got == ["2023-11-14", "None", "2020-05-06", "None"]


def test_loading_rules_and_duplicates(frame):
    blank = dict.fromkeys(loader.RAW_FIELDS, "")
    base = {**blank, "processed": "True", "score": "80", "txt": "a.txt", "date": "2024-01-01", "words_min": "100"}
    raws = [
        {"name": "kept", "id": ""}, {"name": "better", "score": "90", "id": "9"}, {"name": "equal", "score": "90"},
        {"name": "edge", "score": "50", "txt": "b"}, {"name": "slow", "words_min": "70", "txt": "c"},
        {"name": "derived", "words_min": "", "words": "100", "duration": "120", "txt": "d"},
        {"name": "unknown", "words_min": "", "txt": "e", "artist": ""}, {"name": "no file", "txt": " "},
        {"name": "no date", "date": "1999-01-01", "txt": "f"}, {"name": "raw", "processed": "no"},
    ]
    rows = [(i, *[{**base, **r}[f] for f in loader.RAW_FIELDS]) for i, r in enumerate(raws)]
    raw = frame(rows, "pos long, " + ", ".join(f"`{f}` string" for f in loader.RAW_FIELDS))
    loaded = {r.title: r for r in loader.load_documents(raw).collect()}
    assert set(loaded) == {"better", "unknown"}
    assert (loaded["better"].doc_id, loaded["better"].place) == ("9", 0)
    assert (loaded["unknown"].doc_id, loaded["unknown"].person, loaded["unknown"].words_min) == ("unknown", "Desconhecido", 0)
    reasons = {r.title: r.reason for r in loader.skipped(raw).collect()}
    assert reasons == {
        "kept": "duplicate of a.txt", "equal": "duplicate of a.txt", "edge": "low score", "slow": "too few words per minute",
        "derived": "too few words per minute", "no file": "no transcript file", "no date": "unresolvable date", "raw": "not processed",
    }


def test_highlight_and_snippet(frame):
    text = "A Graça e a desgraça; gracioso " + "palavra " * 80 + "fim"
    rows = frame([(text,), ("curto",), ("á graça " * 60,)], "t string")
    marked = [r[0] for r in rows.select(S.highlight(F.col("t"), "GRACA que")).collect()]
    assert marked[0].startswith("A <mark>Graça</mark> e a desgraça; gracioso") and marked[1] == "curto" and "<mark>" not in marked[2]
    cut = rows.withColumn("at", S.first_hit(F.col("t"), "fim")).select("at", S.snippet(F.col("t"), F.col("at"))).collect()
    assert cut[0][0] == text.index("fim") and cut[0][1].startswith("…palavra ") and cut[0][1].endswith("fim")
    assert cut[1] == (-1, "curto") and cut[2][0] == -1


def test_paragraphs(frame):
    text = 'Um dois. "Tres!" Quatro cinco?) seis sete… oito.nove'
    rows = frame([(text,), ("  ",)], "t string").withColumn("s", P.sentences(F.col("t")))
    got = rows.select("s", P.paragraphs(F.col("s"), 3).alias("p")).collect()
    assert got[0].s == ["Um dois.", '"Tres!"', "Quatro cinco?)", "seis sete…", "oito.nove"]
    assert got[0].p == ['Um dois. "Tres!"', "Quatro cinco?) seis sete…", "oito.nove"] and got[1].p == []
    at = rows.limit(1).select(*[P.paragraph_at(P.paragraph_sizes(P.paragraphs(F.col("s"), 3)), F.lit(k)) for k in (0, 2, 3, 7, 99)])
    assert tuple(at.first()) == (0, 0, 1, 2, 0)


def test_text_functions(frame):
    assert one(frame, "  Olá  MUNDO ", T.fold_squeeze) == "ola mundo"
    assert one(frame, "a" * 90 + " " + "b" * 100, T.summarise) == "a" * 90 + "…"
    assert one(frame, "x" * 200, T.summarise) == "x" * 160 + "…"
    assert one(frame, "a b/ç(1)", T.url_segment) == "a%20b%2F%C3%A7(1)"
    assert one(frame, "<a href='x'>&", T.escape_xml) == "&lt;a href=&apos;x&apos;&gt;&amp;"
    assert one(frame, "a b c d e f g", lambda c: T.sample_text(T.words(c), 2, 1, 1)) == "a b\n[…]\nd\n[…]\ng"
