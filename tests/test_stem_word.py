"""The stemmer of single words and the postings made inside a passage."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ambry.functions import stem as S
from ambry.functions.analysis import PLAIN, PORTUGUESE
from ambry.operators import textindex
from ambry.operators.postings import placed


def test_one_word_and_a_column_of_words_have_the_same_stems(spark):
    endings = [*S.STANDARD, *S.LOGIC, S.ADVERB, S.ADVERB_A, *S.STATE, *S.ACTIVE, *S.AGENT, *S.VERB, "os", "a", "e", "gue", "cie", "ci"]
    heads = ["", "a", "b", "am", "tr", "eu", "pr", "cant", "igual", "relativ", "abilit", "icon", "osten", "7x", "nacionaliz", "quieic"]
    more = ["ativ", "iv", "os", "ic", "ad", "ant", "abil", "at", "e", ""]
    words = sorted({h + m + e for h, m, e in product(heads, more, endings)})
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    differ = [r for r in S.stem(rows).collect() if r["stem"] != S.stem_word(r["word"])]
    assert differ == []


def test_postings_of_a_passage(spark):
    rows = spark.createDataFrame(
        [(4, 0, "gato de gatos o gato sol".split()), (4, 1, ["de"]), (7, 0, []), (8, 0, None), (9, 2, ["sol", "gata"])],
        "doc_id long, chunk_index int, tokens array<string>",
    )
    found = {(r["lexeme"], r["doc_id"], r["chunk_index"]): (r["length"], r["at"]) for r in placed(rows, PORTUGUESE).select(
        "*", textindex.places(F.col("steps")).alias("at")).collect()}
    assert found == {("gat", 4, 0): (6, [0, 2, 4]), ("sol", 4, 0): (6, [5]), ("sol", 9, 2): (2, [0]), ("gat", 9, 2): (2, [1])}
    assert {r["lexeme"] for r in placed(rows, PLAIN).collect()} == {"gato", "gatos", "gata", "de", "o", "sol"}


def test_making_postings_shuffles_nothing(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.array(F.lit("sol")).alias("tokens"))
    plan = placed(rows, PORTUGUESE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
