"""Days as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ambry.functions.values import date_from_texts, day_text


def test_a_late_upload_second_has_a_year_without_a_sign(spark):
    rows = spark.createDataFrame([(1600000000,), (1600000000 + 2999983 * 86400,), (0,)], "epoch long")
    found = date_from_texts(F.lit("Tema 3"), F.lit("nada"), F.col("epoch"))
    assert [r[0] for r in rows.select(day_text(found)).collect()] == ["2020-09-13", "10234-05-18", "1970-01-01"]
