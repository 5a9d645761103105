"""CSV and JSON-lines records: text in, text out, nothing inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every cell as text; missing cells are '', all-blank rows are dropped.

    Quoted cells may hold commas, doubled quotes and line breaks. Naming the
    columns skips the look at the header.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "").option("nullValue", "").option("mode", "PERMISSIVE")
    )
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    raw = reader.csv(path)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns]
    filled = raw.select(*cells)
    some = reduce(lambda a, b: a | b, [F.trim(F.col(f"`{c}`")) != "" for c in raw.columns])
    return filled.where(some)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): each row as one CSV record, quoted only where needed, null as ''."""
    def cell(name: str):
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("value"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Stable column order, a header per file, '\\n' endings, quotes where needed."""
    (
        df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])
        .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("nullValue", "").option("lineSep", "\n")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def add_suggestion(spark: SparkSession, path: str, text: str) -> None:
    """The one thing visitors write: a non-blank line, with the time it came."""
    if not text.strip():
        raise ValueError("an empty suggestion")
    row = spark.createDataFrame([(text.strip(),)], "suggestion string")
    append_json_lines(row.select(F.uuid().alias("id"), "suggestion", F.current_timestamp().alias("created_at")), path)


def forget(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Records without the given ids; write them to a new place and switch over."""
    return rows.join(ids.select(key), key, "left_anti")


def write_checked(df: DataFrame, path: str, expect_rows: bool = True) -> int:
    """Replaces a table only once the new one is complete: written, counted, then named.

    Returns the number of rows. The caller points readers at ``path``.
    """
    df.write.mode("errorifexists").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if expect_rows and n == 0:
        raise ValueError("refusing to replace a table with nothing")
    return n
