"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry.llm import decontamination, extraction, language, merkle, minhash, packing, periodic, pii
from ambry.llm import quality, records, secrets, shallow, toxicity
from ambry.llm.batches import map_columns
from ambry.llm.merkle_sql import MANIFEST
from ambry.llm.periodic_sql import RUNS
from ambry.llm.quality_sql import RULES
from ambry.llm.spans import digest, joined
from ambry.session import scratch_path
from ambry.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold(parts: int) -> Column:
    """The remainder that decides which documents are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def span_digests(found: DataFrame, base_kinds: list[str], kinds: list[str]) -> DataFrame:
    """Counts, digest and list of the spans in ``base`` and ``added``."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in base_kinds) + ", base_sha256 string, spans string"

    def make():
        def apply(ids, base, added):
            fixed = [[(s["start"], s["end"], s["kind"]) for s in row] for row in base]
            more = [[(s["start"], s["end"], s["kind"]) for s in row] for row in added]
            out = {"doc_id": ids, "base_sha256": [digest(joined(row, base_kinds)) for row in fixed]}
            for kind in base_kinds:
                out[f"n_{kind}"] = [sum(s[2] == kind for s in row) for row in fixed]
            out["spans"] = [joined(row + extra, kinds) for row, extra in zip(fixed, more, strict=True)]
            return out

        return apply

    return map_columns(found, make, schema)


@query("op1_pii_spans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return span_digests(pii.find(docs, pii.learn(docs)), pii.KINDS, pii.KINDS)


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op3_quality_rules", RULES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(load(spark, sf_dir, "pages"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), words=3, similarity=Fraction(85, 100))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").where(fold(3) != 1)
    return toxicity.score(docs, toxicity.learn(docs, labels)).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits",
    )


@query("op8_token_records")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.write(load(spark, sf_dir, "documents"), scratch_path(spark, "token-records"))
    return records.read_digests(spark, folder)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language.learn(docs.where(fold(4) != 2))
    return language.identify(docs, filters).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage"
    )


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return span_digests(found, secrets.KINDS[:3], secrets.KINDS)


@query("op11_merkle_manifest", MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    # some documents lose their line feeds after the manifest was made
    changed = F.when(fold(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(load(spark, sf_dir, "documents"), changed)


@query("op12_shallow_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallow.pack_documents(load(spark, sf_dir, "documents"))


def rewritten(docs: DataFrame) -> DataFrame:
    """``docs`` with a tenth of the texts repeating some of their words up to their end."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(drawn % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    number, g = F.size("_w"), F.floor(F.col("_h") / 10)
    begin = F.when(number > 0, (g % number).cast("int"))
    period = (1 + F.floor((number - F.col("_a")) / (3 + g % 8))).cast("int")
    text = F.expr("array_join(concat(slice(_w, 1, _a), transform(sequence(0, size(_w) - _a - 1), i -> _w[_a + i % _p])), ' ')")
    return (
        docs.select("doc_id", "text", drawn.alias("_h"), words.alias("_w"))
        .withColumn("_a", begin).withColumn("_p", period)
        .select("doc_id", F.when(number > 0, text).otherwise(F.col("text")).alias("text"))
    )


@query("op13_periodic_runs", RUNS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(rewritten(load(spark, sf_dir, "documents").select("doc_id", "text")))
    # the greatest exponent by cross multiplication; runs come by start and period, so the first of equals stays
    best = F.expr("""aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (b, r) ->
        CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
