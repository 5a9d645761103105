"""Quality rules whose cutoffs are chosen on labelled holdouts with a guarantee.

Signals of a text are column expressions. For each stratum and signal, the
lowest cutoff is taken at which the share of good texts that it would reject
is shown to be at most ``RISK``: an exact binomial test on labelled good texts
rejects any greater share, at a level that is corrected for the number of
strata and signals; the cutoffs of one signal are tested in a fixed order,
most careful first, which needs no correction. Where labels cannot show it, a
signal rejects nothing.

DataFrame functions only: all of it runs in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ambry.session import cut

WINDOW = 8
#: share of good texts that all signals of a stratum together may reject
RISK = 0.01
#: chance that any of the guarantees fails
DOUBT = 0.05
STEPS = 64
#: terms of a binomial tail that are added up one by one; what is left is bounded
TERMS = 400

_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """What spaces, tabs, line and form feeds, vertical tabs and carriage returns leave."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, base measures, signals) of every row of ``docs``.

    The base measures are n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words; null texts count as empty. Windows of words are compared by a
    64-bit hash. Each measure is an expression over arrays inside its row, so
    no row meets another one and a very long text stays one row. Other columns
    are dropped.
    """
    docs = docs.select("doc_id", F.col(stratum).alias("stratum"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.withColumns({
        "_words": words(F.col("text")),
        "_lines": lines,
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _SPACE, "")).cast("long"),
    })
    # one hash per word; a window's hash is that of its words' hashes, in order
    hashed = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words", "_lines")
    count = F.col("n_words").cast("int") - (WINDOW - 1)
    spots = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    windows = hashed.withColumn(
        "_windows",
        F.sort_array(F.transform(spots, lambda i: F.struct(
            F.xxhash64(F.slice(F.col("_hashes"), i, WINDOW)).alias("h"), i.alias("i")
        ))),
    ).drop("_hashes")
    # equal windows stand side by side now
    pairs = F.zip_with(
        F.col("_windows"), F.slice(F.col("_windows"), 2, F.greatest(F.size("_windows") - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    repeated = windows.withColumn(
        "_spots", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    ).drop("_windows")
    # each spot covers its window, less what the one before has covered
    covered = F.aggregate(
        "_spots", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    base = repeated.withColumn("n_repeat_words", covered.cast("long")).drop("_spots", "text")
    return base.withColumns(signals())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


SIGNALS = ["symbols", "dup_lines", "repeats", "long_words"]


def signals() -> dict[str, Column]:
    """The signals as columns over the base measures, from 0 to 1; the greater, the worse."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.least(F.col("n_symbols") / n, F.lit(4.0)) / 4,
        "dup_lines": F.least(F.col("n_dup_lines") * 10 / n, F.lit(1.0)),
        "repeats": F.col("n_repeat_words") / n,
        "long_words": F.least(F.col("word_chars") / n, F.lit(24.0)) / 24,
    }


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_binomial_tail(x: Column, n: Column, rate: float) -> Column:
    """ln P(at most ``x`` of ``n``) for a chance of ``rate`` each; 0 where x is not below n * rate.

    The greatest term exactly, then the others by their ratios, which fall; the
    terms after the last one added are bounded by a geometric series, so
    the tail is never understated.
    """
    p = math.log(rate)
    q = math.log1p(-rate)
    odds = (1 - rate) / rate
    top = log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + x * p + (n - x) * q
    steps = F.sequence(F.lit(0), F.least(x, F.lit(TERMS)).cast("int"))
    total = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct(
            (s["term"] * (x - k) / (n - x + k + 1) * odds).alias("term"), (s["sum"] + s["term"]).alias("sum")
        ),
        # the ratio of the next terms is below the first one
        lambda s: s["sum"] + s["term"] / F.greatest(1 - x / (n - x + 1) * odds, F.lit(1e-9)),
    )
    return F.when(x < n * rate, top + F.log(total)).otherwise(F.lit(0.0))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, signal, cutoff): signals at or above the cutoff reject.

    ``rows`` has doc_id, stratum and the signals; ``labels`` has doc_id and
    quality. Texts labelled good are the holdout. Counts of steps, at most
    strata times signals times ``STEPS``, are all that is shuffled.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    names = SIGNALS
    steps = F.explode(F.array(*[
        F.struct(F.lit(k).alias("signal"), F.least(F.floor(F.col(k) * STEPS), F.lit(STEPS)).cast("int").alias("step"))
        for k in names
    ]))
    counted = (
        rows.join(good, "doc_id", "left_semi").select("stratum", steps.alias("s"))
        .groupBy("stratum", F.col("s.signal").alias("signal"), F.col("s.step").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    )
    strata = counted.select("stratum").distinct().agg(F.count(F.lit(1))).scalar()
    # every step is a possible cutoff, also one at which no good text lies
    every = counted.select("stratum", "signal").distinct().select(
        "stratum", "signal", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"), F.lit(0).cast("long").alias("n")
    )
    full = counted.unionByName(every).groupBy("stratum", "signal", "step").agg(F.sum("n").alias("n"))
    # at most STEPS + 1 rows to a window
    by = Window.partitionBy("stratum", "signal")
    above = full.select(
        "stratum", "signal", "step",
        F.sum("n").over(by.orderBy(F.desc("step"))).alias("rejected"), F.sum("n").over(by).alias("total"),
    )
    each = risk / len(names)
    level = math.log(doubt / len(names)) - F.log(strata)
    shown = above.where("step > 0").withColumn(
        "sure", log_binomial_tail(F.col("rejected").cast("double"), F.col("total").cast("double"), each) <= level
    )
    # fixed order from the most careful cutoff down: stop at the first that fails
    failed = F.max(F.when(~F.col("sure"), F.col("step")))
    best = shown.groupBy("stratum", "signal").agg(F.coalesce(failed, F.lit(0)).alias("failed"))
    return best.where(F.col("failed") < STEPS).select(
        "stratum", "signal", ((F.col("failed") + 1) / STEPS).alias("cutoff")
    )


#: cutoffs that are few enough to be sent to every task
FEW = 100_000


def judge(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``rejected_by``, the signals of a row that reach their cutoff, to ``rows``.

    A stratum that labels say nothing of rejects nothing. Only strata with
    thousands of labelled texts have cutoffs; their number is checked before they are broadcast.
    """
    maps = cut(chosen.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("_cutoffs")
    ))
    if maps.count() <= FEW:
        maps = F.broadcast(maps)
    joined = rows.join(maps, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    flags = F.array(*[F.when(F.col(k) >= F.col("_cutoffs")[k], F.lit(k)) for k in SIGNALS])
    return joined.withColumn("rejected_by", F.array_compact(flags)).drop("_stratum", "_cutoffs")


def rated(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The measures of ``docs`` with ``base_failed``, ``rejected_by`` and ``kept``.

    Measured once and checkpointed, as numbers only. Repeated rows repeat
    their answer; a null doc_id has no label but is judged like others.
    """
    rows = cut(measured(docs, stratum))
    return judge(rows, cutoffs(rows, labels)).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)
    )
