"""Ranked retrieval: lexical, vector and title arms, fused by reciprocal rank.

Every arm is cut to a fixed depth with ``orderBy().limit()`` -- a distributed
top-k -- before any rank is given, so the windows below only ever see the few
rows that survived. Restrictions must be applied to the inputs: a filter placed
after the cut would starve the answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ambry.functions.text import tokens
from ambry.functions.vectors import cosine_to
from ambry.operators.filters import SearchRequest

TITLE_DEPTH = 2
ARM_DEPTH = 8
RRF_K = 60
PER_DOC = 2
RERANK_CANDIDATES = 40
WEIGHTS = {"lexical": 1.0, "semantic": 1.0, "title": 1.5}


@dataclass(frozen=True)
class LexicalQuery:
    """Alternatives to look for; a row matches when any of them occurs."""

    terms: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[str, ...] = ()

    @property
    def empty(self) -> bool:
        return not self.terms and not self.phrases


def lexical_query(
    text: str,
    analyse: Callable[[str], list[str]],
    stop_words: Iterable[str] = (),
) -> LexicalQuery:
    """Words are alternatives, quoted runs are phrases, a leading dash excludes."""
    stop = set(stop_words)
    terms: list[str] = []
    phrases: list[tuple[str, ...]] = []
    excluded: list[str] = []
    for dash, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not dash and bare.lower() == "or":
            continue
        found = [t for t in analyse(quoted or bare) if t not in stop]
        if dash:
            excluded += found
        elif quoted and len(found) > 1:
            phrases.append(tuple(found))
        else:
            terms += found
    unique = tuple(dict.fromkeys(terms))
    return LexicalQuery(unique, tuple(dict.fromkeys(phrases)), tuple(dict.fromkeys(excluded)))


def _phrase_starts(token_list: Column, phrase: tuple[str, ...]) -> Column:
    def begins(token: Column, at: Column) -> Column:
        rest = [F.get(token_list, at + i) == w for i, w in enumerate(phrase) if i > 0]
        return reduce(lambda a, b: a & b, rest, token == phrase[0])

    return F.filter(token_list, begins)


def match_positions(token_list: Column, query: LexicalQuery) -> Column:
    """How many positions of a token list the query hits; 0 is no match."""
    wanted = list(query.terms)
    hits = F.lit(0)
    if wanted:
        hits = hits + F.size(F.filter(token_list, lambda t: t.isin(wanted)))
    for phrase in query.phrases:
        hits = hits + F.size(_phrase_starts(token_list, phrase)) * len(phrase)
    if query.excluded:
        banned = F.array(*[F.lit(t) for t in query.excluded])
        hits = F.when(F.arrays_overlap(token_list, banned), 0).otherwise(hits)
    return hits


def lexical_rank(token_list: Column, query: LexicalQuery) -> Column:
    """Cover density of an any-of query: a tenth per matching position."""
    return match_positions(token_list, query) * F.lit(0.1)


def _top(df: DataFrame, depth: int, *order: Column, where: str = "true") -> DataFrame:
    """The best ``depth`` rows that satisfy ``where``, numbered from 1.

    Rows failing ``where`` must sort last. The test comes after the cut because
    Spark would push it below the projection and compute the score twice.
    """
    cut = df.orderBy(*order).limit(depth).where(where)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


PASSAGE_KEY = ("doc_id", "chunk_index")


def lexical_arm(passages: DataFrame, query: LexicalQuery, depth: int) -> DataFrame:
    """Best passages by lexical rank; needs a ``tokens`` column."""
    hits = passages.select(
        *PASSAGE_KEY, match_positions(F.col("tokens"), query).alias("hits")
    )
    return _top(hits, depth, F.desc("hits"), F.asc("doc_id"), F.asc("chunk_index"), where="hits > 0")


def semantic_arm(passages: DataFrame, vector: Sequence[float], depth: int) -> DataFrame:
    """Nearest passages by cosine distance, exact, over rows that have a vector."""
    near = passages.where(F.col("embedding").isNotNull()).select(
        *PASSAGE_KEY, F.round(1 - cosine_to(F.col("embedding"), vector), 9).alias("distance")
    )
    order = (F.asc_nulls_last("distance"), F.asc("doc_id"), F.asc("chunk_index"))
    return _top(near, depth, *order, where="distance IS NOT NULL")


def title_arm(
    docs: DataFrame, passages: DataFrame, query: LexicalQuery, depth: int
) -> DataFrame:
    """Documents whose title matches, each shown by its best passage.

    The cut comes first, so only ``depth`` documents reach the join with the
    passages. A document without passages drops out there.
    """
    matched = docs.select(
        "doc_id", match_positions(tokens(F.col("title")), query).alias("hits")
    )
    best_docs = _top(matched, depth, F.desc("hits"), F.asc("doc_id"), where="hits > 0")
    shown = (
        passages.join(F.broadcast(best_docs.select("doc_id")), "doc_id", "left_semi")
        .select(*PASSAGE_KEY, match_positions(F.col("tokens"), query).alias("in_text"))
        .groupBy("doc_id")
        .agg(F.min_by("chunk_index", F.struct(-F.col("in_text"), "chunk_index")).alias("chunk_index"))
    )
    return best_docs.join(shown, "doc_id").select(*PASSAGE_KEY, "rank", "hits")


def fuse(arms: dict[str, DataFrame], weights: dict[str, float], rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: one union and one small aggregation.

    Ids are unique within an arm, so this equals a chain of full outer joins.
    The arms are summed in a fixed order to keep scores reproducible.
    """
    tagged = [arm.select(*PASSAGE_KEY, F.lit(name).alias("arm"), "rank") for name, arm in arms.items()]
    union = reduce(DataFrame.unionByName, tagged)
    parts = [F.max(F.when(F.col("arm") == name, F.col("rank"))).alias(f"{name}_rank") for name in arms]
    score = reduce(
        lambda a, b: a + b,
        [
            F.coalesce(F.lit(weights[name]) / (F.lit(rrf_k) + F.col(f"{name}_rank")), F.lit(0.0))
            for name in arms
        ],
    )
    return union.groupBy(*PASSAGE_KEY).agg(*parts).withColumn("score", F.round(score, 12))


def cap_per_doc(scored: DataFrame, per_doc: int, k: int, doc: str = "doc_id") -> DataFrame:
    """At most ``per_doc`` passages of one document, then the best ``k``."""
    order = (F.desc("score"), F.asc("doc_id"), F.asc("chunk_index"))
    within = Window.partitionBy(doc).orderBy(*order)
    kept = scored.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_doc)
    return kept.drop("_n").orderBy(*order).limit(k)


def hybrid_search(
    docs: DataFrame,
    passages: DataFrame,
    query: LexicalQuery,
    vector: Sequence[float],
    k: int,
    weights: dict[str, float] = WEIGHTS,
    rrf_k: int = RRF_K,
    per_doc: int = PER_DOC,
) -> DataFrame:
    """(doc_id, chunk_index, score) of the best ``k`` passages, unordered ties by id.

    ``docs`` (doc_id, title) and ``passages`` (doc_id, chunk_index, tokens,
    embedding) must already be restricted to what the caller may see.
    """
    arms = {
        "lexical": lexical_arm(passages, query, ARM_DEPTH * k),
        "semantic": semantic_arm(passages, vector, ARM_DEPTH * k),
        "title": title_arm(docs, passages, query, TITLE_DEPTH * k),
    }
    fused = fuse(arms, weights, rrf_k)
    return cap_per_doc(fused, per_doc, k).select(*PASSAGE_KEY, "score")


def page_by_doc(ranked: DataFrame, limit: int) -> DataFrame:
    """Rows of the first ``limit`` distinct documents in rank order.

    ``limit`` counts documents, so a further passage of a kept document stays
    however late it comes. The input is a search answer, at most a few dozen
    rows, which is why one window over all of it is fine.
    """
    first = F.min("rank").over(Window.partitionBy("doc_id"))
    seen = ranked.withColumn("_first", first)
    nth = F.dense_rank().over(Window.orderBy("_first"))
    return seen.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_first", "_nth")


def group_by_doc(ranked: DataFrame) -> DataFrame:
    """One row per document of an answer: its best passage and how many more."""
    return ranked.groupBy("doc_id").agg(
        F.min("rank").alias("rank"),
        F.min_by("chunk_index", "rank").alias("top_chunk"),
        (F.count(F.lit(1)) - 1).alias("more"),
    )


Scorer = Callable[[str, pd.Series], pd.Series]


def overlap_scorer(query: str, passages: pd.Series) -> pd.Series:
    """Share of the query's words that a passage has; needs no model."""
    wanted = set(query.lower().split())
    share = lambda text: len(wanted & set(text.lower().split())) / max(1, len(wanted))
    return passages.map(share).astype("float64")


def rerank(
    candidates: DataFrame, query: str, scorer: Scorer, top_n: int, content: str = "content"
) -> DataFrame:
    """Re-order candidates by a pair scorer; any failure keeps the given order.

    ``candidates`` is one search answer with a ``rank``. A scorer that raises
    yields nulls, one null is enough to fall back for the whole answer, and
    ``reranked`` says which order the rows are in.
    """

    @F.pandas_udf(T.DoubleType())
    def score_pairs(batch: pd.Series) -> pd.Series:
        try:
            return scorer(query, batch).astype("float64")
        except Exception:  # a scorer is a remote model: its failure must not fail the search
            return pd.Series([None] * len(batch), dtype="float64")

    every = Window.partitionBy()
    scored = candidates.withColumn("_pair", score_pairs(F.col(content)))
    broken = F.max(F.col("_pair").isNull() | F.isnan("_pair")).over(every)
    flagged = scored.withColumn("reranked", ~broken)
    order = (
        F.when(F.col("reranked"), -F.col("_pair")).otherwise(F.col("rank").cast("double")).asc(),
        F.asc("rank"),
    )
    placed = flagged.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    kept = placed.where(~F.col("reranked") | (F.col("_place") <= top_n))
    return kept.select(
        *[c for c in candidates.columns if c not in ("rank", "score")],
        F.col("_place").alias("rank"),
        F.when(F.col("reranked"), F.col("_pair")).otherwise(F.col("score")).alias("score"),
        "reranked",
    )


def replied(candidates: DataFrame, reply: DataFrame) -> DataFrame:
    """The candidates that a reranker's reply names, in its order.

    ``reply`` is (index, score), where index counts the candidates by ``rank``
    from 0; an index that is none of theirs is dropped, and of several scores
    for one the best counts. Equal scores keep the order the candidates had.
    """
    best = reply.groupBy("index").agg(F.max("score").alias("_reply"))
    told = candidates.drop("score").join(best, candidates["rank"] - 1 == best["index"])
    order = Window.orderBy(F.desc("_reply"), "rank")
    return told.withColumn("_place", F.row_number().over(order)).select(
        *[c for c in candidates.columns if c not in ("rank", "score")], F.col("_place").alias("rank"), F.col("_reply").alias("score")
    )


def search(
    docs: DataFrame,
    passages: DataFrame,
    request: SearchRequest,
    vector: Sequence[float],
    analyse: Callable[[str], list[str]],
    scorer: Scorer | None = None,
) -> DataFrame:
    """A search from request to page: validate, retrieve, rerank, keep ``limit`` documents.

    ``docs`` and ``passages`` are already restricted by the request's filters.
    """
    asked = request.validate()
    query = lexical_query(asked.query, analyse)
    k = RERANK_CANDIDATES if scorer else asked.limit * PER_DOC
    best = hybrid_search(docs, passages, query, vector, k)
    order = Window.orderBy(F.desc("score"), "doc_id", "chunk_index")
    ranked = best.withColumn("rank", F.row_number().over(order))
    content = passages.select(*PASSAGE_KEY, "content").join(F.broadcast(ranked), [*PASSAGE_KEY])
    if scorer is None:
        answer = content.withColumn("reranked", F.lit(False))
    else:
        answer = rerank(content, asked.query, scorer, asked.limit * PER_DOC)
    return page_by_doc(answer, asked.limit)


def bm25_arm(
    passages: DataFrame, query: LexicalQuery, depth: int, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """Best passages by BM25 over the query's terms.

    Collection statistics are one row (count, mean length, one document
    frequency per term), read back as scalar subqueries. Nothing is shuffled
    but that row and the partial top-k.
    """
    sized = passages.select(
        *PASSAGE_KEY,
        F.size("tokens").alias("length"),
        *[
            match_positions(F.col("tokens"), LexicalQuery((w,))).alias(f"tf_{i}")
            for i, w in enumerate(query.terms)
        ],
    )
    stats = sized.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg("length").alias("mean"),
            *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(query.terms))],
        ).alias("stats")
    )
    known = sized.withColumn("stats", stats.scalar())
    parts = []
    for i in range(len(query.terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"stats.df_{i}")
        idf = F.log(1 + (F.col("stats.n") - df + 0.5) / (df + 0.5))
        soft = k1 * (1 - b + b * F.col("length") / F.col("stats.mean"))
        parts.append(idf * tf * (k1 + 1) / (tf + soft))
    score = reduce(lambda a, c: a + c, parts)
    hits = known.select(*PASSAGE_KEY, F.round(score, 9).alias("bm25"))
    return _top(hits, depth, F.desc("bm25"), F.asc("doc_id"), F.asc("chunk_index"), where="bm25 > 0")


def top_labels(
    docs: DataFrame, label_vectors: dict[str, Sequence[float]], cutoff: float = 0.5, top: int = 3, digits: int = 9
) -> DataFrame:
    """The closest labels of each document, best first.

    The labels are a closed list of a few dozen names, so they travel in the
    plan: each row is scored where it lies and nothing is joined or shuffled.
    """
    scored = F.array(
        *[
            F.struct(
                F.round(-cosine_to(F.col("embedding"), vec), digits).alias("order"),
                F.lit(name).alias("label"),
            )
            for name, vec in label_vectors.items()
        ]
    )
    near = F.filter(scored, lambda s: s["order"] <= -cutoff)
    best = F.slice(F.array_sort(near), 1, top)
    return docs.select("doc_id", F.posexplode(best).alias("at", "hit")).select(
        "doc_id",
        (F.col("at") + 1).alias("place"),
        F.col("hit.label").alias("label"),
        (-F.col("hit.order")).alias("similarity"),
    )


def recall(found: DataFrame, expected: DataFrame, asked: DataFrame) -> DataFrame:
    """Per query: does the answer hold every expected document, and enough rows?

    ``found`` and ``expected`` are (query_id, doc_id), ``asked`` is (query_id,
    min_results). Sums only, so a query with very many expectations is fine.
    """
    marks = (
        expected.select("query_id", "doc_id")
        .distinct()
        .withColumn("want", F.lit(1))
        .join(found.select("query_id", "doc_id").distinct().withColumn("have", F.lit(1)),
              ["query_id", "doc_id"], "full_outer")
        .groupBy("query_id")
        .agg(
            F.count("have").alias("results"),
            F.count_if(F.col("want").isNotNull() & F.col("have").isNull()).alias("missing"),
        )
    )
    return (
        asked.join(marks, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("results", F.lit(0)).cast("long").alias("results"),
            F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
            "min_results",
        )
        .withColumn("passed", (F.col("missing") == 0) & (F.col("results") >= F.col("min_results")))
    )


def overall(judged: DataFrame) -> DataFrame:
    """One row: queries, how many passed, and the share whose expected documents all came back."""
    n = F.count(F.lit(1))
    return judged.agg(
        n.alias("queries"), F.count_if("passed").alias("passed"),
        F.round(F.count_if(F.col("missing") == 0) / n, 9).alias("recall"),
    )
