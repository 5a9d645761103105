"""Times registered queries on the supplied tables and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; names given as
arguments replace the headline list, ``all`` runs every query. Each query is
built and its whole result is consumed, once, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ambry.plans import QUERIES
from ambry.session import local_session

HEADLINE = [
    "r2_positional_index", "r5_cover_density", "r7_hybrid_facets", "r10_filtered_search", "r19_bm25_phrases",
    "r7_hybrid_search", "r7_hybrid_filtered", "r4_lexical_match", "r5_lexical_rank", "r6_knn_cosine",
    "r19_bm25", "r15_chunks", "r17_incremental_diff", "s16_chunk_merge", "r22_paragraphs", "r21_snippet",
    "a1_book_chapter", "a2_book_tree", "a4_by_person", "a5_year_month_tree", "a9_drill_sideways",
    "a9_counts_unfiltered", "o4_list_page", "j7_nested_includes", "c4_load", "f7_parse_reference",
    "f11_parse_title", "j11_contains_first_match", "j12_fuzzy_pairs", "c1_clusters", "c5_integrity",
    "a18_agreement", "a22_recall_at_k", "j13_best_fuzzy_match", "f30_taxonomy_rows", "s1_split_records", "w8_shards", "a12_content_seconds", "t1_rate_limiter", "t3_stream_upsert",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    chosen = list(QUERIES) if names == ["all"] else names or HEADLINE
    QUERIES["a6_by_type"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in chosen:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the benchmarked queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
