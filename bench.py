"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.plans import search  # noqa: E402
from threadloom.plans.catalog import CATALOG  # noqa: E402
from threadloom.session import build_session  # noqa: E402
from threadloom.tables import table  # noqa: E402

HEADLINE = [
    "str_clean_text", "str_html_text", "str_filter_message", "dt_parse_any", "flt_valid_chunk",
    "mail_documents", "chunk_fixed_stride", "chunk_recursive", "chunk_record_id",
    "join_slack_dims", "agg_thread_groups", "agg_query_telemetry", "agg_stage_telemetry",
    "agg_cost_rollup", "agg_review_votes", "win_cumulative_length", "grp_thread_merge",
    "grp_consecutive_merge", "ret_dense_topk", "ret_dense_arrow", "ret_bm25_corpus", "ret_bm25",
    "ret_keyword", "ret_graph_neighbor", "ret_hop_expand", "fuse_weighted_rr", "fuse_rrf",
    "rr_tfidf", "rr_maxsim", "rr_near_dup", "rr_mmr", "eval_topk", "qry_intent", "qry_route",
    "qry_prf", "top_timeline", "snk_upsert_chunks", "inc_hash_upsert", "inc_size_cap",
    "stm_telemetry_5m",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, **{"spark.sql.shuffle.partitions": cores})
    table(spark, sf_dir, "documents").count()  # start the workers before timing
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for key in wanted:
        times[key] = timed(lambda key=key: CATALOG[key].run(spark, sf_dir))
        print(key, times[key], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        chunk_sec = timed(lambda: search.chunks(spark, sf_dir))
        n_chunks = search.chunks(spark, sf_dir).count()
        times["ingest_chunks"] = chunk_sec
        times["search_end_to_end"] = timed(lambda: search.search(spark, sf_dir))
        n_queries = table(spark, sf_dir, "benchmark").count()
        rates = {
            "chunks_per_sec": round(n_chunks / chunk_sec, 1),
            "bm25_queries_per_sec": round(n_queries / times["ret_bm25_corpus"], 2),
            "dense_queries_per_sec": round(n_queries / times["ret_dense_topk"], 2),
            "hybrid_reranked_queries_per_sec": round(n_queries / times["rr_tfidf"], 2),
        }
    else:
        rates = {}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cores), "rates": rates}))


if __name__ == "__main__":
    main()
