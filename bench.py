"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query is run
twice to a sink that discards rows, and the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colweave.session import local_session  # noqa: E402
from workloads import registry  # noqa: E402

HEADLINE = (
    "x1_x6_project_mapping",
    "x3_multi_source_mapping",
    "a9_header_columns",
    "a13_file_statistics",
    "s7_json_profile",
    "c3_c4_reduce_all_levels",
    "c11_tier_choice",
    "c12_prompt_text",
    "m4_m6_match_columns",
    "n4_n12_reply_items",
    "n13_u3_merge_duplicates",
    "g8_source_tables",
    "e1_e5_all_edits",
    "e1_e5_long_logs",
    "m8_coverage",
    "c13_refine_context",
    "j6_share_suggestions",
    "k1_result_documents",
    "l1_session_list",
    "l2_session_payloads",
    "w2_patch_sessions",
    "w4_add_shares",
    "t1_fold_chunks",
    "t1_stream_fold",
    "t2_request_outcomes",
)


def timed(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = registry.queries()
    times = {name: round(min(timed(queries[name], spark, sf_dir) for _ in range(2)), 3) for name in chosen}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
