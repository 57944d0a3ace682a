"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqloom.session import build_session  # noqa: E402
from seqloom.suite import catalog  # noqa: E402

HEADLINE = (
    "s00_ingest_events", "a06_wp_report", "a07_wp_by_bucket", "a13_strength_grid", "a22_residual_persistence", "a24_paired_bootstrap",
    "a33_feature_residual_corr", "a36_error_atlas", "f04_sample_n_per_sequence", "w02_multi_lag", "w04_dual_ema", "w10_legendre_memory",
    "w11_dilated_stack", "m01_weighted_ridge", "m01_wide_gram", "m08_replicated_fit", "p17_score_trees_arrow", "r02_bm25", "r04_vector_knn", "r06_hybrid_search",
    "u03_fuse_average", "u04_fuse_vote", "u05_fuse_cellwise", "t02_top_k_with_group_cap", "x01_stream_replay", "x02_stream_correction",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that no measured query pays for starting the engine and the stored table.
    catalog.QUERIES["a05_global_wp"][0](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
