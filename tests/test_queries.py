"""Registered queries against their SQL on the same tables."""

import pytest
from check import compare
from conftest import SF_DIR
from seqloom.suite import catalog

# One or two per operator family; `python tests/check.py <dir>` runs all of them.
CHOSEN = """a01_wp_moments a03_two_pass_wp a06_wp_report a07_wp_by_bucket a15_pick_minmax_strength a22_residual_persistence
a23_adjacent_scored_cosine a24_paired_bootstrap a26_leave_one_out a33_feature_residual_corr a36_error_atlas a39_propensity_table a41_roc_auc
a43_wp_gradient a48_matched_contrast f02_stride_sample f04_sample_n_per_sequence f06_bernoulli_mask f08_split_sequences j02_pairing_mismatches
j04_lookup_propensity m01_weighted_ridge m06_propensity_weighted_ridge m10_tangent_ridge m15_split_gains p11_side_features p17_score_trees
r02_bm25 r04_vector_knn r06_hybrid_search s00_ingest_events s03_validate_sequences s04_validate_order s10_write_read_cache s15_verify_hash_chain
t02_top_k_with_group_cap t13_outcome_label t14_patience u04_fuse_vote u05_fuse_cellwise u08_content_quality w02_multi_lag w04_dual_ema
w10_legendre_memory w13_endpoint_features x03_stream_metric""".split()


def test_every_query_is_well_formed():
    names = set(catalog.QUERIES)
    assert len(names) > 170
    assert not [n for n in CHOSEN if n not in names]
    with_sql = [n for n, (_, text) in catalog.QUERIES.items() if text]
    assert len(with_sql) / len(names) > 0.9


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, oracle, name):
    fn, text = catalog.QUERIES[name]
    assert compare(fn(spark, SF_DIR), oracle, text) == ""
