"""Registered queries against their oracle SQL; BOXLENS_ALL_QUERIES=1 runs every one (about a quarter of an hour)."""

import os

import pytest

import __spark_entry__ as entry
from tests import harness

SF = "/root/testdata/sf0.001"
# one or two of every plan module, quick ones
QUICK = (
    "operating_point", "greedy_match_dense", "average_precision", "froc_curve", "holm_adjust", "percentile_ci", "permutation_p_value", "cluster_bootstrap_weights",
    "group_split", "group_subsample", "scan_csv_required", "scan_coco", "scan_split_manifests", "sink_yolo_labels", "audit_input_counts", "corrupt_brightness",
    "case_ranks", "check_factorial_grid", "early_stopping", "epoch_log_ingest", "training_curve_summary", "scan_training_curve", "latency_summary",
)
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("BOXLENS_ALL_QUERIES") else [q for q in QUICK if q in ORACLES]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, name):
    assert harness.compare(entry.queries()[name](spark, SF), ORACLES[name], SF) == []
