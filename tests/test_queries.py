"""Queries against their SQL counterparts on the smallest tables (all of them: check_oracles.py)."""
import os

import pytest
from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
LIGHT = ["select_expiry_per_image", "manufacture_rerank", "adjacent_day_join", "cascade_production",
         "cascade_first_candidate", "policy_grid", "outcome_categories", "best_pass_per_image",
         "accuracy_by_truth_group", "early_stop_oracle", "late_date_errors", "stage_timing_profile", "speed_gate",
         "wilson_by_source", "snapshot_diff", "truth_normalise", "submission_violations", "completeness_gap",
         "record_checksums", "detection_validation", "keyword_crop_window"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_sql(spark, name):
    message, same = compare(spark, connect(FOLDER), FOLDER, name)
    assert same, message
