"""Trials of an image that cannot differ are decided once."""
from test_candidates_trials import stage_rows
from test_crowded import as_rows

from shelfdate.operators.cascade import TRIALS, _decided_trials, cascade_trials, trials_side_by_side
from shelfdate.rules import PRODUCTION


def test_trials_that_cannot_differ_are_decided_once(spark):
    rows = stage_rows(spark)
    decided = _decided_trials(rows, TRIALS, PRODUCTION)
    images = rows.select("image_id").distinct().count()
    assert decided.count() < images * len(TRIALS)
    named = trials_side_by_side(rows).selectExpr("image_id", "inline(trials)")
    assert as_rows(named) == as_rows(cascade_trials(rows).select(*named.columns))
    assert named.groupBy("image_id").count().where(f"count <> {len(TRIALS)}").isEmpty()
