import pytest
from pyspark.sql import functions as F
from test_candidates_trials import stage_rows

from shelfdate.operators import shadow as S


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "image_id string")


def official(spark, *rows):
    return spark.createDataFrame(list(rows), "image_id string, method string")


def test_membership_of_three_lists(spark):
    o = "original_512"
    members = S.cohort_membership(official(spark, ("a", o), ("b", "clahe"), ("c", o), ("d", o), ("d", o), ("e", o), ("f", o), (None, o), ("g", None)),
                                  ids(spark, "c", "e", "x"), ids(spark, "f", "e", "y", "y"))
    assert {r.image_id: r.membership for r in members.collect()} == {
        "a": "primary", "b": "later_stop", "c": "excluded_failure", "d": "duplicate", "e": "overlap", "f": "excluded_control",
        "x": "not_official", "y": "duplicate", None: "primary", "g": "later_stop"}
    assert sorted(r.image_id for r in S.membership_issues(members).collect()) == ["d", "e", "y"]


def run(spark):
    stages = stage_rows(spark).unionByName(stage_rows(spark).where("image_id = 'a' and stage = 'highres_1024'").withColumns(
        {"stage": F.lit("rotation_270"), "q": F.lit(0.4), "seconds": F.lit(3.0)}))
    members = spark.createDataFrame([(n, "primary") for n in "abdz"] + [("c", "overlap")], "image_id string, membership string")
    truth = spark.createDataFrame([(n, "2027-01-03") for n in "abcdz"], "image_id string, final_date string")
    return S.shadow_rows(stages, members, truth)


def test_shadow_run(spark):
    rows = {r.image_id: r for r in run(spark).collect()}
    assert sorted(rows) == ["a", "b", "d", "z"]
    a = rows["a"]
    assert (a.triggered, a.selected_stage, a.shadow, a.category, a.original_micros, a.retry_micros) == (True, "highres_1024", "2027-01-03", "recovery", 1_000_000, 5_000_000)
    assert (rows["b"].triggered, rows["b"].category, len(rows["b"].attempts)) == (False, "unchanged_wrong", 1)
    assert rows["d"].category == rows["z"].category == "unknown" and rows["d"].attempts == []     # triggered without retries; no stage at all
    one = S.shadow_summary(run(spark), project_to=8).first()
    assert (one.n, one.baseline_correct, one.shadow_correct, one.recovery, one.unknown, one.attempts) == (4, 0, 1, 1, 2, 4)
    assert (one.triggered_wrong, one.net_correct, one.projected_triggers, one.projected_retries, one.projected_retry_seconds) == (1, 1, 2.0, 4.0, 10.0)


@pytest.mark.parametrize("change, said", [({"shadow_correct": "false"}, "is not shadow"), ({"category": "'other'"}, "add up"),
                                          ({"attempts": "array('x', 'y')"}, "triggers")])
def test_a_broken_sum_gives_no_row(spark, change, said):
    with pytest.raises(Exception, match=said):
        S.shadow_summary(run(spark).withColumns({n: F.expr(e) for n, e in change.items()})).collect()


def test_empty_cohort(spark):
    one = S.shadow_summary(run(spark).where("false")).first()
    assert (one.n, one.attempts, one.projected_triggers) == (0, 0, None)
