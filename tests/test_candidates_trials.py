import math

import pytest
from conftest import BOXES, rect
from pyspark.sql import functions as F

from shelfdate.operators import cascade as CA
from shelfdate.operators import evaluate as E
from shelfdate.operators.policies import best_pass
from shelfdate.operators.select import candidate_detail, candidate_rows


@pytest.fixture(scope="module")
def passes(spark):
    return spark.createDataFrame([
        ("a", "original_512", 0, "소비기한", .9, rect(0, 0, 100, 20)),
        ("a", "original_512", 1, "2027.05.06", .8, rect(0, 30, 100, 20)),
        ("a", "original_512", 2, "2027.05.06", .7, rect(0, 30, 100, 20)),
        ("a", "original_512", 3, "2026.01.02", .99, rect(0, 400, 100, 20)),
        ("a", "clahe", 0, "2027.05", .99, rect(0, 0, 100, 20)),
        ("a", "rotation_270", 0, "nothing", .9, rect(0, 0, 100, 20)),
        ("b", "clahe", 0, "EXP", .9, rect(0, 500, 100, 20)),
        ("b", "clahe", 1, "MFG", .9, rect(0, 0, 100, 20)),
        ("b", "clahe", 2, "2027.05.06", .9, rect(0, 30, 100, 20)),
        ("c", "clahe", 0, "lot 5", .9, [])], BOXES)


def test_detail_of_the_chosen_candidate(passes):
    got = {(r.image_id, r.stage): r for r in candidate_detail(passes).collect()}
    first = got["a", "original_512"]
    assert (first.final_date, first.source_text, first.confidence, first.anchor_preference, first.anchor_distance) == ("2027-05-06", "2027.05.06", .8, 2, 30.0)
    assert (first.valid_fields, first.complete, first.score, first.anchor_found) == (3, True, 13, True)
    part = got["a", "clahe"]
    assert (part.final_date, part.valid_fields, part.complete, part.anchor_preference, part.anchor_distance) == ("2027-05-NONE", 2, False, 0, None)
    assert got["b", "clahe"].anchor_preference == 1 and got["b", "clahe"].anchor_distance == 470.0
    for key in (("a", "rotation_270"), ("c", "clahe")):
        none = got[key]
        assert (none.has_candidate, none.final_date, none.confidence, none.valid_fields, none.complete, none.score) == (False, "NONE", 0.0, 0, False, None)


def test_candidates_are_listed_with_their_distances(passes):
    rows = {(r.image_id, r.stage, r.box_index): r for r in candidate_rows(passes).collect()}
    assert sorted(rows) == [("a", "clahe", 0), ("a", "original_512", 1), ("a", "original_512", 2), ("a", "original_512", 3), ("b", "clahe", 2)]
    assert rows["b", "clahe", 2].d_exclude == 30.0 and rows["a", "original_512", 3].d_anchor == 400.0 and rows["a", "clahe", 0].d_anchor is None


def test_best_pass_ranks_evidence_and_keeps_images_without_one(passes):
    best = {r.image_id: r for r in best_pass(candidate_detail(passes), {"clahe": 9, "original_512": 1}).collect()}
    assert (best["a"]["pass"], best["a"].passes, best["a"].passes_with_candidate) == ("original_512", 3, 2)
    assert best["b"]["pass"] == "clahe" and best["c"]["pass"] is None and best["c"].final_date == "NONE"


def stage_rows(spark):
    def row(image, stage, date, q, **e):
        return (image, stage, *date.split("-"), date, True, q, e.get("many", False), e.get("short", False), False, False, e.get("anchor", False), False, [date], e.get("s", 1.0))

    rows = [row("a", "original_512", "2027-01-02", .5, s=1.0), row("a", "highres_1024", "2027-01-03", .8, s=2.0), row("a", "clahe", "2027-01-03", .7, s=4.0),
            row("b", "original_512", "2027-01-02", .95, short=True, s=1.0), row("b", "highres_1024", "2027-01-02", .99, s=2.0),
            row("c", "rotation_270", "2027-03-04", .95), row("d", "original_512", "2027-01-02", .5)]
    return spark.createDataFrame(rows, "image_id string, stage string, year string, month string, day string, final_date string, has_candidate boolean, q double, many boolean, "
                                 "short boolean, bare boolean, damaged_day boolean, self_anchor boolean, self_exclude boolean, candidate_dates array<string>, seconds double")


def test_trials_in_one_pass_are_the_cascades_one_by_one(spark):
    stages = stage_rows(spark)
    every = CA.cascade_trials(stages)
    for name, order in CA.TRIALS.items():
        alone = sorted(map(tuple, CA.cascade(stages, order=order).select("image_id", "final_date", "method", "attempts", "missing_stage").collect()))
        beside = sorted(map(tuple, every.where(F.col("trial") == name).select("image_id", "final_date", "method", "attempts", "missing_stage").collect()))
        assert alone == beside, name
    assert every._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + every._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_comparison_counts_cost_and_unknown_images(spark):
    truth = spark.createDataFrame([("a", "2027-01-03", "x"), ("b", "2027-01-02", "x"), ("d", "2027-01-02", "x"), ("gone", "2027-01-02", "x")], "image_id string, final_date string, cohort string")
    wide = CA.trials_side_by_side(stage_rows(spark), {n: CA.TRIALS[n] for n in ("production", "no_short_retry")})
    got = {r.policy: r for r in E.compare_trials(wide, truth, "production", ["production", "no_short_retry"], project_to=8).collect()}
    one = got["no_short_retry"]
    assert (one.n, one.unknown, one.correct, one.gains, one.regressions) == (4, 2, 2, 0, 0)
    assert (one.calls, one.extra_calls, one.retry_images, one.micros, one.extra_micros) == (4, -1, 1, 8_000_000, -2_000_000)
    assert one.projected_seconds == 16.0
    assert E.trial_changes(wide, truth, "production", ["production", "no_short_retry"]).count() == 0


def test_sign_test_is_the_binomial_tail(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 3), (2, 9), (15, 40), (0, 60), (499_000, 501_000), (500_000, 500_000), (0, 1_000_000)]
    got = [r.p for r in spark.createDataFrame(pairs, "a long, b long").select(E.sign_test(F.col("a"), F.col("b")).alias("p")).collect()]
    for (a, b), p in zip(pairs, got, strict=True):
        n, low = a + b, min(a, b)
        if n < 1000:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
        else:
            terms = (math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(max(0, low - 40_000), low + 1))
            want = min(1.0, 2 * math.fsum(terms))
        assert p == pytest.approx(want, rel=1e-6, abs=1e-300), (a, b)


def test_labels_without_a_prediction_are_a_class_of_their_own(spark):
    rows = spark.createDataFrame([("x", "x", "x"), ("x", "y", "x"), (None, "x", "x"), (None, None, None)], "prediction string, label string, normalised string")
    assert {(r.raw, r.normalised): r.n for r in E.verdict_changes(rows).collect()} == {(True, True): 1, (False, True): 1, (None, None): 2}


def test_stage_oracle_counts_every_labelled_image(spark):
    truth = spark.createDataFrame([(i, "2025-01-02") for i in range(1, 6)], "image_id long, final_date string")
    stages = spark.createDataFrame([(1, "2025-01-02"), (2, "2025-01-02"), (2, "2024-01-02"), (3, "NONE"), (4, "2025-01-02"), (9, "2025-01-02")],
                                   "image_id long, final_date string")
    final = spark.createDataFrame([(1, "2025-01-02"), (2, "2024-01-02"), (3, "NONE"), (9, "2025-01-02")], "image_id long, final_date string")
    assert E.stage_oracle(stages, truth, final).collect()[0].asDict() == {"n": 5, "unknown": 2, "oracle": 3, "correct": 1, "missed_choice": 1}
