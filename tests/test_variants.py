import pytest
from pyspark.sql import functions as F
from test_parser import build

from shelfdate.operators import evaluate as E
from shelfdate.operators.boxes import annotate_lanes, measure
from shelfdate.plans.replay import ablation, variants_side_by_side
from shelfdate.rules import EARLIER, PRODUCTION, variant
from shelfdate.rules.ruleset import VARIANTS, split

NAMES = ["baseline", "year_month_word+mixed_comma", "printed_period_base", "no_six+retry_partial"]


def every(rows):
    return sorted(map(str, rows.select("variant", "image_id", "final_date", "method", "attempts", "missing_stage").collect()))


def test_variants_beside_each_other_are_the_variants_one_by_one(spark):
    boxes = build(spark)[0].persist()
    beside = variants_side_by_side(boxes, NAMES)
    flat = beside.select("image_id", F.explode("trials").alias("t")).select("image_id", F.col("t.trial").alias("variant"), "t.*")
    assert every(flat) == every(ablation(boxes, NAMES))


def test_crowded_images_take_the_same_variants(spark):
    boxes = build(spark)[0].limit(40).persist()
    def told(**options):
        rows = variants_side_by_side(boxes, NAMES[2:], **options)
        return sorted(map(str, rows.select("image_id", F.array_sort(F.transform("trials", lambda t: F.struct(t["trial"], t["final_date"], t["method"])))).collect()))
    assert told(crowded=False) == told(max_group_boxes=0)


def test_a_rule_set_splits_and_variants_share_lanes():
    parts = [split(variant(EARLIER, n)) for n in VARIANTS]
    assert len({reading for reading, _, _ in parts}) == 5 and len({p for _, p, _ in parts}) == 3
    assert split(PRODUCTION) == (PRODUCTION, "computed", PRODUCTION)


def test_lanes_need_one_year_window(spark):
    from dataclasses import replace
    boxes = spark.createDataFrame([], "image_id string, stage string, box_index int, text string, confidence double, bbox array<array<double>>")
    with pytest.raises(ValueError):
        annotate_lanes(measure(boxes), [PRODUCTION, replace(PRODUCTION, year_min=2000)])
    assert variants_side_by_side(boxes, NAMES).count() == 0


def test_kinds_of_changes(spark):
    rows = spark.createDataFrame([("a", "b", "b"), ("b", "a", "b"), ("a", "c", "b"), (None, "b", "b"), ("a", "b", None)], "old string, new string, truth string")
    got = [r.k for r in rows.select(E.change_kind(F.col("old"), F.col("new"), F.col("truth")).alias("k")).collect()]
    assert got == ["gain", "regression", "changed_wrong", "unknown", "unknown"]
