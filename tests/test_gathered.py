"""The boxes of an image are decided in one row."""
from conftest import BOXES, rect
from test_crowded import as_rows, crowd

from shelfdate.operators.select import candidate_detail, candidate_rows, stage_results


def test_no_box_is_copied_from_window_to_window(spark):
    boxes = crowd(spark, 20)
    for told in (stage_results, candidate_detail, candidate_rows):
        plan = told(boxes, crowded=False)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_candidates_are_those_of_the_rows(spark):
    odd = [("odd", "clahe", i, text, .9, rect(0, 30 * i, 80, 20)) for i, text in enumerate(
        ["MFG 2026.01.02", "EXP 2027.01.02", "EXP 2027.01.02", "08/09/2028", "제조일로부터 6개월", "2027.03"])]
    odd += [("none", "clahe", 0, "no date", .9, rect(0, 0, 9, 9)), ("blank", "clahe", 0, None, None, rect(0, 0, 9, 9))]
    boxes = crowd(spark, 60).where("box_index < 60").unionByName(spark.createDataFrame(odd, BOXES)).persist()
    assert as_rows(candidate_rows(boxes, crowded=False)) == as_rows(candidate_rows(boxes, max_group_boxes=0))
