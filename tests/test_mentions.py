"""Dates of free text are counted without reading what cannot change their number."""
from conftest import BOXES
from test_parser import build

from shelfdate.operators.boxes import annotate, main_dates, measure


def test_main_dates_are_those_of_all_sources(spark):
    texts = ["", "no date", "2026.07.15 and 16 JUL 2027, EXP 08/2026", "2026,07.15 2026.07.15", "12345 " * 40, "260715까지", "202607", "28/09/2022 3.5.2026",
             "1 AUG 2026 1 A U G 2026 20 26.07.15", "１５.０７.２０２６", None]
    odd = spark.createDataFrame([(f"t{i}", "clahe", i, t, 0.9, [[0.0, 0.0], [1.0, 1.0]]) for i, t in enumerate(texts)] + [("no box", "clahe", 1, "2026.07.15", 0.9, None)], BOXES)
    boxes = measure(build(spark)[0].unionByName(odd))
    keys = ("image_id", "stage", "box_index")
    whole = annotate(boxes).selectExpr(*keys, "size(filter(tokens, t -> t.no < 100)) as n")
    found = main_dates(boxes, *keys)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert found.where("n > 0").count() > 5


def test_no_other_source_is_read(spark):
    """Fails where dates are counted among the tokens of all tiers: their patterns are then in the plan."""
    boxes = measure(build(spark)[0])
    plan = main_dates(boxes, "stage").groupBy("stage").sum("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]" not in plan and "까[" not in plan
