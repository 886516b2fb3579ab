"""Images with equal boxes are parsed once, with the rows of parsing each."""
import os

import pytest
from conftest import BOXES, rect
from pyspark.sql import functions as F
from test_parser import build

from shelfdate.operators import alike
from shelfdate.operators.select import stage_results
from shelfdate.plans import catalogue
from shelfdate.plans.replay import parser_ablation, variants_side_by_side

FOLDER = "/root/testdata/sf0.001"


def told(rows):
    return sorted(map(str, rows.collect()))


@pytest.mark.parametrize("few", [True, False])
def test_sharing_changes_no_row(spark, monkeypatch, few):
    monkeypatch.setattr(alike, "MAX_SHARED_KINDS", 1000 if few else 0)
    boxes = build(spark)[0]
    odd = spark.createDataFrame([
        ("far", "clahe", 7, "2026.07.15", 0.8, rect(1e9, 5, 30, 10)), ("nan", "clahe", 7, "EXP 2026.07.15", 0.8, rect(float("nan"), 5, 30, 10)),
        ("inf", "clahe", 7, "MFG 2026.07.15", None, rect(float("inf"), 5, 30, 10)), ("flat", "clahe", 7, "2026.07", 0.8, rect(3, 5, 0, 10)),
        ("no index", "clahe", None, "2026.07.15", 0.8, rect(3, 5, 30, 10)), ("no index, no date", "clahe", None, "x", 0.8, rect(3, 5, 30, 10)),
        (None, "clahe", 1, "07.15", 0.8, rect(3, 5, 30, 10)), ("no stage", None, 1, "까지 260715", 0.8, rect(3, 5, 30, 10)), ("no box", "clahe", 1, "2026.07.15", 0.8, None)], BOXES)
    boxes = boxes.unionByName(odd)
    boxes = boxes.unionByName(boxes.withColumn("image_id", F.concat(F.lit("again "), "image_id"))).persist()
    assert told(alike.once_per_kind(boxes, stage_results)) == told(stage_results(boxes))
    assert told(alike.once_per_kind(boxes, stage_results, max_group_boxes=1)) == told(stage_results(boxes, max_group_boxes=1))


def test_variants_and_ablation_parse_a_kind_once(spark):
    """Fails where every image is parsed: the same label at other places, one box each, is one kind."""
    boxes = spark.createDataFrame([(f"i{n}", "original_512", n, "EXP 2026.07.15", 0.9, rect(n, 3 * n, 30, 10)) for n in range(50)], BOXES)
    assert alike.kinds_of_images(boxes).select("kind").distinct().count() == 1
    seen = []

    def run(part, **options):
        seen.append(part.count())
        return stage_results(part, **options)
    assert alike.once_per_kind(boxes, run).count() == 50 and seen == [1]
    assert parser_ablation(boxes, ["baseline", "no_six"]).count() == 100
    assert variants_side_by_side(boxes, ["baseline", "no_six"]).count() == 50


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_format_hints_are_read_once_per_kind(spark, monkeypatch):
    seen, whole = [], catalogue.stage_results

    def run(part, **options):
        seen.append(part.select("image_id").distinct().count())
        return whole(part, **options)
    monkeypatch.setattr(catalogue, "stage_results", run)
    assert catalogue.format_hint_per_image(spark, FOLDER).count() > seen[0]
