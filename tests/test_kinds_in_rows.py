"""Images that hold their boxes in a row are told apart there: kinds move and are kept, images are not."""
import pytest
from conftest import BOXES, rect
from pyspark.sql import functions as F
from test_parser import build

from shelfdate.operators import evaluate as E
from shelfdate.operators import spatial
from shelfdate.operators.alike import counted_kinds, kinds_of_images, parsed_kinds, tell
from shelfdate.operators.select import stage_results
from shelfdate.plans import catalogue

IMAGES = 2600


def told(rows):
    return sorted(map(str, rows.collect()))


def gathered(boxes):
    return boxes.groupBy("image_id").agg(F.collect_list(F.struct("stage", "box_index", "text", "confidence", "bbox")).alias("boxes"))


@pytest.fixture()
def folder(spark, tmp_path):
    """Line items of 13 cases and two dates, so of 26 kinds, in three cohorts."""
    n = F.col("id")
    rows = spark.range(0, IMAGES, 1, 4).select(
        n.alias("l_orderkey"), n.alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(5.0).alias("l_quantity"),
        F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.element_at(F.array(*map(F.lit, "ANR")), (n % 3 + 1).cast("int")).alias("l_returnflag"),
        F.when(n % 2 == 0, F.lit("1996-07-15")).otherwise("1997-03-20").cast("timestamp").alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.fixture()
def kept(monkeypatch):
    """Row counts of the tables that are kept."""
    counts, whole = [], spatial.cut

    def cut(df):
        df = whole(df)
        counts.append(df.count())
        return df
    monkeypatch.setattr(spatial, "cut", cut)
    return counts


def test_rows_are_told_as_boxes(spark):
    odd = spark.createDataFrame([
        ("far", "clahe", 7, "2026.07.15", 0.8, rect(1e9, 5, 30, 10)), ("near", "clahe", 9, "2026.07.15", 0.8, rect(2, 5, 30, 10)),
        ("nan", "clahe", 7, "EXP 2026.07.15", 0.8, rect(float("nan"), 5, 30, 10)), ("no index", "clahe", None, "2026.07.15", None, rect(3, 5, 30, 10)),
        ("no stage", None, 1, "2026.07.15", 0.8, rect(3, 5, 30, 10)), ("no box", "clahe", 1, "2026.07.15", 0.8, None)], BOXES)
    boxes = build(spark)[0].limit(60).unionByName(odd)
    boxes = boxes.unionByName(boxes.withColumn("image_id", F.concat(F.lit("again "), "image_id"))).persist()
    images = gathered(boxes).persist()
    counted = counted_kinds(images)
    assert counted.agg(F.sum("n")).first()[0] == images.count()
    assert counted.select("kind").distinct().count() == kinds_of_images(boxes).select("kind").distinct().count() < images.count()
    whole = stage_results(boxes)
    assert told(tell(images, counted, parsed_kinds(counted, stage_results)).select(*whole.columns)) == told(whole)


def test_images_whose_keys_agree_are_told_apart(spark):
    """The hash of a row passes over nulls, so these two have one key."""
    boxes = spark.createDataFrame([("a", "clahe", None, None, 0.8, None), ("b", None, None, "clahe", 0.8, None)], BOXES)
    images = gathered(boxes)
    counted = counted_kinds(images)
    assert counted.select("key").distinct().count() == 1 and counted.select("kind").distinct().count() == 2
    names = counted.select("kind", F.get("boxes", F.lit(0))["stage"].alias("stage"))
    assert told(tell(images, counted, names).select("image_id", "stage")) == told(boxes.select("image_id", "stage"))


def test_changes_move_no_row_per_image(spark, folder, kept):
    rows = catalogue.rule_variant_changes(spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join") == 1
    assert max(kept) < IMAGES / 2
    changed = rows.groupBy("policy", "kind").count().collect()
    assert changed and all(r["count"] % (IMAGES / 13) == 0 for r in changed)


def test_trials_are_compared_by_kind(spark, folder, kept):
    """Two dates of 13 cases in three cohorts are 78 rows; every cohort and policy counts all of its images."""
    rows = catalogue.rule_variant_trials(spark, folder).collect()
    assert max(kept) < IMAGES / 2
    truth = {c: IMAGES // 3 + (i < IMAGES % 3) for i, c in enumerate("ANR")}
    assert {(r["cohort"], r["n"]) for r in rows} == set(truth.items())
    assert all(r["gains"] == r["regressions"] == r["extra_calls"] == 0 for r in rows if r["policy"] == "baseline")
    assert {r["policy"] for r in rows if r["gains"]} and {r["policy"] for r in rows if r["regressions"]}


def test_a_row_of_the_truth_may_stand_for_several_images(spark):
    trial = "array<struct<trial:string,final_date:string,method:string,attempts:array<string>,missing_stage:string,micros:bigint>>"
    given = [("a", [("old", "x", "m", ["o"], None, 1), ("new", "y", "m", ["o", "h"], None, 2)]), ("b", [("old", None, None, None, "o", None), ("new", "y", "m", ["o"], None, 2)])]
    trials = spark.createDataFrame(given, f"kind string, trials {trial}")
    counted = spark.createDataFrame([("a", "1", "y", 3), ("a", "2", "x", 2), ("b", "1", "y", 4), ("none", "1", "y", 5)], "kind string, cohort string, final_date string, n bigint")
    each = counted.select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), "*").select(F.concat_ws("-", "kind", "cohort", "i").alias("image_id"), "kind", "cohort", "final_date")
    one_by_one = E.compare_trials(trials.join(each, "kind").select("image_id", "trials"), each, "old", ["old", "new"])
    assert told(E.compare_trials(trials, counted, "old", ["old", "new"], by="kind")) == told(one_by_one)
    calls = E.trial_stage_calls(trials, counted.select("kind", "n"))
    assert told(calls) == told(E.trial_stage_calls(trials.join(each, "kind").select("trials")))
