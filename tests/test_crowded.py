import random

from conftest import BOXES, rect
from test_parser import build

from shelfdate.operators import spatial
from shelfdate.operators.select import stage_results

WORDS = ["EXP", "소비기한", "MFG", "유통기한", "2027", "15", "lot 7", "EXP:"]


def crowd(spark, n=600):
    """One image with many boxes, copies included, and one ordinary image."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        text = rng.choice(WORDS) if rng.random() < .5 else f"{rng.choice(['', 'EXP ', 'MFG '])}20{rng.randint(24, 29)}.0{rng.randint(1, 9)}" + (
            f".{rng.randint(10, 28)}" if rng.random() < .6 else "")
        rows.append(("big", "clahe", i, text, rng.choice([.8, .9, .95]),
                     rect(rng.randint(0, 900), rng.randint(0, 900), rng.choice([20, 60, 100]), 20)))
    rows += [("big", "clahe", n + i, "2028.05.11", .97, rect(5, 5, 80, 20)) for i in range(100)]
    rows += [("small", "clahe", 0, "EXP 2027.01.02", .9, rect(0, 0, 80, 20))]
    return spark.createDataFrame(rows, BOXES)


def as_rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_crowded_images_give_the_same_results(spark):
    boxes = crowd(spark)
    # the same rows by window and by aggregate-and-join, on a crowd and on every golden case
    golden = build(spark)[0].selectExpr("concat('g', image_id) image_id", "stage", "box_index", "text", "confidence", "bbox")
    every = boxes.unionByName(golden).persist()
    together = as_rows(stage_results(every, crowded=False))
    spread = as_rows(stage_results(every, max_group_boxes=0))
    assert together == spread


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    points = [("a", rng.uniform(0, 50), rng.uniform(0, 900)) for _ in range(400)] + [("a", 10.0, 10.0)] * 50
    probes = [("a", rng.uniform(-20, 90), rng.uniform(0, 900)) for _ in range(60)]
    schema = "image_id string, cx double, cy double"
    found = spatial.nearest(spark.createDataFrame(probes, schema), spark.createDataFrame(points, schema), ["image_id"])
    got = {(r.cx, r.cy): r.d for r in found.collect()}
    for _, x, y in probes:
        want = min(((x - a) ** 2 + (y - b) ** 2) ** .5 for _, a, b in points)
        assert abs(got[(x, y)] - want) < 1e-9


def test_crowd_beyond_the_limit_with_one_far_box(spark):
    """More boxes than the limit, most in one corner and one far away: the same rows as by window."""
    rng = random.Random(9)
    rows = [("big", "clahe", i, rng.choice(WORDS) if i % 3 else f"20{24 + i % 6}.0{1 + i % 9}.{10 + i % 18}", .9,
             rect(rng.randint(0, 300), rng.randint(0, 300), 60, 20)) for i in range(4300)]
    rows.append(("big", "clahe", 5000, "EXP", .9, rect(1e12, -1e12, 60, 20)))
    boxes = spark.createDataFrame(rows, BOXES).persist()
    assert as_rows(stage_results(boxes)) == as_rows(stage_results(boxes, crowded=False))


def test_ranks_split_points_that_share_one_spot_of_a_fixed_grid(spark):
    points = [("a", 1e-9 * i, 0.0) for i in range(2000)] + [("a", 1e15, 1e15)]
    schema = "image_id string, px double, py double"
    gridded, depth = spatial._gridded(spark.createDataFrame(points, schema), ["image_id"])
    assert depth >= 11 and gridded.selectExpr("max(i)").first()[0] == 2000
    widest = spatial._cells(gridded, ["image_id"], 6, depth).selectExpr("max(points)").first()[0]
    assert widest <= 64


def test_exchange_moves_no_text_of_undated_boxes(spark):
    boxes = spark.createDataFrame([("a", "clahe", 0, "no date here", .9, rect(0, 0, 9, 9)), ("a", "clahe", 1, "2027.01.02", .9, rect(0, 0, 9, 9))], BOXES)
    from shelfdate.operators.boxes import annotate, measure
    from shelfdate.operators.groups import slim
    assert [r.text for r in slim(annotate(measure(boxes))).orderBy("box_index").collect()] == [None, "2027.01.02"]
    plan = stage_results(boxes, crowded=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 1


def test_texts_read_once_give_the_same_results(spark):
    # repeated texts read once and joined, or every box by itself; on both paths, and under several rule sets beside each other
    from shelfdate.operators.select import candidate_detail, candidate_rows
    from shelfdate.plans.replay import variants_side_by_side
    golden = build(spark)[0]
    boxes = crowd(spark).unionByName(golden.selectExpr("concat('g', image_id) image_id", "stage", "box_index", "text", "confidence", "bbox")).persist()
    for told in (stage_results, candidate_rows, candidate_detail):
        assert as_rows(told(boxes, share_texts=True)) == as_rows(told(boxes, share_texts=False))
    assert as_rows(stage_results(boxes, share_texts=True, max_group_boxes=0)) == as_rows(stage_results(boxes, share_texts=False))
    lanes = [as_rows(variants_side_by_side(golden, ["baseline", "no_six"], share_texts=s).selectExpr("image_id", "array_sort(trials)")) for s in (True, False)]
    assert lanes[0] == lanes[1]


def test_a_repeated_text_is_read_once(spark, monkeypatch):
    # what the boxes exchange does not hold tokens where texts repeat: the tables of texts and boxes meet after it
    boxes = crowd(spark).unionByName(crowd(spark).selectExpr("concat('x', image_id) image_id", "stage", "box_index", "text", "confidence", "bbox"))
    plan = stage_results(boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "rightHint=(strategy=broadcast)" in plan
