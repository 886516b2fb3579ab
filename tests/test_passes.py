from pyspark.sql import functions as F

from shelfdate.operators import passes as P

SCHEMA = "image_id string, stage string, final_date string, has_candidate boolean, boxes int, seconds double"
O, R, H, K = "original_512", "rotation_270", "highres_1024", "clahe"


def tables(spark):
    rows = [("a", O, "2027-01-02", True, 3, 1.0), ("a", R, "2027-09-09", True, 3, 9.0),
            ("b", O, "NONE", False, 0, 1.0), ("b", R, "2027-01-02", True, 2, 2.0),
            ("c", O, "NONE", False, 0, 1.0), ("c", R, "NONE", False, 0, 2.0), ("c", H, "NONE", False, 0, 4.0), ("c", K, None, None, None, None),
            ("d", O, "NONE", False, 0, 1.0), ("d", R, "NONE", False, 1, 2.0), ("d", H, "NONE", False, 0, 4.0), ("d", K, "NONE", False, 0, 8.0),
            ("e", O, "NONE", False, 2, 1.0), ("e", R, "NONE", False, 2, 1.0), ("f", R, "2027-01-02", True, 2, 1.0),
            ("g", O, "NONE", False, 2, 1.0), ("g", O, "NONE", False, 2, 1.0), ("g", R, "2027-05-05", True, 2, .5), ("g", "other", "2027-01-02", True, 2, 1.0)]
    truth = [(n, "2027-01-02") for n in "abdefgx"] + [("c", "NONE")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(truth, "image_id string, final_date string")


def test_the_first_pass_with_a_candidate_decides(spark):
    got = {r.image_id: r for r in P.fold_passes(*tables(spark)).collect()}
    assert {n: r.failure_stage for n, r in got.items()} == {
        "a": "success", "b": "success", "c": "success", "d": "ocr_boxes_no_date_candidate", "e": "unknown", "f": "unknown",
        "g": "parser_wrong_after_candidate", "x": "unknown"}
    assert [got[n].fallback_micros for n in "abcdg"] == [0, 2_000_000, 6_000_000, 14_000_000, 500_000]
    assert got["a"].attempts == [O] and got["g"].attempts == [O, R] and got["c"].method == "original_no_candidate"
    assert (got["e"].missing_stage, got["f"].missing_stage, got["x"].missing_stage, got["e"].final_date) == (H, O, O, None)


def test_orders_of_any_length(spark):
    passes, truth = tables(spark)
    one = {r.image_id: r for r in P.fold_passes(passes, truth, ("other",)).collect()}
    assert one["g"].method == "other" and one["a"].failure_stage == "unknown"
    long = P.fold_passes(passes.unionByName(passes.withColumn("stage", F.concat(F.col("stage"), F.lit("_2")))), truth, (O, R, H, K, K + "_2", H + "_2"))
    assert {r.image_id: len(r.attempts or []) for r in long.collect()}["d"] == 6


def test_no_boxes_at_all(spark):
    passes, truth = tables(spark)
    got = P.fold_passes(passes.withColumn("boxes", F.lit(0)), truth).where("image_id = 'd'").first()
    assert got.failure_stage == "ocr_no_boxes"


def test_pass_table_and_control(spark):
    passes, truth = tables(spark)
    table = {r.stage: (r.attempts, r.candidates, r.saves) for r in P.pass_table(P.fold_passes(passes, truth)).collect()}
    assert table == {O: (5, 1, 1), R: (4, 2, 1), H: (2, 0, 0), K: (2, 0, 0)}
    control = {r.image_id: (r.source, r.has_candidate, r.correct) for r in P.control(passes, truth).collect()}
    assert control["a"] == (O, True, True) and control["b"] == (R, True, True) and control["d"] == (O, False, False) and control["f"] == (None, None, None)
    assert control["c"] == (O, False, True) and control["e"] == (O, False, False)
    assert P.fold_passes(passes.limit(0), truth.limit(0)).count() == 0
