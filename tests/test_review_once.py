"""Label records are audited once for their images."""
from pyspark.sql import functions as F

from shelfdate.operators import review as R

RECORDS = "image_id string, source string, year string, month string, day string, final_date string"
ROWS = [("1", "a", "2026", "03", "04", "2026-03-04"), ("01", "b", "2026", "04", "03", "2026-04-03"), ("2", "a", "2026", "03", "04", "2026-03-04"),
        ("2", "a", "2026", "03", "04", "2026-03-04"), ("3", None, "2026", "5", "05", "2026-05-05"), ("3", None, "2026", "05", "05", "2026-05-05"),
        ("x", "a", "none", "none", "none", "NONE"), (None, "b", "2026", "xx", "1", None), ("4", "a", "2026", "03", "04", "2026-03-04"), ("4", "b", "2026", "03", "05", "2026-03-05")]


def test_images_of_records(spark):
    found = R.review_images(R.audit_records(spark.createDataFrame(ROWS, RECORDS)))
    got = {r.image_id: (r.n_sources, r.n_records, r.candidate_final_date, r.review_reason) for r in found.collect()}
    assert got == {"1": (2, 2, "", "ambiguous_date_order;label_conflict"), "2": (1, 2, "2026-03-04", "duplicate_source_id"),
                   "3": (1, 2, "2026-05-05", "duplicate_source_id"), "x": (1, 1, "NONE", "all_none;invalid_image_id"),
                   "": (1, 1, "", "invalid_component;invalid_image_id"), "4": (2, 2, "", "label_conflict")}


def test_records_are_scanned_once(spark, tmp_path):
    """Fails where sources, pairs and reasons of an image each audit all records for themselves."""
    path = str(tmp_path / "records")
    spark.createDataFrame(ROWS, RECORDS).write.parquet(path)
    images = R.review_images(R.audit_records(spark.read.parquet(path).withColumn("year", F.upper("year"))))
    assert images._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert R.review_summary(images)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_summary_of_images(spark):
    def summary(rows):
        return sorted(map(tuple, R.review_summary(R.review_images(R.audit_records(spark.createDataFrame(rows, RECORDS)))).collect()))
    assert summary([]) == [("total", "cross_source_overlap", 0), ("total", "source_rows", None), ("total", "unique_images", 0)]
    assert summary(ROWS[:4]) == [("reason", "ambiguous_date_order", 1), ("reason", "duplicate_source_id", 1), ("reason", "label_conflict", 1),
                                 ("status", "pending", 2), ("total", "cross_source_overlap", 1), ("total", "source_rows", 4), ("total", "unique_images", 2)]
