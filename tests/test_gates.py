"""Gates and readers on rows that must not pass."""

import pytest

from shelfdate.operators.cascade import stages_side_by_side
from shelfdate.operators.quality import submission_violations, table_digest
from shelfdate.operators.review import audit_records, review_images
from shelfdate.sources import io

DATES = "image_id string, year string, month string, day string, final_date string"


def test_missing_values_break_their_rules(spark):
    rows = [("1", None, "01", "02", "2026-01-02"), ("2", "2026", None, None, None), (None, "2026", "01", "02", "2026-01-02"),
            ("4", "2026", "01", "02", "2026-01-02"), ("5\n", "2026", "01", "02", "2026-01-02")]
    found = {(r.image_id, r.rule) for r in submission_violations(spark.createDataFrame(rows, DATES)).collect()}
    assert found == {("1", "year"), ("1", "final_date"), ("2", "month"), ("2", "day"), ("2", "final_date"),
                     (None, "blank_id"), (None, "id_characters"), ("5\n", "id_characters")}


def test_submission_writer_refuses_missing_values(spark, tmp_path):
    with pytest.raises(ValueError, match="without a value"):
        io.write_submission(spark.createDataFrame([("1", None, "01", "02", None)], DATES), str(tmp_path / "out"))


def test_label_records_keep_odd_ids(spark):
    rows = [("7", "a", "2026", "01", "02", "2026-01-02"), ("x7", "a", "2026", "01", "02", "2026-01-02"), (None, "a", "2026", "01", "02", "2026-01-02")]
    records = spark.createDataFrame(rows, "image_id string, source string, year string, month string, day string, final_date string")
    found = {r.image_id: r for r in review_images(audit_records(records)).collect()}
    assert sorted(found) == ["", "7", "x7"] and found["7"].review_reason == ""
    assert "invalid_image_id" in found["x7"].review_reason and found["x7"].review_status == "pending"


def test_label_files_with_other_headers_are_refused(spark, tmp_path):
    head = ["file_name", "image_id", "year", "month", "day", "final_date", "notes"]
    names = [n for n in head if n in io.LABEL_COLUMNS] + [n for n in io.LABEL_COLUMNS if n not in head]
    one, other = tmp_path / "one", tmp_path / "both"
    for folder in (one, other):
        folder.mkdir()
        (folder / "a.csv").write_text("\ufeff" + ",".join(names) + ',"note, long"\n' + ",".join(f"v{i}" for i in range(len(names))) + ",n\n", encoding="utf-8")
    (other / "b.csv").write_text(",".join(reversed(names)) + ',"note, long"\n' + ",".join(f"v{i}" for i in range(len(names))) + ",n\n")
    row = io.label_csv(spark, str(one)).first()
    assert [row[n] for n in names] == [f"v{i}" for i in range(len(names))] and row["note, long"] == "n"
    with pytest.raises(Exception, match="(?i)header"):
        io.label_csv(spark, str(other)).collect()


def test_repeated_stage_rows_give_the_same_row_each_time(spark):
    rows = [("1", "original_512", f"2026-01-{d:02}") for d in (9, 3, 5)]
    for order in (rows, rows[::-1]):
        got = stages_side_by_side(spark.createDataFrame(order, "image_id string, stage string, final_date string"), fields=("final_date",)).first()
        assert got["original_512"]["final_date"] == "2026-01-03"


def test_table_digest_sees_every_value_and_no_order(spark):
    rows = [(i, f"v{i}") for i in range(50)]
    digest = [table_digest(spark.createDataFrame(r, "a int, b string").repartition(3), ["a", "b"]).first() for r in (rows, rows[::-1], rows[1:] + [(0, "w")])]
    assert digest[0] == digest[1] != digest[2]
