import json

from conftest import rect

from shelfdate.operators.quantiles import exclusive_quantile
from shelfdate.sources import io
from shelfdate.streaming.ingest import arriving_records, ingest, parse_arrivals, stage_counts


def record(image, stage, text):
    return json.dumps({"image_id": image, "stage": stage, "run_id": "r", "arrived": "2027-01-01T00:00:00",
                       "detections": [{"text": text, "confidence": .9, "bbox": rect(0, 0, 100, 20)}]})


def test_ingest_resumes_without_duplicates(spark, tmp_path):
    inbox, table, parsed, marks = (tmp_path / n for n in ("in", "table", "parsed", "marks"))
    inbox.mkdir()
    (inbox / "a.json").write_text(record("1", "clahe", "2027.01.02") + "\n" + record("1", "clahe", "2027.01.02"))
    for step in range(2):
        ingest(arriving_records(spark, str(inbox), lateness=None), str(table), str(marks / "i")).awaitTermination()
        parse_arrivals(arriving_records(spark, str(inbox), lateness=None), str(parsed), str(marks / "p")).awaitTermination()
        (inbox / "b.json").write_text(record("1", "clahe", "2028.01.02") + "\n" + record("2", "clahe", "EXP 2028.05.06"))
    assert spark.read.parquet(str(table)).count() == 2
    found = {r.image_id: r.final_date for r in spark.read.parquet(str(parsed)).collect()}
    assert found == {"1": "2027-01-02", "2": "2028-05-06"}


def test_readers(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text(record("1", "clahe", "x") + "\n" + record("2", "clahe", "y") + "\n" + '{"image_id": "3", "sta')
    done = io.resume_log(spark, str(log))
    assert sorted(r.image_id for r in done.select("image_id").collect()) == ["1", "2"]
    labels = tmp_path / "labels.csv"
    labels.write_text("﻿image_id,year,month,day,final_date\n1,2027,01,02,2027-01-02\n", encoding="utf-8")
    rows = io.sound_labels(io.label_csv(spark, str(labels))).collect()
    assert rows[0].image_id == "1" and rows[0].final_date == "2027-01-02"
    nested = tmp_path / "images.json"
    nested.write_text(json.dumps({"image_id": "9", "stages": [{"stage": "clahe", "seconds": 1.0, "detections": [
        {"text": "a", "confidence": .5, "bbox": []}, {"text": "b", "confidence": .6, "bbox": []}]}]}))
    boxes = io.to_boxes(io.image_records(spark, str(nested))).collect()
    assert [(b.box_index, b.text) for b in boxes] == [(0, "a"), (1, "b")]


def test_exact_quantile(spark):
    import statistics
    values = [((i * 7919) % 5003) / 10 for i in range(4000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = exclusive_quantile(df, "g", "v", 0.9).first()["quantile"]
    assert abs(got - statistics.quantiles(values, n=10)[8]) < 1e-9


def test_file_drift(spark, tmp_path):
    from shelfdate.operators.quality import file_digests, file_drift
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a").write_text("1")
    (folder / "b").write_text("2")
    before = spark.createDataFrame(file_digests(spark, str(folder)).collect())
    (folder / "b").write_text("3")
    changed = file_drift(before, file_digests(spark, str(folder))).collect()
    assert [r.path.rsplit("/", 1)[1] for r in changed] == ["b"]


def test_running_counts_and_bounded_state(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(record(str(i), s, "x") for i in range(3) for s in ("clahe", "rotation_270") if i or s == "clahe"))
    seen = stage_counts(arriving_records(spark, str(inbox), lateness="1 hour"))
    query = seen.writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.stage: r.n for r in spark.table("counted").collect()} == {"clahe": 3, "rotation_270": 2}
