"""Readers and writers.  Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import completeness_gap, duplicates, require_empty, same_rows
from ..rules import constants as C

DETECTION = "struct<text:string,confidence:double,bbox:array<array<double>>>"
STAGE_RECORD = (f"image_id string, stage string, run_id string, detections array<{DETECTION}>, "
                "decode_sec double, prepare_sec double, ocr_sec double, stage_sec double, record_sha256 string")
IMAGE_RECORD = (f"image_id string, extra_seconds double, stages array<struct<stage:string,seconds:double,"
                f"detections:array<{DETECTION}>>>")
LABEL_COLUMNS = ("image_id", "year", "month", "day", "final_date")
IMAGE_FILES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image_id) of the images directly in a folder; contents are not read.

    Refuses an empty folder and two files with one stem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_FILES).load(folder)
    listed = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id"))
    if listed.isEmpty():
        raise ValueError(f"no images in {folder}")
    require_empty(duplicates(listed, ["image_id"]), "duplicate image stem")
    return listed


def stage_records(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines, one record per (image, stage)."""
    return spark.read.schema(STAGE_RECORD).option("mode", mode).json(path)


def image_records(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines, one record per image with its stages nested; one row per (image, stage)."""
    nested = spark.read.schema(IMAGE_RECORD).option("mode", mode).json(path)
    return nested.select("image_id", F.inline("stages"))


def to_boxes(records: DataFrame, *keep: str) -> DataFrame:
    """One row per detection, ``box_index`` in list order; stages without any keep no row."""
    return records.select("image_id", "stage", *keep, F.posexplode("detections").alias("box_index", "d")).select(
        "image_id", "stage", *keep, "box_index", "d.text", "d.confidence", "d.bbox")


def box_table(records: DataFrame, *keep: str) -> DataFrame:
    """The flat box table for storage: empty stages keep one row, polygons become JSON."""
    return records.select("image_id", "stage", *keep, F.posexplode_outer("detections").alias("box_index", "d")).select(
        "image_id", "stage", *keep, "box_index", "d.text", "d.confidence", F.to_json("d.bbox").alias("bbox"))


def strict_detections(texts: Column, scores: Column, polygons: Column) -> Column:
    """Parallel arrays to detections; arrays of different length are an error."""
    same = (F.size(texts) == F.size(scores)) & (F.size(texts) == F.size(polygons))
    zipped = F.transform(F.arrays_zip(texts.alias("a"), scores.alias("b"), polygons.alias("c")),
                         lambda z: F.struct(z["a"].alias("text"), z["b"].alias("confidence"), z["c"].alias("bbox")))
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("recognizer arrays differ in length")).cast(f"array<{DETECTION}>"))


def lenient_detections(texts: Column, scores: Column, polygons: Column) -> Column:
    """As above with missing scores as 0.0 and missing polygons empty."""
    return F.transform(texts, lambda t, i: F.struct(
        t.alias("text"), F.coalesce(F.get(scores, i), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.get(polygons, i), F.array().cast("array<array<double>>")).alias("bbox")))


def label_csv(spark: SparkSession, path: str, required=LABEL_COLUMNS, multi_line: bool = False) -> DataFrame:
    """All-text label file or files; a byte-order mark, missing or repeated headers and ragged rows are checked.

    The header names are read as CSV, so they may be quoted. Every file must have the same ones in the same order:
    the reader compares each file's header with the schema and stops where they differ. multi_line: values may hold
    line breaks.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"empty label file {path}")
    written = next(csv.reader([first[0]]))
    names = [n.strip().lstrip("\ufeff") for n in written]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated header in {path}: {names}")
    missing = [n for n in required if n not in names]
    if missing:
        raise ValueError(f"missing columns in {path}: {missing}")
    schema = ", ".join(f"`{n or f'_c{i}'}` string" for i, n in enumerate(names)) + ", `_bad` string"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", multi_line).option(
        "columnNameOfCorruptRecord", "_bad").csv(path)


def sound_labels(labels: DataFrame) -> DataFrame:
    """Label rows after the gate that none is ragged."""
    require_empty(labels.where("_bad is not null"), "ragged label row")
    return labels.drop("_bad")


def pass_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pass results with detections embedded as JSON text."""
    schema = "image_id string, stage string, final_date string, seconds double, detections_json string"
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option(
        "quote", '"').option("escape", '"').csv(path)
    return rows.withColumn("detections", F.from_json("detections_json", f"array<{DETECTION}>")).drop("detections_json")


# -- sinks ---------------------------------------------------------------------

def write_submission(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The five output columns in order; the commit protocol makes the write atomic. Refuses rows with a missing
    value, which results of unknown images are."""
    lacking = F.lit(False)
    for c in C.DATE_COLUMNS:
        lacking = lacking | F.col(c).isNull()
    require_empty(results.where(lacking), "result without a value")
    results.select(*C.DATE_COLUMNS).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_bom_csv(results: DataFrame, path: str) -> None:
    """The five columns as CSV whose every part starts with a UTF-8 byte-order mark.

    The mark is part of the first header name, so the parts are written in parallel as usual.
    """
    first, *rest = C.DATE_COLUMNS
    results.select(F.col(first).alias("﻿" + first), *rest).write.option("header", True).csv(path)


def write_evaluation(scored: DataFrame, evaluation: str, failures: str) -> None:
    scored.write.mode("errorifexists").parquet(evaluation)
    scored.where(~F.col("final_date_correct")).write.mode("errorifexists").parquet(failures)


def write_dump(records: DataFrame, images: DataFrame, stages: list[str], path: str) -> DataFrame:
    """Consolidate stage records: complete, unique, written once, read back equal."""
    require_empty(completeness_gap(images, stages, records), "missing stage record")
    require_empty(duplicates(records), "duplicate stage record")
    ordered = records.repartitionByRange("image_id").sortWithinPartitions("image_id", "stage")
    ordered.write.mode("errorifexists").parquet(path)
    back = records.sparkSession.read.parquet(path)
    require_empty(same_rows(back, records.select(*back.columns)), "dump differs from its source")
    return back


def todo(plan: DataFrame, log: DataFrame, keys=("image_id", "stage")) -> DataFrame:
    """Planned work that an append-only log does not hold yet."""
    return plan.join(log.select(*keys).distinct(), list(keys), "left_anti")


def resume_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of an append-only JSON log; a torn last line is left out."""
    schema = STAGE_RECORD + ", _torn string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_torn").json(path)
    return rows.where(F.col("_torn").isNull() & F.col("image_id").isNotNull()).drop("_torn")


def write_review(source: DataFrame, review: DataFrame, summary: DataFrame, folder: str) -> None:
    """Three review tables side by side; an existing one is never overwritten."""
    for name, df in (("source_records", source), ("label_review", review), ("audit_summary", summary)):
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
