"""Integrity: submission rules, record validation, completeness, checksums, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import join_date
from ..rules import constants as C


def submission_violations(rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(rule, image_id, n) for every broken rule; raises when the columns are not the five.

    A missing value breaks the rule of its column and that of the final date it belongs to.
    """
    if tuple(rows.columns) != C.DATE_COLUMNS:
        raise ValueError(f"expected columns {C.DATE_COLUMNS}, found {tuple(rows.columns)}")
    blank = F.trim("image_id") == ""  # null counts as blank
    checks = {
        "blank_id": blank,
        "id_characters": ~F.col("image_id").rlike(r"\A[0-9A-Za-z_-]+\z"),
        "year": ~((F.col("year") == C.NONE) | F.col("year").rlike(r"(?U)\A\d{4}\z")),
        "month": ~((F.col("month") == C.NONE) | F.col("month").rlike(r"\A(0[1-9]|1[0-2])\z")),
        "day": ~((F.col("day") == C.NONE) | F.col("day").rlike(r"\A(0[1-9]|[12][0-9]|3[01])\z")),
        "final_date": F.col("final_date") != join_date(F.col("year"), F.col("month"), F.col("day")),
    }
    rules = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    per_row = (rows.select("image_id", F.explode(rules).alias("rule")).groupBy("rule", "image_id")
               .agg(F.count("*").alias("n")))
    found = per_row.unionByName(
        rows.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.lit("duplicate_id").alias("rule"), "image_id", "n"))
    if images is not None:
        absent = rows.groupBy("image_id").agg(F.count("*").alias("n")).join(
            images.select("image_id").distinct(), "image_id", "left_anti")
        found = found.unionByName(absent.select(F.lit("unknown_id").alias("rule"), "image_id", "n"))
    return found


def detection_errors(records: DataFrame) -> DataFrame:
    """Raw stage records with the list of constraints they break (empty when sound)."""
    d = F.col("detections")

    def every(test) -> Column:
        return F.coalesce(F.forall(d, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    times = ("decode_sec", "prepare_sec", "ocr_sec", "stage_sec")
    checks = {
        "text": every(lambda x: x["text"].isNotNull()),
        "confidence": every(lambda x: finite(x["confidence"]) & x["confidence"].between(0, 1)),
        "polygon": every(lambda x: (F.size(x["bbox"]) >= 4) & F.forall(
            x["bbox"], lambda p: (F.size(p) == 2) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))))),
        "timing": F.greatest(*[F.lit(0)] + [F.when(finite(F.col(t)) & (F.col(t) >= 0), 0).otherwise(1) for t in times]) == 0,
        "stage_shorter_than_recognition": F.coalesce(F.col("stage_sec") >= F.col("ocr_sec"), F.lit(False)),
    }
    return records.withColumn("errors", F.array_compact(F.array(
        *[F.when(~c, F.lit(n)) for n, c in checks.items()])))


def completeness_gap(images: DataFrame, stages: list[str], done: DataFrame) -> DataFrame:
    """Expected (image, stage) pairs that are missing; the few stages are expanded per image."""
    plan = images.select("image_id").distinct().select(
        "image_id", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    return plan.join(done.select("image_id", "stage"), ["image_id", "stage"], "left_anti")


def duplicates(rows: DataFrame, keys=("image_id", "stage")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def record_digest(columns: list[str]) -> Column:
    """SHA-256 of the named columns as JSON with sorted keys; nulls stay out of the text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def seal(rows: DataFrame, columns: list[str], into: str = "record_sha256") -> DataFrame:
    return rows.withColumn(into, record_digest(columns))


def broken_seals(rows: DataFrame, columns: list[str], sealed: str = "record_sha256") -> DataFrame:
    return rows.where(~F.col(sealed).eqNullSafe(record_digest(columns)))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: the count and, over all 256 bits of the row digests, the sums
    of eight 32-bit slices."""
    digest = record_digest(columns)
    slices = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    return rows.agg(F.count("*").alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(slices)])


def require_empty(rows: DataFrame, message: str) -> None:
    """Gate: raise with one example when a table of violations has rows."""
    example = rows.first()
    if example is not None:
        raise ValueError(f"{message}: {example.asDict()}")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one side has, both ways, copies counted."""
    return (left.exceptAll(right).withColumn("side", F.lit("left"))
            .unionByName(right.exceptAll(left).withColumn("side", F.lit("right"))))


def seeded_sample(population: DataFrame, size: int, seed: int, key: str = "image_id") -> DataFrame:
    """The ``size`` ids with the lowest seeded hash; refuses to return fewer."""
    available = population.count()
    if not 1 <= size <= available:
        raise ValueError(f"asked for {size} of {available} eligible rows")
    return population.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)).orderBy(
        "_h", key).limit(size).drop("_h")


def sample_drift(sample: DataFrame, population: DataFrame, columns: list[str]) -> DataFrame:
    """Sample rows that are no longer in the population exactly as they were drawn."""
    return sample.select(*columns).exceptAll(population.select(*columns))


def reuse_reasons(old: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Per stored result the provenance fields that stop it from being reused."""
    now = current.select("image_id", "stage", *[F.col(f).alias(f"now_{f}") for f in fields], F.lit(True).alias("_now"))
    both = old.join(now, ["image_id", "stage"], "left")
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"now_{f}")), F.lit(f)) for f in fields]
    reasons = F.when(F.col("_now").isNull(), F.array(F.lit("not_in_plan"))).otherwise(
        F.array_compact(F.array(*differs)))
    return both.select("image_id", "stage", reasons.alias("reasons"), (F.size(reasons) == 0).alias("reusable"))


def file_digests(spark, folder: str) -> DataFrame:
    """(path, sha256) of the files in a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def file_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that changed, vanished or appeared between two digest tables."""
    a = before.select("path", F.col("sha256").alias("old"))
    b = after.select("path", F.col("sha256").alias("new"))
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
