"""Label audit: reasons per record, one review row per image, approval gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import numeric_key, with_canonical, with_stored, with_truth
from ..rules import constants as C

REASONS = ("invalid_image_id", "invalid_component", "all_none", "partial_none", "unusual_year", "calendar_invalid",
           "ambiguous_date_order", "component_final_mismatch")


def audit_records(records: DataFrame) -> DataFrame:
    """Records with canonical dates and the reasons that call for a review.

    Expects image_id, source, year, month, day, final_date as text. An id that is not numeric is a
    reason of its own and stays the record's key as it is written (empty if it is missing).
    """
    df = with_stored(with_canonical(records.withColumn("key", F.coalesce(numeric_key(F.col("image_id")), F.col("image_id"), F.lit("")))))
    valid = F.col("c_error").isNull()
    y, m, d = (F.col(f"c_{n}") for n in ("year", "month", "day"))
    unknown = sum((v == C.NONE).cast("int") for v in (y, m, d))
    stored_bad = F.col("s_calendar") != ""
    mi, di = m.try_cast("int"), d.try_cast("int")
    conditions = {
        "invalid_image_id": numeric_key(F.col("image_id")).isNull(),
        "invalid_component": ~valid,
        "all_none": valid & (unknown == 3),
        "partial_none": valid & unknown.between(1, 2),
        "unusual_year": valid & ~y.try_cast("int").between(C.YEAR_MIN, C.YEAR_MAX),
        "calendar_invalid": valid & ((F.col("c_calendar") != "") | F.coalesce(stored_bad, F.lit(False))),
        "ambiguous_date_order": valid & (y == C.NONE) & mi.between(1, 12) & di.between(1, 12) & (mi != di),
        "component_final_mismatch": valid & ~F.coalesce(F.col("stored") == F.col("c_final_date"), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    changed = F.array_compact(F.array(*[
        F.when(valid & (F.col(n) != F.col(f"c_{n}")), F.lit(n)) for n in ("year", "month", "day", "final_date")]))
    return df.select("key", "source", "image_id", *[F.col(f"c_{n}").alias(f"canonical_{n}")
                     for n in ("year", "month", "day", "final_date")], reasons.alias("reasons"),
                     changed.alias("format_changes"))


def review_images(audited: DataFrame, image_counts: DataFrame | None = None) -> DataFrame:
    """One row per image: merged reasons, a candidate only where all records agree, a status.

    The records are read once: each counts for its source and for its unordered pair of month and day, both are counted by map-side
    combined aggregates, so an id repeated many times costs one row per source and pair, and then meet in their image.
    """
    parts = ["canonical_year", "canonical_month", "canonical_day", "canonical_final_date"]
    valid, month, day = F.col("canonical_final_date").isNotNull(), F.col("canonical_month"), F.col("canonical_day")
    bits = sum((F.when(F.array_contains("reasons", r), 1 << i).otherwise(0) for i, r in enumerate(REASONS)), F.lit(0))
    # two records of one image whose month and day are swapped share this pair
    of_source = F.struct(F.lit(False).alias("paired"), "source", F.lit(None).cast("string").alias("pair_year"),
                         F.lit(None).cast("string").alias("pair_low"), F.lit(None).cast("string").alias("pair_high"))
    of_pair = F.struct(F.lit(True).alias("paired"), F.lit(None).cast(audited.schema["source"].dataType).alias("source"), F.col("canonical_year").alias("pair_year"),
                       F.least(month, day).alias("pair_low"), F.greatest(month, day).alias("pair_high"))
    each = audited.select("key", F.when(valid, F.struct(*parts)).alias("whole"), bits.alias("bits"), month.alias("month"),
                          F.explode(F.when(valid & (month != day), F.array(of_source, of_pair)).otherwise(F.array(of_source))).alias("of"))
    each = each.select("key", "of.*", "month", *[F.when(~F.col("of.paired"), F.col(c)).alias(c) for c in ("whole", "bits")])
    counted = each.groupBy("key", "paired", "source", "pair_year", "pair_low", "pair_high").agg(
        F.count("*").alias("n"), F.bit_or("bits").alias("bits"), F.min("whole").alias("low"), F.max("whole").alias("high"),
        F.bool_and(F.when(~F.col("paired"), F.col("whole").isNotNull())).alias("all_valid"),
        (F.min(F.when(F.col("paired"), F.col("month"))) != F.max(F.when(F.col("paired"), F.col("month")))).alias("swapped"))
    source = F.when(~F.col("paired"), F.col("n"))
    images = counted.groupBy("key").agg(
        F.bit_or("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("all_valid").alias("all_valid"),
        F.max("swapped").alias("swapped"), (F.max(source) > 1).alias("duplicate_source_id"), F.count(source).alias("n_sources"), F.sum(source).alias("n_records"))
    images = images.withColumns({r: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 for i, r in enumerate(REASONS)})
    mapping = F.lit(False)
    if image_counts is not None:
        images = images.join(image_counts.select(F.col("image_id").alias("key"), "n_images"), "key", "left")
        mapping = F.coalesce("n_images", F.lit(0)) != 1
    conflict = F.col("low") != F.col("high")
    swapped = conflict & F.coalesce("swapped", F.lit(False))
    merged = {r: F.col(r) for r in REASONS} | {
        "ambiguous_date_order": F.col("ambiguous_date_order") | F.coalesce(swapped, F.lit(False)),
        "label_conflict": F.coalesce(conflict, F.lit(False)),
        "duplicate_source_id": F.col("duplicate_source_id"),
        "image_mapping_issue": mapping,
    }
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in merged.items()])))
    agreed = F.col("all_valid") & ~F.coalesce(conflict, F.lit(True))
    return images.select(
        F.col("key").alias("image_id"), "n_sources", "n_records",
        *[F.coalesce(F.when(agreed, F.col("low")[f"canonical_{n}"]), F.lit("")).alias(f"candidate_{n}")
          for n in ("year", "month", "day", "final_date")],
        F.array_join(reasons, ";").alias("review_reason"),
        F.when(F.size(reasons) > 0, "pending").otherwise("ready_for_review").alias("review_status"))


def review_summary(images: DataFrame) -> DataFrame:
    """(kind, value, n): totals, reasons and statuses, from one pass over the images."""
    def row(kind: str, value, n):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), n.cast("bigint").alias("n"))

    one = F.lit(1)
    totals = [row("total", F.lit("unique_images"), one), row("total", F.lit("source_rows"), F.col("n_records")),
              row("total", F.lit("cross_source_overlap"), (F.col("n_sources") > 1).cast("int"))]
    told = F.array(*totals, row("status", F.col("review_status"), one))
    reasons = F.when(F.col("review_reason") != "", F.transform(F.split("review_reason", ";"), lambda v: row("reason", v, one)))
    rows = images.select(F.explode(F.concat(told, F.coalesce(reasons, F.slice(told, 1, 0)))).alias("x")).select("x.*")
    # totals are there without any image, too
    none = images.sparkSession.createDataFrame([("total", "unique_images", 0), ("total", "source_rows", None), ("total", "cross_source_overlap", 0)], "kind string, value string, n bigint")
    return rows.unionByName(none).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def approved(labels: DataFrame) -> DataFrame:
    """Rows a person approved completely, with their normalised truth; others carry an error."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    accepted = with_truth(labels.where(F.col("review_status") == "approved")
                          .withColumn("key", numeric_key(F.col("image_id"))))
    error = (F.when(F.col("key").isNull(), "invalid_image_id")
             .when(~F.coalesce(F.col("master_eligible") == "true", F.lit(False))
                   | blank(F.col("reviewer")) | blank(F.col("review_note")), "incomplete_approval")
             .otherwise(F.col("t_error")))
    return accepted.select(F.col("key").alias("image_id"), *[F.col(f"t_{n}").alias(n) for n in
                           ("year", "month", "day", "final_date")], error.alias("error"))
