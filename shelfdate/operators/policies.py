"""Decision policies over saved stages, and tables that compare them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_word
from ..rules import constants as C
from .cascade import stages_side_by_side, true_if

POLICY_STAGES = C.STAGES[:3]

GATES: dict[str, Callable[[Column], Column]] = {
    "forced": lambda first: F.lit(True),
    "A": lambda first: F.when(first["q"].isNotNull(), first["q"] < C.RETRY_CONFIDENCE),
    "B": lambda first: F.when(first["q"].isNotNull(), (first["q"] < C.RETRY_CONFIDENCE) | first["many"]),
}


def _highest_q(stages: list[Column], single_only: bool) -> Column:
    """Number of the stage with the highest confidence; ties keep the earlier stage."""
    first = stages[0]
    pairs = [F.struct(F.coalesce(first["q"], F.lit(-1.0)).alias("q"), F.lit(0).alias("i"))]
    for i, s in enumerate(stages[1:], 1):
        allowed = true_if(s["has_candidate"]) & s["q"].isNotNull()
        if single_only:
            allowed = allowed & (F.size(s["candidate_dates"]) == 1) & first["q"].isNotNull()
        pairs.append(F.when(allowed, F.struct(s["q"].alias("q"), F.lit(-i).alias("i"))))
    return -F.array_max(F.array_compact(F.array(*pairs)))["i"]


RULES: dict[str, Callable[[list[Column]], Column]] = {
    "keep_stage1": lambda s: F.lit(0),
    "retry_agreement": lambda s: F.when(
        true_if(s[1]["has_candidate"] & s[2]["has_candidate"] & (s[1]["final_date"] == s[2]["final_date"])),
        F.lit(1)).otherwise(0),
    "highest_q": lambda s: _highest_q(s, False),
    "unique_evidence_higher_q": lambda s: _highest_q(s, True),
    "latest_highres_reference": lambda s: F.lit(2),
}


def policy_outcomes(stage_rows: DataFrame, truth: DataFrame, gates=GATES, rules=RULES) -> DataFrame:
    """One row per image, gate and rule: the stage taken and what became of the image; unknown
    images lack one of the three stages and are neither triggered nor correct.

    The grid of gates and rules is expanded inside each row; it is a few constants wide.
    """
    wide = stages_side_by_side(stage_rows, POLICY_STAGES).join(truth, "image_id")
    stages = [F.col(s) for s in POLICY_STAGES]
    known = stages[0].isNotNull() & stages[1].isNotNull() & stages[2].isNotNull()
    grid = F.array(*[
        F.struct(F.lit(g).alias("gate"), F.lit(r).alias("rule"), true_if(gate(stages[0])).alias("triggered"),
                 F.when(true_if(gate(stages[0])), rule(stages)).otherwise(0).alias("taken"))
        for g, gate in gates.items() for r, rule in rules.items()])
    dates = F.array(*[s["final_date"] for s in stages])
    rows = wide.select("image_id", *[c for c in truth.columns if c not in ("image_id",)],
                       dates.alias("dates"), (~known).alias("unknown"), F.explode(grid).alias("g"))
    first, chosen = F.get("dates", F.lit(0)), F.get("dates", F.col("g.taken"))
    return rows.select(
        "image_id", *[c for c in truth.columns if c != "image_id"], "g.gate", "g.rule", "unknown",
        (F.col("g.triggered") & ~F.col("unknown")).alias("triggered"),
        F.get(F.array(*[F.lit(s) for s in POLICY_STAGES]), F.col("g.taken")).alias("selected_stage"),
        chosen.alias("selected"), *[(~F.col("unknown") & flag).alias(name) for name, flag in {
            "correct": chosen == F.col("truth"), "changed": chosen != first,
            "recovery": (first != F.col("truth")) & (chosen == F.col("truth")),
            "regression": (first == F.col("truth")) & (chosen != F.col("truth"))}.items()])


def policy_grid(outcomes: DataFrame, by=("gate", "rule")) -> DataFrame:
    flags = ("unknown", "triggered", "correct", "changed", "recovery", "regression")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f"{f}_count") for f in flags])


def shadow_outcome(before: Column, after: Column, truth: Column) -> Column:
    """What switching from one prediction to another means for an image."""
    return (F.when(before.isNull() | after.isNull() | truth.isNull(), C.UNKNOWN)
            .when((before == truth) & (after == truth), "unchanged_correct")
            .when((before == truth) & (after != truth), "regression")
            .when((before != truth) & (after == truth), "recovery")
            .when(before == after, "unchanged_wrong")
            .otherwise("wrong_to_different_wrong"))


def best_pass(passes: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Per image the pass with the best evidence: anchor preference, closeness, completeness, number of valid fields,
    confidence, then a fixed priority. passes: rows of ``candidate_detail`` with the pass in ``stage``. Passes without a
    candidate do not compete; an image that has no other keeps a row with null pass and the date ``NONE``."""
    rank = F.lit(0)
    for name, value in priority.items():
        rank = F.when(F.col("stage") == name, F.lit(value)).otherwise(rank)
    kept = ("final_date", "source_text", "confidence", "anchor_preference", "anchor_distance", "valid_fields", "complete", "score")
    order = F.struct("anchor_preference", F.coalesce(-F.col("anchor_distance"), F.lit(0.0)), "complete", "valid_fields", "confidence", rank)
    return passes.groupBy("image_id").agg(
        F.max_by(F.struct(F.col("stage").alias("pass"), *kept), F.when(F.col("has_candidate"), order)).alias("b"),
        F.count("*").alias("passes"), F.count_if("has_candidate").alias("passes_with_candidate")
    ).select("image_id", "passes", "passes_with_candidate", "b.*").withColumn("final_date", F.coalesce("final_date", F.lit(C.NONE)))


def overlay(base: DataFrame, retry: DataFrame, when: str = "has_candidate") -> DataFrame:
    """Final results with the dates of a retry laid over them where the retry found one."""
    dates = C.DATE_COLUMNS[1:]
    r = retry.select("image_id", F.col(when).alias("_found"),
                     *[F.col(d).alias(f"_{d}") for d in dates], F.lit(True).alias("_tried"))
    found = F.coalesce("_found", F.lit(False))
    out = base.join(r, "image_id", "left")
    return out.withColumns({d: F.when(found, F.col(f"_{d}")).otherwise(F.col(d)) for d in dates}).withColumn(
        "overlaid", found).drop("_found", "_tried", *[f"_{d}" for d in dates])


def keyword_anchor(boxes: DataFrame, stages=C.STAGES) -> DataFrame:
    """Per image the most confident placed box that holds an expiry word; earlier stages win ties."""
    rank = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    words = boxes.where((F.size("bbox") > 0) & has_word(F.col("text"), C.ANCHOR_WORDS) & (rank > 0))
    return words.groupBy("image_id").agg(F.max_by(
        F.struct("stage", "box_index", "text", "confidence", "bbox"),
        F.struct("confidence", -rank, -F.col("box_index"))).alias("b")).select("image_id", "b.*")
