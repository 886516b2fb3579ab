"""A shadow run of a retry policy on a frozen cohort: who belongs to it, what the policy would have changed, and what it costs.

Membership is one aggregate over all lists of the cohort, the summary one aggregate over the images; the summary checks its
own sums in that pass and gives no row where they do not agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import constants as C
from .cascade import EVIDENCE, stages_side_by_side, true_if
from .policies import GATES, POLICY_STAGES, RULES, shadow_outcome

CATEGORIES = ("recovery", "regression", "wrong_to_different_wrong", "unchanged_correct", "unchanged_wrong", C.UNKNOWN)


def cohort_membership(official: DataFrame, failures: DataFrame, controls: DataFrame, stage: str = C.STAGES[0]) -> DataFrame:
    """(image_id, membership) of every image on one of three lists: the official results (with their method) and two
    development lists of image ids.

    duplicate: more than one official result or listed twice on a development list; overlap: on both development lists;
    not_official: only on a development list; excluded_failure, excluded_control: official but used in development;
    later_stop: its official result stopped after ``stage``; primary: the cohort. Ids that are null are one image.
    """
    lists = (official.select("image_id", F.lit("official").alias("on"), "method")
             .unionByName(failures.select("image_id", F.lit("failures").alias("on"), F.lit(None).cast("string").alias("method")))
             .unionByName(controls.select("image_id", F.lit("controls").alias("on"), F.lit(None).cast("string").alias("method"))))
    per = lists.groupBy("image_id").agg(*[F.count_if(F.col("on") == n).alias(n) for n in ("official", "failures", "controls")], F.max("method").alias("method"))
    kind = (F.when(F.greatest("official", "failures", "controls") > 1, "duplicate")
            .when((F.col("failures") > 0) & (F.col("controls") > 0), "overlap").when(F.col("official") == 0, "not_official")
            .when(F.col("failures") > 0, "excluded_failure").when(F.col("controls") > 0, "excluded_control")
            .when(F.col("method") == stage, "primary").otherwise("later_stop"))
    return per.select("image_id", kind.alias("membership"))


def membership_issues(members: DataFrame) -> DataFrame:
    """The images that make a cohort unusable; empty when it may be used."""
    return members.where(F.col("membership").isin("duplicate", "overlap"))


def shadow_rows(stage_rows: DataFrame, members: DataFrame, truth: DataFrame, *, gate: str = "B", rule: str = "unique_evidence_higher_q") -> DataFrame:
    """One row per primary image: baseline and shadow prediction, whether the retries were triggered, its category, the stages
    asked for and their micros (``seconds`` of the stage rows). An image is unknown where its first stage, its truth or, once
    triggered, one of its two retries is missing; unknown images ask for nothing and are right in neither."""
    wide = stages_side_by_side(stage_rows, POLICY_STAGES, fields=(*EVIDENCE, "seconds"))
    rows = (members.where(F.col("membership") == "primary").select("image_id").join(wide, "image_id", "left")
            .join(truth.select("image_id", F.col("final_date").alias("truth")), "image_id", "left"))
    stages = [F.col(s) for s in POLICY_STAGES]
    wanted = true_if(GATES[gate](stages[0]))
    known = stages[0].isNotNull() & F.col("truth").isNotNull() & (~wanted | stages[1].isNotNull() & stages[2].isNotNull())
    rows = rows.withColumns({"triggered": known & wanted, "_known": known,
                             "_taken": F.when(known & wanted, RULES[rule](stages)).otherwise(0).cast("int")})
    chosen = F.get(F.array(*[s["final_date"] for s in stages]), F.col("_taken"))
    rows = rows.withColumns({"baseline": F.when(F.col("_known"), stages[0]["final_date"]), "shadow": F.when(F.col("_known"), chosen)})
    micros = [F.coalesce(F.round(s["seconds"] * 1_000_000).cast("bigint"), F.lit(0).cast("bigint")) for s in stages]
    names = F.array(*[F.lit(s) for s in POLICY_STAGES])
    return rows.select(
        "image_id", "truth", "baseline", "shadow", "triggered", F.when(F.col("_known"), F.get(names, F.col("_taken"))).alias("selected_stage"),
        true_if(F.col("baseline") == F.col("truth")).alias("baseline_correct"), true_if(F.col("shadow") == F.col("truth")).alias("shadow_correct"),
        shadow_outcome(F.col("baseline"), F.col("shadow"), F.col("truth")).alias("category"),
        F.when(F.col("triggered"), names).when(F.col("_known"), F.slice(names, 1, 1)).otherwise(F.slice(names, 1, 0)).alias("attempts"),
        F.when(F.col("_known"), micros[0]).otherwise(0).alias("original_micros"),
        F.when(F.col("triggered"), micros[1] + micros[2]).otherwise(0).alias("retry_micros"))


def shadow_summary(rows: DataFrame, *, project_to: int = 500) -> DataFrame:
    """One row over :func:`shadow_rows`: images, right ones before and after, categories, triggers, attempts, cost, and triggers,
    attempts and seconds projected to a number of images.

    Three sums have to agree, or reading the row fails: baseline + recoveries - regressions = shadow, the categories add up to
    the images, and the attempts are one per known image and two more per trigger. Ratios of no images are null.
    """
    counts = [F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in ("baseline_correct", "shadow_correct", "triggered")],
              *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES],
              F.count_if(F.col("triggered") & F.col("baseline_correct")).alias("triggered_correct"), F.coalesce(F.sum(F.size("attempts")), F.lit(0)).alias("attempts"),
              *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("original_micros", "retry_micros")]]
    one = rows.agg(*counts)
    broken = F.concat_ws(", ", *[F.when(~holds, name) for name, holds in {
        "baseline + recovery - regression is not shadow": F.col("baseline_correct") + F.col("recovery") - F.col("regression") == F.col("shadow_correct"),
        "categories do not add up to the images": sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])) == F.col("n"),
        "attempts do not follow the triggers": F.col("attempts") == F.col("n") - F.col(C.UNKNOWN) + 2 * F.col("triggered")}.items()])
    n = F.when(broken != "", F.raise_error(F.concat(F.lit("shadow run: "), broken)).cast("bigint")).otherwise(F.col("n"))
    share = F.lit(float(project_to)) / F.nullif(F.col("n"), F.lit(0).cast("bigint"))
    return one.select(
        n.alias("n"), *[c for c in one.columns if c != "n"], (F.col("triggered") - F.col("triggered_correct")).alias("triggered_wrong"),
        (F.col("shadow_correct") - F.col("baseline_correct")).alias("net_correct"), (share * F.col("triggered")).alias("projected_triggers"),
        (share * 2 * F.col("triggered")).alias("projected_retries"), (share * F.col("retry_micros") / 1_000_000).alias("projected_retry_seconds"))
