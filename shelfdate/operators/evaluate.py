"""Scores, failure attribution, comparisons and run-time accounting.

Reports are long tables of counts or of image rows; no report collects ids into one value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import constants as C

DATE_FIELDS = C.DATE_COLUMNS[1:]


def truth_group(prefix: str = "true_") -> Column:
    unknown = sum((F.col(f"{prefix}{f}") == C.NONE).cast("int") for f in ("year", "month", "day"))
    return F.when(unknown == 0, "complete").when(unknown == 3, "all_none").otherwise("partial_none")


def score(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Strict equality per field; predictions are compared as they are, never repaired."""
    t = truth.select("image_id", *[F.col(f).alias(f"true_{f}") for f in DATE_FIELDS])
    scored = predictions.join(t, "image_id")
    return scored.withColumns({f"{f}_correct": F.col(f) == F.col(f"true_{f}") for f in DATE_FIELDS})


def accuracy_by_group(scored: DataFrame, group: str = "truth_group") -> DataFrame:
    """Counts per group and overall (group ``all``); empty groups stay, with null accuracy."""
    counts = [F.count("*").alias("n"), *[F.count_if(F.col(f"{f}_correct")).alias(f"{f}_n") for f in DATE_FIELDS]]
    names = scored.sparkSession.createDataFrame(
        [("all",), ("complete",), ("partial_none",), ("all_none",)], f"{group} string")
    rows = scored.withColumn(group, truth_group()).groupingSets(
        [[], [F.col(group)]], F.col(group)).agg(*counts).withColumn(group, F.coalesce(group, F.lit("all")))
    full = names.join(rows, group, "left")
    return full.select(group, F.coalesce("n", F.lit(0)).alias("n"),
                       *[(F.col(f"{f}_n") / F.col("n")).alias(f"{f}_accuracy") for f in DATE_FIELDS])


def failure_stage(image_found: Column, boxes: Column, has_candidate: Column, correct: Column,
                  needs_candidate: bool = True) -> Column:
    """Where an image fails. With ``needs_candidate`` an image without a date candidate is never a
    success; without it a right answer counts however it came about (no date where there is none)."""
    found = F.coalesce(image_found, F.lit(False))
    correct, has_candidate = (F.coalesce(c, F.lit(False)) for c in (correct, has_candidate))
    kind = F.when(~found, "missing_image")
    if not needs_candidate:
        kind = kind.when(correct, "success")
    return (kind.when(F.coalesce(boxes, F.lit(0)) == 0, "ocr_no_boxes").when(~has_candidate, "ocr_boxes_no_date_candidate")
            .when(~correct, "parser_wrong_after_candidate").otherwise("success"))


def attempt_counts(results: DataFrame, by: str = "attempts") -> DataFrame:
    return results.select(F.explode(by).alias("stage")).groupBy("stage").agg(F.count("*").alias("calls"))


def stage_seconds(results: DataFrame, attempts: str = "attempts", seconds: str = "seconds") -> DataFrame:
    """Sum, count and mean of the seconds listed beside the attempts."""
    pairs = results.select(F.inline(F.arrays_zip(F.col(attempts).alias("stage"), F.col(seconds).alias("micros"))))
    return pairs.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("micros").alias("micros"))


def changes(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """Images whose prediction changed, with gain / regression / changed_wrong; unknown where one
    of the two has no prediction or no row, or the truth is not known."""
    rows = (before.select("image_id", F.col("final_date").alias("old"))
            .join(after.select("image_id", F.col("final_date").alias("new")), "image_id", "full")
            .join(truth.select("image_id", F.col("final_date").alias("truth")), "image_id", "left"))
    kind = (F.when(F.col("old").isNull() | F.col("new").isNull() | F.col("truth").isNull(), C.UNKNOWN)
            .when((F.col("old") != F.col("truth")) & (F.col("new") == F.col("truth")), "gain")
            .when((F.col("old") == F.col("truth")) & (F.col("new") != F.col("truth")), "regression")
            .when(~F.col("old").eqNullSafe(F.col("new")), "changed_wrong"))
    return rows.withColumn("kind", kind).where("kind is not null")


def late_date_error(predicted: Column, truth: Column) -> Column:
    """The prediction is later than the truth on the parts both know, year first."""
    p, t = F.split(predicted, "-"), F.split(truth, "-")

    def known(i: int) -> Column:
        a, b = F.get(p, F.lit(i)), F.get(t, F.lit(i))
        return F.coalesce((a != C.NONE) & (b != C.NONE), F.lit(False))

    def prefix(a: Column, n: int) -> Column:
        return F.concat_ws("-", F.slice(a, 1, n))

    return (F.when(known(0) & known(1) & known(2), prefix(p, 3) > prefix(t, 3))
            .when(known(0) & known(1), prefix(p, 2) > prefix(t, 2))
            .when(known(0), prefix(p, 1) > prefix(t, 1)).otherwise(False))


def stage_oracle(stage_rows: DataFrame, truth: DataFrame, final: DataFrame) -> DataFrame:
    """Could any stage have been right, and was the final choice? Over all labelled images; unknown ones have no final choice."""
    t = truth.select("image_id", F.col("final_date").alias("truth"))
    hits = stage_rows.join(t, "image_id").groupBy("image_id").agg(F.bool_or(F.col("final_date") == F.col("truth")).alias("any_stage"))
    chosen = final.select("image_id", F.col("final_date").alias("chosen"))
    rows = t.join(hits, "image_id", "left").join(chosen, "image_id", "left")
    return rows.groupBy().agg(
        F.count("*").alias("n"), F.count_if(F.col("chosen").isNull()).alias("unknown"), F.count_if("any_stage").alias("oracle"),
        F.count_if(F.col("chosen") == F.col("truth")).alias("correct"),
        F.count_if(F.col("any_stage") & (F.col("chosen") != F.col("truth"))).alias("missed_choice"))


def candidate_oracle(stage_rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Among wrong stage predictions: how often a listed candidate was the truth."""
    t = truth.select("image_id", F.col("final_date").alias("truth"))
    wrong = stage_rows.join(t, "image_id").where(F.col("final_date") != F.col("truth"))
    return wrong.groupBy("stage").agg(
        F.count("*").alias("errors"),
        F.count_if(F.array_contains("candidate_dates", F.col("truth"))).alias("recoverable"))


def early_stop_oracle(stage_rows: DataFrame, truth: DataFrame, stages=C.STAGES[:4]) -> DataFrame:
    """Where the first-candidate policy stops, what the recorded stages after that would have given, and how many
    of them there are with their seconds (``seconds`` of the stage rows, in micros)."""
    number = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    t = truth.select("image_id", F.col("final_date").alias("truth"))
    rows = stage_rows.where(F.col("stage").isin(*stages)).join(t, "image_id").withColumn("no", number)
    hit = F.col("final_date") == F.col("truth")
    per = rows.groupBy("image_id").agg(
        F.min(F.when(F.col("has_candidate"), F.col("no"))).alias("stop"),
        F.min_by("final_date", F.when(F.col("has_candidate"), F.col("no"))).alias("stopped_date"),
        F.max(F.when(hit, F.col("no"))).alias("last_hit"),
        F.collect_list(F.struct("no", F.round(F.col("seconds") * 1_000_000).cast("bigint").alias("micros"))).alias("recorded"),
        F.any_value("truth").alias("truth"))  # a few stages per image
    normal = F.coalesce("stopped_date", F.lit(C.NONE))
    extra = F.when(F.col("stop").isNotNull(), F.filter("recorded", lambda x: x["no"] > F.col("stop")))
    return per.select(
        "image_id", F.coalesce(F.get(F.array(*[F.lit(s) for s in stages]), F.col("stop").cast("int") - 1),
                               F.lit("original_no_candidate")).alias("stop_stage"),
        F.when(normal == F.col("truth"), "preserve").when(F.col("last_hit") > F.col("stop"), "fix")
        .otherwise("fail").alias("outcome"),
        F.coalesce(F.size(extra), F.lit(0)).cast("bigint").alias("extra_attempts"),
        F.aggregate(F.coalesce(extra, F.array().cast("array<struct<no:bigint,micros:bigint>>")), F.lit(0).cast("bigint"),
                    lambda total, x: total + F.coalesce(x["micros"], F.lit(0))).alias("extra_micros"))


def error_class(any_stage: Column, listed: Column, text_has_label: Column) -> Column:
    """Why a prediction is wrong: D stage choice, C parser, B damaged text, A not detected."""
    return F.when(any_stage, "D").when(listed, "C").when(text_has_label, "B").otherwise("A")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion."""
    p = hits / n
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def _log_factorial(n: Column) -> Column:
    """log(n!) to about 1e-12 of its value: a sum up to 20, Stirling's series beyond."""
    x = n.cast("double")
    small = F.aggregate(F.when(n > 1, F.sequence(F.lit(2).cast("bigint"), F.least(n, F.lit(20)).cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
                        F.lit(0.0), lambda total, i: total + F.log(i.cast("double")))
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n <= 20, small).otherwise((x + 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(2 * math.pi)) + series)


def sign_test(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p-value of the sign test on discordant pairs: twice the smaller binomial tail at one half, at most 1;
    1 without such pairs. The tail starts at its largest term, taken from logarithms, and each further term is a ratio of
    the last, until they no longer count; so it costs about the square root of the number of pairs."""
    n, low = (only_a + only_b).cast("bigint"), F.least(only_a, only_b).cast("bigint")
    top = F.exp(_log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) - n * math.log(2))
    steps = F.when(low > 0, F.sequence(F.lit(1).cast("bigint"), F.least(low, (F.sqrt(n.cast("double")) * 12 + 20).cast("bigint")))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
                       lambda a, i: F.struct((a["term"] * (low - i + 1) / (n - low + i)).alias("term"),
                                             (a["sum"] + a["term"] * (low - i + 1) / (n - low + i)).alias("sum")), lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * tail))


def paired(rows: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Discordant pairs of two variants; :func:`sign_test` judges them."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(a) & ~F.col(b)).alias("only_a"),
        F.count_if(~F.col(a) & F.col(b)).alias("only_b"), F.count_if(F.col(a) & F.col(b)).alias("both"))


def wrong_answer_kinds(scored: DataFrame) -> DataFrame:
    kind = (F.when(F.col("final_date") == C.NONE, "none").when(F.col("final_date").contains(C.NONE), "partial")
            .otherwise("full"))
    return scored.where(~F.col("final_date_correct")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys=("image_id", "stage"), field: str = "final_date") -> DataFrame:
    """Rows that differ between two snapshots, with rows only one of them has."""
    a = old.select(*keys, F.col(field).alias("old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(field).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(
        *keys, "old", "new", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .otherwise("changed").alias("change"))


def compare_policies(baseline: DataFrame, policies: dict[str, DataFrame], truth: DataFrame,
                     cohort: DataFrame) -> DataFrame:
    """Per cohort and policy: correct, gains, regressions and stage calls against a baseline."""
    t = truth.select("image_id", F.col("final_date").alias("truth"))
    base = baseline.select("image_id", F.col("final_date").alias("old"), F.col("attempts").alias("old_calls"))
    every = None
    for name, df in policies.items():
        part = df.select("image_id", F.lit(name).alias("policy"), F.col("final_date").alias("new"),
                         F.col("attempts").alias("calls"))
        every = part if every is None else every.unionByName(part)
    rows = every.join(base, "image_id").join(t, "image_id").join(cohort, "image_id")
    old_ok, new_ok = F.col("old") == F.col("truth"), F.col("new") == F.col("truth")
    return rows.groupBy("cohort", "policy").agg(
        F.count("*").alias("n"), F.count_if(new_ok).alias("correct"),
        F.count_if(~old_ok & new_ok).alias("gains"), F.count_if(old_ok & ~new_ok).alias("regressions"),
        F.sum(F.size("calls")).alias("calls"), F.sum(F.size("calls") - F.size("old_calls")).alias("extra_calls"),
        F.count_if(F.size(F.array_except("calls", "old_calls")) > 0).alias("images_with_new_stages"))


def beside_truth(trials: DataFrame, truth: DataFrame, baseline: str, names, by: str = "image_id") -> DataFrame:
    """(by, cohort, truth, n, base, p): one row per labelled image and trial (struct p) with the baseline's decision
    (struct base); an image without stage rows keeps one row per trial, with nulls. trials: image_id and array ``trials``, which holds
    the decisions of ``names``. by: "kind" where both sides are told by kind; a row of the truth then stands for ``n`` images."""
    n = F.col("n") if "n" in truth.columns else F.lit(1)
    blank = truth.select(by, "cohort", F.col("final_date").alias("truth"), n.cast("bigint").alias("n")).join(trials, by, "left")
    first = F.filter("trials", lambda t: t["trial"] == baseline)[0]
    kind = trials.schema["trials"].dataType.elementType
    empty = F.array(*[F.struct(F.lit(n).alias("trial"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:]]) for n in names])
    return blank.select(by, "cohort", "truth", "n", first.alias("base"), F.explode(F.coalesce("trials", empty)).alias("p"))


def compare_trials(trials: DataFrame, truth: DataFrame, baseline: str, names, *, project_to: int = 500, known_only: bool = False,
                   by: str = "image_id") -> DataFrame:
    """Per cohort and trial, beside a baseline trial: labelled images, unknown ones (a stage is missing for either), right
    ones, gains, regressions, calls and their difference, images with a retry and with stages the baseline does not ask
    for, cost and its difference in micros, and seconds projected to a number of images. known_only leaves out unknown images.
    by: as in :func:`beside_truth`."""
    rows = beside_truth(trials, truth, baseline, names, by)
    if known_only:
        rows = rows.where("base.missing_stage is null and p.missing_stage is null and base.attempts is not null")
    base, p = F.col("base"), F.col("p")
    unknown = base["final_date"].isNull() | p["final_date"].isNull()
    old, new = (~unknown & (x["final_date"] == F.col("truth")) for x in (base, p))
    size = {n: F.when(~unknown, F.size(x["attempts"])).otherwise(0) for n, x in (("new", p), ("old", base))}
    spent = {n: F.when(~unknown, x["micros"]).otherwise(0) for n, x in (("new", p), ("old", base))}

    def images(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    def total(each: Column) -> Column:
        return F.sum(each * F.col("n"))

    return rows.groupBy("cohort", F.col("p.trial").alias("policy")).agg(
        F.sum("n").alias("n"), images(unknown).alias("unknown"), images(new).alias("correct"),
        images(~old & new).alias("gains"), images(old & ~new).alias("regressions"),
        total(size["new"]).alias("calls"), total(size["new"] - size["old"]).alias("extra_calls"),
        images(~unknown & (F.size(p["attempts"]) > 1)).alias("retry_images"),
        images(~unknown & (F.size(F.array_except(p["attempts"], base["attempts"])) > 0)).alias("images_with_new_stages"),
        total(spent["new"]).alias("micros"), total(spent["new"] - spent["old"]).alias("extra_micros"),
        (total(spent["new"]) / 1_000_000 * project_to / F.sum("n")).alias("projected_seconds"))


def trial_changes(trials: DataFrame, truth: DataFrame, baseline: str, names) -> DataFrame:
    """(cohort, policy, image_id, truth, old, new, old_correct, new_correct, attempts): every labelled image whose prediction
    under a trial is not the baseline's; one of them is null where a stage is missing."""
    rows = beside_truth(trials, truth, baseline, names).where(~F.col("base.final_date").eqNullSafe(F.col("p.final_date")))
    return rows.select("cohort", F.col("p.trial").alias("policy"), "image_id", "truth", F.col("base.final_date").alias("old"), F.col("p.final_date").alias("new"),
                       F.coalesce(F.col("base.final_date") == F.col("truth"), F.lit(False)).alias("old_correct"),
                       F.coalesce(F.col("p.final_date") == F.col("truth"), F.lit(False)).alias("new_correct"), F.col("p.attempts").alias("attempts"))


def changed_trials(trials: DataFrame, baseline: str, by: str = "kind") -> DataFrame:
    """(by, policy, old, new, attempts): the trials whose prediction is not the baseline's, before any truth is beside them."""
    first = F.filter("trials", lambda t: t["trial"] == baseline)[0]
    rows = trials.select(by, first["final_date"].alias("old"), F.explode("trials").alias("p")).where(~F.col("old").eqNullSafe(F.col("p.final_date")))
    return rows.select(by, F.col("p.trial").alias("policy"), "old", F.col("p.final_date").alias("new"), F.col("p.attempts").alias("attempts"))


def change_kind(old: Column, new: Column, truth: Column) -> Column:
    """What a changed prediction means: gain, regression or changed_wrong; unknown where a side or the truth is missing."""
    return (F.when(old.isNull() | new.isNull() | truth.isNull(), C.UNKNOWN).when(new == truth, "gain")
            .when(old == truth, "regression").otherwise("changed_wrong"))


def trial_stage_calls(trials: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(policy, stage, calls): how often each trial asks for each stage; images with a missing stage have no calls. counted:
    (kind, n), the images of each kind, where the trials are told by kind."""
    rows = trials.withColumn("n", F.lit(1).cast("bigint")) if counted is None else trials.join(counted, "kind")
    each = rows.select("n", F.explode("trials").alias("t")).select("n", F.col("t.trial").alias("policy"), F.explode("t.attempts").alias("stage"))
    return each.groupBy("policy", "stage").agg(F.sum("n").alias("calls"))


def speed_gate(calls: DataFrame, group: str, order: str, first: int = 10, limit: float = 45_000.0) -> DataFrame:
    """(group, calls, projected, within_limit): the mean of the first few calls of each group, projected to all of its
    calls. calls: micros beside the named columns. first: how many calls are measured; limit: seconds allowed."""
    by_group = Window.partitionBy(group).orderBy(order)
    early = (calls.select(group, order, "micros").withColumn("rn", F.row_number().over(by_group)).where(F.col("rn") <= first)
             .groupBy(group).agg((F.sum("micros") / F.count("*")).alias("mean")))
    counted = calls.groupBy(group).agg(F.count("*").alias("calls"))
    projected = F.col("mean") * F.col("calls") / 1_000_000
    return counted.join(early, group).select(group, "calls", projected.alias("projected"), (projected <= limit).alias("within_limit"))


def project_runtime(calls: DataFrame, cost: DataFrame, images: int, target: int, efficiency: float = 1.0) -> DataFrame:
    """Linear projection of stage calls to a target number of images."""
    rows = calls.join(cost, "stage")
    return rows.select("stage", "calls", (F.col("calls") * F.col("unit_seconds") * target / images / efficiency)
                       .alias("projected_seconds"))


def coverage_gap(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, predicted, labelled) of the images that are not exactly once on either side: the gate before a score."""
    p = predictions.groupBy("image_id").agg(F.count("*").alias("predicted"))
    t = truth.groupBy("image_id").agg(F.count("*").alias("labelled"))
    both = p.join(t, "image_id", "full").select(
        "image_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("predicted", "labelled")])
    return both.where("predicted <> 1 or labelled <> 1")


def baseline_issues(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """(image_id, stored, recomputed, issue) where a recomputed prediction is not the stored one; empty when it may be used."""
    rows = stored.select("image_id", F.col("final_date").alias("stored")).join(
        recomputed.select("image_id", F.col("final_date").alias("recomputed")), "image_id", "full")
    issue = (F.when(F.col("stored").isNull(), "not_stored").when(F.col("recomputed").isNull(), "not_recomputed")
             .when(F.col("stored") != F.col("recomputed"), "differs"))
    return rows.withColumn("issue", issue).where("issue is not null")


def grown_attempts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images for which a policy asks for stages that another one does not, with those stages."""
    rows = before.select("image_id", F.col("attempts").alias("old")).join(
        after.select("image_id", F.col("attempts").alias("new")), "image_id")
    return rows.withColumn("added", F.array_except("new", "old")).where(F.size("added") > 0).select("image_id", "added")


def oracle_change(stage_rows: DataFrame, truth: DataFrame, before: tuple[str, ...], after: tuple[str, ...]) -> DataFrame:
    """How many images have some right stage in each of two runs, and how many gain or lose it; one aggregate per image."""
    right = F.col("final_date") == F.col("truth")
    per = stage_rows.join(truth.select("image_id", F.col("final_date").alias("truth")), "image_id").groupBy("image_id").agg(
        *[F.coalesce(F.bool_or(right & F.col("stage").isin(*names)), F.lit(False)).alias(n) for n, names in (("before", before), ("after", after))])
    return per.agg(F.count("*").alias("n"), F.count_if("before").alias("before"), F.count_if("after").alias("after"),
                   F.count_if(~F.col("before") & F.col("after")).alias("gained"), F.count_if(F.col("before") & ~F.col("after")).alias("lost"))


def run_summary(scored: DataFrame, seconds: DataFrame, none_method: str = "original_no_candidate") -> DataFrame:
    """One row: images, candidates, successes (also among those with a candidate), and seconds.

    seconds: image_id, micros, boxes; images without a row there count as new without cost.
    """
    rows = scored.join(seconds, "image_id", "left")
    has, ok = F.col("method") != none_method, F.col("final_date_correct")
    n, candidates = F.count("*"), F.count_if(has)
    return rows.agg(
        n.alias("n"), candidates.alias("candidates"), F.count_if(ok).alias("correct"), F.count_if(has & ok).alias("correct_with_candidate"),
        (candidates / n).alias("candidate_rate"), (F.count_if(has & ok) / candidates).alias("success_given_candidate"),
        F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"), F.coalesce(F.sum("micros"), F.lit(0)).alias("micros"),
        (F.sum("micros") / n).alias("mean_micros"))


def method_table(policies: dict[str, DataFrame], truth: DataFrame, baseline: str) -> DataFrame:
    """Per policy: images, calls, exact results, accuracy, percentage points above the baseline, recoveries, regressions
    and unknown images. Policies stand beside each other in one row per image, so the truth is joined once."""
    wide = truth.select("image_id", F.col("final_date").alias("truth"))
    for name, df in policies.items():
        wide = wide.join(df.select("image_id", F.struct(F.col("final_date").alias("date"), F.coalesce(F.size("attempts"), F.lit(0)).alias("calls")).alias(name)), "image_id", "left")
    base = F.coalesce(F.col(baseline)["date"] == F.col("truth"), F.lit(False))
    each = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n)["date"].isNull().alias("unknown"), F.coalesce(F.col(n)["calls"], F.lit(0)).alias("calls"),
                              F.coalesce(F.col(n)["date"] == F.col("truth"), F.lit(False)).alias("ok")) for n in policies])
    rows = wide.select(base.alias("base"), F.explode(each).alias("p")).select("base", "p.*")
    out = rows.groupBy("policy").agg(
        F.count("*").alias("n"), F.count_if("unknown").alias("unknown"), F.sum("calls").alias("calls"), F.count_if("ok").alias("exact"),
        F.count_if("base").alias("base_exact"), F.count_if(~F.col("base") & F.col("ok")).alias("recoveries"),
        F.count_if(F.col("base") & ~F.col("ok")).alias("regressions"))
    return out.select("policy", "n", "unknown", "calls", "exact", (F.col("exact") / F.col("n")).alias("accuracy"),
                      (100.0 * (F.col("exact") - F.col("base_exact")) / F.col("n")).alias("points"), "recoveries", "regressions")


def verdict_changes(rows: DataFrame) -> DataFrame:
    """(raw, normalised, n) for rows of prediction, label and normalised label: whether a prediction equals the label as it
    is written and as it is normalised, so that a change of verdict by normalising shows apart from one by inference.
    Labels without a prediction are a class of their own, with nulls."""
    raw, normal = (F.when(F.col("prediction").isNotNull(), F.coalesce(F.col("prediction") == F.col(c), F.lit(False))) for c in ("label", "normalised"))
    return rows.groupBy(raw.alias("raw"), normal.alias("normalised")).agg(F.count("*").alias("n"))
