"""Whole pipelines: replay saved boxes through parser and cascade, evaluate, compare rule sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alike import once_per_kind, parsed_kinds
from ..operators.cascade import TRIALS, cascade, cascade_trials, cascade_variants
from ..operators.select import stage_results, stage_results_of_lanes
from ..rules import EARLIER, PRODUCTION, RuleSet, variant
from ..rules.ruleset import VARIANTS, split


def replay(boxes: DataFrame, rules: RuleSet = PRODUCTION, **options) -> DataFrame:
    """Boxes of all stages to one decision per image."""
    return cascade(stage_results(boxes, rules, **options), rules)


def ablation(boxes: DataFrame, names: Iterable[str], base: RuleSet = EARLIER, **options) -> DataFrame:
    """(variant, image_id, final_date, method, attempts) for several rule variants."""
    out = None
    for name in names:
        rules = variant(base, name)
        part = replay(boxes, rules, **options).select(
            F.lit(name).alias("variant"), "image_id", "final_date", "method", "attempts", "missing_stage")
        out = part if out is None else out.unionByName(part)
    return out


def _variants(names: Iterable[str], base: RuleSet):
    """The step from boxes to (image_id, trials) for several rule variants."""
    parts = {n: split(variant(base, n)) for n in names}
    lanes: dict[RuleSet, list[str]] = {}
    for reading, period, _ in parts.values():
        used = lanes.setdefault(reading, [])
        if period not in used:
            used.append(period)
    place = {reading: i for i, reading in enumerate(lanes)}
    plans = {n: (place[reading], period, rules) for n, (reading, period, rules) in parts.items()}
    return lambda part, **told: cascade_variants(stage_results_of_lanes(part, lanes, **told), plans)


def variants_side_by_side(boxes: DataFrame, names: Iterable[str] = tuple(VARIANTS), base: RuleSet = EARLIER, **options) -> DataFrame:
    """(image_id, trials): what :func:`ablation` gives for several rule variants, from one scan of the boxes and as one array
    per image. Variants that read tokens alike share a lane, variants that differ in stated periods or in the cascade only
    share the image step as well; images with equal boxes are decided once. ``evaluate.compare_trials`` and its companions
    read the result."""
    return once_per_kind(boxes, _variants(names, base), **options)


def variants_of_kinds(counted: DataFrame, names: Iterable[str] = tuple(VARIANTS), base: RuleSet = EARLIER, **options) -> DataFrame:
    """(kind, trials): as :func:`variants_side_by_side` for images told by kind (``alike.counted_kinds``). The trials stay with the
    kinds: they are many times the size of an image, and no image needs them all."""
    return parsed_kinds(counted, _variants(names, base), **options)


def parser_ablation(boxes: DataFrame, names: Iterable[str], base: RuleSet = EARLIER, **options) -> DataFrame:
    """As :func:`ablation` for one stage per image, without the cascade; images with equal boxes are parsed once."""
    def each(part: DataFrame, **told) -> DataFrame:
        out = None
        for name in names:
            rows = stage_results(part, variant(base, name), **told).select(
                F.lit(name).alias("variant"), "image_id", "final_date", F.array("stage").alias("attempts"),
                F.lit(None).cast("string").alias("missing_stage"))
            out = rows if out is None else out.unionByName(rows)
        return out
    return once_per_kind(boxes, each, **options)


def ablation_summary(results: DataFrame, truth: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per variant: correct, calls, gains and regressions against the baseline variant."""
    base = results.where(F.col("variant") == baseline).select(
        "image_id", F.col("final_date").alias("old"), F.size("attempts").alias("old_calls"))
    rows = results.join(base, "image_id").join(
        truth.select("image_id", F.col("final_date").alias("truth")), "image_id")
    old_ok, new_ok = F.col("old") == F.col("truth"), F.col("final_date") == F.col("truth")
    return rows.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_if(new_ok).alias("correct"),
        F.sum(F.size("attempts")).alias("calls"), F.sum(F.size("attempts") - F.col("old_calls")).alias("call_delta"),
        F.count_if(F.col("missing_stage").isNotNull()).alias("unknown"),
        F.count_if(~old_ok & new_ok).alias("gains"), F.count_if(old_ok & ~new_ok).alias("regressions"))


def order_trials(stage_rows: DataFrame, names: Iterable[str] = tuple(TRIALS), rules: RuleSet = PRODUCTION) -> DataFrame:
    """(image_id, trial, final_date, method, attempts, missing_stage, micros) for stage orders and skipped stages."""
    return cascade_trials(stage_rows, {n: TRIALS[n] for n in names}, rules)
