"""Saved recognition passes folded in a stated order: the first pass with a candidate decides.

Any number of passes is one array per image, folded inside the row, so another order or a longer one costs no further join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import constants as C
from .evaluate import failure_stage

NO_CANDIDATE = "original_no_candidate"


def _fold() -> str:
    start = (f"named_struct('missing', cast(null as string), 'found', false, 'method', '{NO_CANDIDATE}', 'date', cast(null as string), "
             "'attempts', cast(array() as array<string>), 'boxes', 0L, 'fallback', 0L)")
    one = "get(filter(_passes, x -> x.stage = s), 0)"
    step = """transform(array({one}), p -> if(p is null,
        named_struct('missing', s, 'found', a.found, 'method', a.method, 'date', a.date, 'attempts', a.attempts, 'boxes', a.boxes, 'fallback', a.fallback),
        named_struct('missing', a.missing, 'found', p.has_candidate, 'method', if(p.has_candidate, s, a.method),
          'date', if(p.has_candidate or size(a.attempts) = 0, p.final_date, a.date), 'attempts', array_append(a.attempts, s), 'boxes', a.boxes + p.boxes,
          'fallback', a.fallback + if(size(a.attempts) = 0, 0L, p.micros))))[0]""".format(one=one)
    return f"aggregate(_order, {start}, (a, s) -> if(a.found or a.missing is not null, a, {step}))"


def fold_passes(passes: DataFrame, truth: DataFrame, order: tuple[str, ...] = C.STAGES[:4]) -> DataFrame:
    """(image_id, truth, final_date, method, attempts, correct, failure_stage, fallback_micros, missing_stage) of every labelled image.

    passes: image_id, stage, final_date, has_candidate, boxes (number recognised) and seconds; of repeated rows of a pass the
    smallest counts, and nulls count as no candidate, no boxes, no seconds. The passes are asked in ``order`` until one has a candidate; where none has, the first
    pass's date stands. fallback_micros: cost of every pass asked after the first. failure_stage as in
    :func:`.evaluate.failure_stage` (a right answer without a candidate is a success), over the boxes of all attempts.
    An image that asks for a pass which was not saved is unknown, with that pass in ``missing_stage``.
    """
    zero = F.lit(0).cast("bigint")
    one = F.struct("stage", F.coalesce("final_date", F.lit(C.NONE)).alias("final_date"), F.coalesce("has_candidate", F.lit(False)).alias("has_candidate"),
                   F.coalesce(F.col("boxes").cast("bigint"), zero).alias("boxes"), F.coalesce(F.round(F.col("seconds") * 1_000_000).cast("bigint"), zero).alias("micros"))
    saved = passes.where(F.col("stage").isin(*order)).groupBy("image_id").agg(F.array_sort(F.collect_set(one)).alias("_passes"))
    rows = truth.select("image_id", F.col("final_date").alias("truth")).join(saved, "image_id", "left")
    empty = F.array().cast(saved.schema["_passes"].dataType)
    rows = rows.withColumns({"_passes": F.coalesce("_passes", empty), "_order": F.array(*[F.lit(s) for s in order])}).withColumn("f", F.expr(_fold()))
    known = F.col("f.missing").isNull()
    correct = known & F.coalesce(F.col("f.date") == F.col("truth"), F.lit(False))
    kind = failure_stage(F.lit(True), F.col("f.boxes"), F.col("f.found"), correct, needs_candidate=False)

    def if_known(value: Column) -> Column:
        return F.when(known, value)

    return rows.select(
        "image_id", "truth", if_known(F.col("f.date")).alias("final_date"), if_known(F.col("f.method")).alias("method"), if_known(F.col("f.attempts")).alias("attempts"),
        correct.alias("correct"), F.when(known, kind).otherwise(C.UNKNOWN).alias("failure_stage"), if_known(F.col("f.fallback")).alias("fallback_micros"),
        F.col("f.missing").alias("missing_stage"))


def pass_table(folded: DataFrame) -> DataFrame:
    """(stage, attempts, candidates, saves): how often each pass was asked, decided, and decided rightly."""
    rows = folded.select(F.explode("attempts").alias("stage"), "method", "correct")
    mine = F.col("method") == F.col("stage")
    return rows.groupBy("stage").agg(F.count("*").alias("attempts"), F.count_if(mine).alias("candidates"), F.count_if(mine & F.col("correct")).alias("saves"))


def control(passes: DataFrame, truth: DataFrame, baseline: str = C.STAGES[0], retry: str = C.STAGES[1]) -> DataFrame:
    """(image_id, source, final_date, has_candidate, correct): the baseline pass, replaced by one retry where it has no candidate
    and the retry has one; nulls where a pass that is asked for was not saved."""
    rows = fold_passes(passes, truth, (baseline, retry))
    known = F.col("missing_stage").isNull()
    none = F.col("method") == NO_CANDIDATE
    return rows.select("image_id", F.when(none, baseline).otherwise(F.col("method")).alias("source"), "final_date",
                       F.when(known, ~none).alias("has_candidate"), F.when(known, F.col("correct")).alias("correct"))
