"""Image step of the parser: tiers, keyword distances, manufacture reference, final rank.

``stage_results(boxes)`` is the whole parser: one row per (image, stage) with the chosen date
and the evidence the cascade decides on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_period, exists_on_calendar, final_date, is_complete, latest_meaning, parts, render
from ..rules import PRODUCTION, RuleSet
from ..rules import constants as C
from . import spatial
from .boxes import COMPACT, PADDED_NEEDS, PADDED_SURE, SIX_NEEDS, SIX_SURE, TEXT, YEARLESS, HINTED, annotate, annotate_lanes, measure, tier_of
from .gathered import gathered, picked
from .groups import KEYS, LANE_KEYS, MAX_GROUP_BOXES, Spread, Together, crowded_images

#: Distinct texts, times rule sets, that are read once and broadcast (of their characters: MAX_SHARED_CHARS); where there are
#: more, every box reads its own text.
MAX_SHARED_TEXTS, MAX_SHARED_CHARS = 200_000, 16_000_000
#: Boxes, times rule sets, that one task of the image step gets on average.
BOXES_PER_TASK = 200_000


def _usable() -> str:
    near = f"d_anchor <= {C.NEAR_HEIGHTS} * if(h = 0, 1.0, h)"
    return f"""filter(tokens, m -> case
        when m.no < {HINTED} then true
        when m.no < {COMPACT} then hint = 'my'
        when m.no < {YEARLESS} then label_near
        when m.no between {SIX_NEEDS} and {PADDED_SURE - 1} or m.no >= {PADDED_NEEDS} then {near}
        else true end)"""


def _choose_tier(rows: DataFrame, groups) -> DataFrame:
    """Keep the tokens of the first tier the image has any usable token in."""
    rows = rows.withColumns({
        "hint": F.expr("case when any_dmy then 'dmy' when any_my then 'my' end"),
        "slash_hint": F.expr("not any_dmy and not any_my and any_slash_dmy and not any_slash_veto"),
    })
    rows = rows.withColumn("usable", F.expr(_usable()))
    rows = rows.withColumn("row_tier", F.expr(f"array_min(transform(usable, m -> {tier_of('m.no')}))"))
    rows = groups.over(rows, tier=F.min("row_tier"))
    # rows without tokens have done their part, apart from one per image that keeps it present
    rows = rows.where((F.size("tokens") > 0) | (F.col("box_index") == F.col("first_box")))
    return rows.withColumn("chosen", F.expr(f"filter(usable, m -> {tier_of('m.no')} = tier)"))


def _readings() -> str:
    """SQL: readings of token ``m`` best first, completed by a neighbouring box where allowed."""
    k = "m.r[0].k"
    ordered = """sort_array(transform(m.r, (q, i) -> named_struct(
        'rank', -if(hint <=> 'dmy' or (slash_hint and m.slash), q.score_dmy, q.score), 'i', i, 'k', q.k)))"""

    def single(value: str) -> str:
        return f"array(named_struct('rank', v[0].rank, 'i', 0, 'k', {value}))"

    first = "v[0].k"
    return f"""transform(array({ordered}), v -> case
        when m.year_month and {first} >= 10000 and {first} % 100 = 0 and day_right is not null
             and {exists_on_calendar(f'({first} div 10000)', f'(({first} div 100) % 100)', 'day_right')}
          then {single(f'{first} + day_right')}
        when m.no between {YEARLESS} and {SIX_SURE - 1} and {first} % 100 > 0 and year_near is not null
             and {exists_on_calendar('year_near', f'(({first} div 100) % 100)', f'({first} % 100)')}
          then {single(f'year_near * 10000 + {first}')}
        else v end)[0]"""


def _candidates(rows: DataFrame, groups) -> DataFrame:
    """Boxes with their candidate dates as array ``c``: as printed (k0), beside the manufacture date of the image (k1)."""
    rows = rows.withColumn("_c", F.expr(
        f"transform(chosen, m -> named_struct('s', m.s, 'own', m.own, 'r', {_readings()}))")).drop("chosen", "usable")
    rows = rows.withColumn("_printed", F.expr(f"""array_min(transform(filter(_c, x -> {is_complete('x.r[0].k')}),
        x -> named_struct('s', x.s, 'k', x.r[0].k)))"""))
    reference = F.min_by("_printed.k", F.when(
        F.expr("has_anchor and has_exclude and _printed is not null and d_exclude < d_anchor"),
        F.struct("d_exclude", "box_index", "_printed.s", "text")))
    rows = groups.found(rows, reference).drop("tokens")
    top = f"""
        if(reference is not null and d_anchor < d_exclude,
           array_min(transform(x.r, (q, i) -> named_struct(
             'rank', q.rank - if({is_complete('q.k')} and q.k > reference, {C.AFTER_MANUFACTURE_BONUS}, 0),
             'i', i, 'k', q.k, 'score', -q.rank))),
           named_struct('rank', 0, 'i', 0, 'k', x.r[0].k, 'score', -x.r[0].rank))"""
    return rows.withColumn("c", F.expr(f"""transform(transform(_c, x -> named_struct('x', x, 'top', {top})), y -> named_struct(
        's', y.x.s, 'own', y.x.own, 'k0', y.x.r[0].k, 'k1', y.top.k, 'score', y.top.score, 'score0', -y.x.r[0].rank))""")).drop("_c", "_printed")


def _pick(rows: DataFrame, groups) -> DataFrame:
    """One row per image: its boxes' candidates are ranked within the box first, so that no row is multiplied."""
    found = F.size("c") > 0

    def leading(order: str, only: str | None = None) -> Column:
        first = f"array_min(transform({{0}}, x -> named_struct({order}, 'x', x))).x"
        return F.expr(f"if(size(c) = 1, get(c, 0), {first.format('c')})" if only is None else first.format(f"filter(c, x -> {only})"))

    k1 = "x.k1"
    rows = rows.withColumns({
        "_best": F.expr(f"""array_min(transform(c, x -> named_struct(
            'a', if(has_anchor, int(x.own), int(not {is_complete(k1)})),
            'd', if(has_anchor, -{latest_meaning(k1)}, if({is_complete(k1)}, -x.k1, 0)), 's', x.s, 'x', x)))"""),
        "_earliest": leading("'k', x.k0, 's', x.s"), "_first": leading("'s', x.s"),
        "_base": F.when(F.size("c") > 1, leading("'s', x.s", "x.k0 >= 10000")).when(F.expr("get(c, 0).k0 >= 10000"), F.get("c", F.lit(0))),
        "_dated": F.expr("transform(filter(c, x -> x.k0 >= 10000), x -> x.k0)")})

    def chosen(candidate: str, k: str = "k0", score: str = "score0"):
        return F.struct(F.col(candidate)[k].alias("k"), "text", "cx", "cy", "anchor", "exclude", "short", "bare", "attempted",
                        "d_anchor", "d_exclude", F.col(candidate)[score].alias("score"))

    rank = F.when(found, F.expr("""named_struct('a', _best.a, 'b', int(has_anchor and d_anchor > d_exclude),
        'c', int(has_anchor and has_primary and has_secondary and not d_primary < d_secondary),
        'd', _best.d, 'e', if(has_anchor, d_anchor, double(0)), 'f', box_index, 'g', _best.s, 'h', text)"""))
    rows = rows.withColumn("_best_one", F.col("_best.x"))
    return rows.groupBy(*groups.keys).agg(
        F.sum(F.size("c").cast("bigint")).alias("n"),
        F.bool_and(F.when(found, F.expr("forall(c, x -> x.own)"))).alias("all_own"),
        F.first("n_texts").alias("n_texts"),
        F.bool_and(F.when(found, F.expr(f"forall(c, x -> {is_complete('x.k0')}) and not exclude and words <> ''"))).alias("all_labelled"),
        F.min(F.when(found, F.col("words"))).alias("words_low"),
        F.max(F.when(found, F.col("words"))).alias("words_high"),
        F.min(F.expr("_earliest.k0")).alias("k_low"), F.max(F.expr("array_max(transform(c, x -> x.k0))")).alias("k_high"),
        F.min(F.array_min("_dated")).alias("base_low"), F.max(F.array_max("_dated")).alias("base_high"),
        F.min_by(chosen("_best_one", "k1", "score"), rank).alias("best"),
        F.min_by(chosen("_earliest"), F.when(found, F.struct("_earliest.k0", "box_index", "_earliest.s", "text"))).alias("earliest"),
        F.min_by(chosen("_base"), F.when(F.col("_base").isNotNull(), F.struct("box_index", "_base.s", "text"))).alias("base"),
        F.min_by(chosen("_first"), F.when(found, F.struct("box_index", "_first.s", "text"))).alias("first"),
        F.first("found_dates").alias("found_dates"),   # bounded by the calendar
        F.first("period_low").alias("period_low"), F.first("period_high").alias("period_high"),
        F.min("tier").alias("tier"), F.max("has_anchor").alias("has_anchor"), F.first("sources").alias("sources"),
    )


def _decide(picks: DataFrame, rule: str) -> DataFrame:
    """rule: SQL of the name of the rule for stated periods."""
    amount, unit = "int(split_part(period_low, ' ', 1))", "split_part(period_low, ' ', 2)"
    period = "base_low is not null and base_low = base_high and period_low = period_high"
    moved = add_period("base.k", amount, unit)
    derived = (f"case {rule} when 'computed' then if({moved} is null, null, struct({moved} as k, base.text, base.cx, base.cy, base.anchor, "
               "base.exclude, base.short, base.bare, base.attempted, base.d_anchor, base.d_exclude, 0 as score)) "
               f"when 'printed_base' then if({moved} is null, null, first) end")
    return picks.withColumn("selected", F.expr(f"""
        case when n = 0 then null
             when all_own then if({period}, {derived}, null)
             when n >= 2 and n_texts = n and all_labelled and words_low = words_high and k_low <> k_high
               then earliest
             else best end"""))


def _evidence(picks: DataFrame, *keep: str) -> DataFrame:
    k = F.col("selected.k")
    names = render(k)
    has = F.col("selected").isNotNull()
    dates = F.transform(F.array_sort("found_dates"), lambda d: final_date(d))
    return picks.select(
        *KEYS, *keep,
        *[F.coalesce(c, F.lit(C.NONE)).alias(n) for n, c in names.items()],
        has.alias("has_candidate"),
        F.when(has, F.col("q")).alias("q"),
        F.when(has, F.size("found_dates") >= 2).alias("many"),
        F.when(has, F.col("selected.short")).alias("short"),
        F.when(has, F.col("selected.bare")).alias("bare"),
        F.when(has, F.expr("""selected.k >= 10000 and selected.k % 100 = 0 and coalesce(
            array_contains(selected.attempted, selected.k div 100), false)""")).alias("damaged_day"),
        F.when(has, F.expr("selected.anchor and not selected.exclude")).alias("self_anchor"),
        F.when(has, F.expr("selected.exclude and not selected.anchor")).alias("self_exclude"),
        F.when(has, F.array_sort(dates)).alias("candidate_dates"),
        F.col("n").alias("n_candidates"), "tier",
        F.when(has, F.col("selected.text")).alias("source_text"),
    )


def _detail(picks: DataFrame) -> DataFrame:
    k, has = F.col("selected.k"), F.col("selected").isNotNull()
    year, month, day = (F.coalesce(p.isNotNull().cast("int"), F.lit(0)) for p in parts(k))
    near = F.col("selected.d_anchor") <= F.col("selected.d_exclude")
    return picks.select(
        *KEYS, F.coalesce(final_date(k), F.lit(C.NONE)).alias("final_date"), has.alias("has_candidate"),
        F.coalesce("selected.text", F.lit("")).alias("source_text"),
        F.coalesce("q_high", F.lit(0.0)).alias("confidence"),
        (has & F.col("has_anchor")).alias("anchor_found"),
        F.when(has & F.col("has_anchor"), F.when(near, 2).otherwise(1)).otherwise(0).alias("anchor_preference"),
        F.when(has & F.col("has_anchor"), F.col("selected.d_anchor")).alias("anchor_distance"),
        (year + month + day).alias("valid_fields"),
        F.coalesce(F.expr(is_complete("selected.k")), F.lit(False)).alias("complete"),
        F.col("selected.score").alias("score"))


def _marked(boxes: DataFrame, groups, rules: RuleSet, texts: DataFrame | None) -> DataFrame:
    rows = groups.prepare(measure(boxes), lambda rows: annotate(rows, rules), texts)
    return _choose_tier(groups.facts(rows), groups)


def _run(boxes: DataFrame, groups, rules: RuleSet, view, texts: DataFrame | None) -> DataFrame:
    if isinstance(groups, Together):
        return view(picked(gathered(measure(boxes), rules, texts, groups.parts), f"'{rules.period}'"))
    rows = _marked(boxes, groups, rules, texts)
    picks = _decide(_pick(_candidates(rows, groups), groups), f"'{rules.period}'")
    return view(groups.source_confidence(rows, picks))


def _run_lanes(boxes: DataFrame, groups, lanes: dict[RuleSet, list[str]], texts: DataFrame | None) -> DataFrame:
    rows = groups.prepare(measure(boxes), lambda rows: annotate_lanes(rows, list(lanes)), texts)
    rows = _choose_tier(groups.facts(rows), groups)
    periods = F.array(*[F.array(*[F.lit(p) for p in names]) for names in lanes.values()])
    picks = _pick(_candidates(rows, groups), groups).withColumn("period", F.explode(F.get(periods, F.col("lane"))))
    return _evidence(groups.source_confidence(rows, _decide(picks, "period")), "lane", "period")


def _candidate_rows(boxes: DataFrame, groups, rules: RuleSet, texts: DataFrame | None) -> DataFrame:
    if isinstance(groups, Together):
        rows = gathered(measure(boxes), rules, texts, groups.parts)
        found = rows.select(*KEYS, F.col("g.tier").alias("tier"), F.inline("g.candidates")).select("*", "x.box_index", "x.text", "x.confidence")
    else:
        found = _candidates(_marked(boxes, groups, rules, texts), groups).select("*", F.inline("c"))
    return found.select(
        *KEYS, "box_index", F.col("s").alias("start"), "text", "confidence", "tier", F.col("own").alias("self_excluded"),
        final_date(F.col("k0")).alias("printed_date"), final_date(F.col("k1")).alias("final_date"), "score",
        *[F.when(F.col(d) < F.expr("double('infinity')"), F.col(d)).alias(d) for d in ("d_anchor", "d_exclude")])


def candidate_rows(boxes: DataFrame, rules: RuleSet = PRODUCTION, **options) -> DataFrame:
    """One row per candidate date of the tier that counts in its (image, stage): where it is printed, its best reading, that
    reading beside a manufacture date (final_date), its score and its distances to the nearest words of both kinds."""
    return _parse(boxes, lambda part, groups, texts: _candidate_rows(part, groups, rules, texts), **options)


def candidate_detail(boxes: DataFrame, rules: RuleSet = PRODUCTION, **options) -> DataFrame:
    """One row per (image, stage) with the evidence of its chosen candidate: text, highest confidence among the boxes with
    that text and centre, preference (2 nearer to an expiry word than to a manufacture word, 1 farther, 0 without expiry
    word), distance to the nearest expiry word, known parts, completeness and score of the reading."""
    return _parse(boxes, lambda part, groups, texts: _run(part, groups, rules, _detail, texts), **options)


def stage_results(boxes: DataFrame, rules: RuleSet = PRODUCTION, **options) -> DataFrame:
    """Date and evidence of every (image, stage) in a box table; options as in :func:`_parse`."""
    return _parse(boxes, lambda part, groups, texts: _run(part, groups, rules, _evidence, texts), **options)


def stage_results_of_lanes(boxes: DataFrame, lanes: dict[RuleSet, list[str]], **options) -> DataFrame:
    """(lane, period, ...): :func:`stage_results` under several rule sets from one scan of the boxes. lanes: rule sets that read
    tokens in different ways, each with the rules for stated periods to decide by; their number in this order is ``lane``."""
    return _parse(boxes, lambda part, groups, texts: _run_lanes(part, groups, lanes, texts), keys=LANE_KEYS, copies=len(lanes), **options)


def _parse(boxes: DataFrame, run, *, crowded: DataFrame | bool | None = None, max_group_boxes: int = MAX_GROUP_BOXES,
           share_texts: bool | None = None, keys=KEYS, copies: int = 1) -> DataFrame:
    """``run`` on the boxes of all images.

    ``crowded`` tells which images hold more boxes than one task should keep together: a
    table with ``image_id``, ``False`` when the caller knows there are none, or ``None`` to
    count (one pass over the key column).  ``share_texts`` tells whether every distinct text is read once
    and broadcast, or ``None`` to count them (one pass over the text column): labels, dates and lots repeat.
    Both ways give the same rows.
    """
    if crowded is None:
        crowded = crowded_images(boxes, max_group_boxes)
        if crowded.isEmpty():
            crowded = False
    texts = measure(boxes).groupBy(*TEXT).agg(F.count("*").alias("n"))
    parts = None
    if share_texts is None:
        texts = spatial.cut(texts)   # counted and, where shared, told from there: the boxes are read for it once
        size = texts.agg(F.count("*").alias("texts"), F.sum("n").alias("boxes"), F.sum(F.length("text")).alias("chars")).first()
        share_texts = bool(size.texts) and size.texts * 2 <= size.boxes and size.texts * copies <= MAX_SHARED_TEXTS and size.chars <= MAX_SHARED_CHARS
        parts = -(-(size.boxes or 0) * copies // BOXES_PER_TASK)
        parts = parts if parts > int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    shared = texts.drop("n") if share_texts else None
    together = Together(keys, parts)
    if crowded is False:
        return run(boxes, together, shared)
    ids = crowded.select("image_id").distinct()
    plain = boxes.join(ids, "image_id", "left_anti")
    dense = boxes.join(ids, "image_id", "left_semi")
    return run(plain, together, shared).unionByName(run(dense, Spread(keys), shared))


def parse_dates(boxes: DataFrame, rules: RuleSet = PRODUCTION, **options) -> DataFrame:
    """(image_id, stage, year, month, day, final_date), unknown parts as ``NONE``."""
    return stage_results(boxes, rules, **options).select(*KEYS, "year", "month", "day", "final_date")
