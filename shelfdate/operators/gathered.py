"""Image step of ordinary images: the boxes of an (image, stage) gathered into one row and decided there.

A box moves once, into the array of its group. What the image knows (words, hints, periods) is aggregated beside the array,
and the steps of :mod:`.select` follow each other within one expression, so no wide row is copied from step to step, and what
a group does not need (distances without a keyword, neighbours that complete a date) is not worked out. Crowded groups and
lanes of rule sets keep to the rows of :mod:`.select`; a test compares both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_period, exists_on_calendar, is_complete, latest_meaning
from ..rules import RuleSet
from ..rules import constants as C
from .boxes import COMPACT, HINTED, PADDED_NEEDS, PADDED_SURE, SIX_NEEDS, SIX_SURE, YEARLESS, annotate, tier_of
from .groups import INF, KEYS, image_flags, slim, told

#: What a box brings into the array of its group.
BOX = ("box_index", "text", "confidence", "placed", "cx", "cy", "x0", "x1", "h", "anchor", "exclude", "primary", "label", "lone_day",
       "lone_year", "tokens", "attempted", "words", "short", "bare")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _far(a: str, b: str) -> str:
    return f"sqrt(({a}.cx - {b}.cx) * ({a}.cx - {b}.cx) + ({a}.cy - {b}.cy) * ({a}.cy - {b}.cy))"


def _nearest(points: str) -> str:
    """SQL: distance from box ``x`` to the nearest of ``points`` (null: none there)."""
    return f"coalesce(array_min(transform({points}, p -> {_far('x', 'p')})), {INF})"


def _placed(flag: str, kind: str) -> str:
    return f"if({flag}, filter(b, x -> x.placed and {kind}), null)"


def _around() -> str:
    """SQL: dated box ``x`` with the facts of its neighbours that a date of it may need."""
    reach = f"{C.NEAR_HEIGHTS} * if(x.h = 0, 1.0, x.h)"
    label = f"if(has_label, exists(at.label, p -> abs(x.cy - p.cy) <= x.h and {_far('x', 'p')} <= {C.NEAR_HEIGHTS} * x.h), false)"
    year = f"""if(has_year, array_min(filter(transform(at.year, p -> named_struct('d', {_far('x', 'p')}, 'b', p.box_index, 'y', p.lone_year)),
        q -> q.d <= {reach})).y, null)"""
    right = """filter(at.day, p -> p.confidence >= x.confidence and p.x0 - x.x1 between 0 and x.h
        and p.h between 0.5 * x.h and 1.5 * x.h and abs(p.cy - x.cy) <= 0.4 * x.h)"""
    day = f"if(has_day and x.h > 0 and x.x1 - x.x0 > x.h, {_let('days', right, 'if(size(days) = 1, days[0].lone_day, null)')}, null)"
    return f"""named_struct('x', x, 'd_anchor', {_nearest('at.anchor')}, 'd_exclude', {_nearest('at.exclude')}, 'label_near', {label},
        'year_near', {year}, 'day_right', {day}, 'reach', {reach})"""


def _usable() -> str:
    """SQL: token ``m`` of box ``e`` counts; the main patterns always do."""
    return f"""case when m.no < {HINTED} then true when m.no < {COMPACT} then hint = 'my' when m.no < {YEARLESS} then e.label_near
        when m.no between {SIX_NEEDS} and {PADDED_SURE - 1} or m.no >= {PADDED_NEEDS} then e.d_anchor <= e.reach else true end"""


def _readings() -> str:
    """SQL: readings of token ``m`` best first, completed by a neighbouring box where allowed."""
    rank = "-if(hint <=> 'dmy' or (slash_hint and m.slash), q.score_dmy, q.score)"
    read = f"transform(m.r, (q, i) -> named_struct('rank', {rank}, 'i', i, 'k', q.k))"
    ordered = f"if(size(m.r) = 1, {read}, sort_array({read}))"

    def single(value: str) -> str:
        return f"array(named_struct('rank', v[0].rank, 'i', 0, 'k', {value}))"

    k = "v[0].k"
    body = f"""case
        when m.year_month and {k} >= 10000 and {k} % 100 = 0 and e.day_right is not null
             and {exists_on_calendar(f'({k} div 10000)', f'(({k} div 100) % 100)', 'e.day_right')} then {single(f'{k} + e.day_right')}
        when m.no between {YEARLESS} and {SIX_SURE - 1} and {k} % 100 > 0 and e.year_near is not null
             and {exists_on_calendar('e.year_near', f'(({k} div 100) % 100)', f'({k} % 100)')} then {single(f'e.year_near * 10000 + {k}')}
        else v end"""
    return _let("v", ordered, body)


def _reference() -> str:
    """SQL: the manufacture date printed nearest to a manufacture word, null where nothing competes with it."""
    printed = f"""array_min(transform(filter(t.c, m -> {is_complete('m.r[0].k')}), m -> named_struct('s', m.s, 'k', m.r[0].k)))"""
    nearer = f"transform(filter(dated, t -> t.e.d_exclude < t.e.d_anchor), t -> named_struct('e', t.e, 'p', {printed}))"
    return f"""if(has_anchor and has_exclude, array_min(transform(filter({nearer}, q -> q.p is not null), q -> named_struct(
        'd', q.e.d_exclude, 'b', q.e.x.box_index, 's', q.p.s, 't', q.e.x.text, 'k', q.p.k))).k, null)"""


def _candidate() -> str:
    """SQL: candidate of token ``m`` of box ``t``: as printed (k0), and beside the manufacture date of the image (k1)."""
    beside = f"""if(reference is not null and t.e.d_anchor < t.e.d_exclude, array_min(transform(m.r, (q, i) -> named_struct(
        'rank', q.rank - if({is_complete('q.k')} and q.k > reference, {C.AFTER_MANUFACTURE_BONUS}, 0), 'i', i, 'k', q.k, 'score', -q.rank))),
        named_struct('rank', 0, 'i', 0, 'k', m.r[0].k, 'score', -m.r[0].rank))"""
    return _let("top", beside, """named_struct('s', m.s, 'own', m.own, 'k0', m.r[0].k, 'k1', top.k, 'score', top.score, 'score0', -m.r[0].rank,
        'd_anchor', t.e.d_anchor, 'd_exclude', t.e.d_exclude, 'x', t.e.x)""")


def gathered(measured: DataFrame, rules: RuleSet, texts: DataFrame | None, parts: int | None) -> DataFrame:
    """(image_id, stage, tier, has_anchor, period_low, period_high, dated, candidates): one row per group with its dated boxes
    (text, place, confidence) and the candidates of the tier that counts."""
    spread = ([] if parts is None else [parts]) + ["image_id"]
    if texts is None:
        rows = slim(annotate(measured, rules)).repartition(*spread)
    else:
        rows = slim(told(measured.repartition(*spread), annotate(texts, rules)))
    facts = {n: a for n, a in image_flags().items() if n != "first_box"} | {
        "has_label": F.max(F.col("placed") & F.col("label")), "has_year": F.max(F.col("placed") & F.col("lone_year").isNotNull()),
        "has_day": F.max(F.col("placed") & F.col("lone_day").isNotNull())}
    groups = rows.groupBy(*KEYS).agg(F.collect_list(F.struct(*BOX)).alias("b"), *[a.alias(n) for n, a in facts.items()])
    groups = groups.select("*", F.expr("case when any_dmy then 'dmy' when any_my then 'my' end").alias("hint"),
                           F.expr("not any_dmy and not any_my and any_slash_dmy and not any_slash_veto").alias("slash_hint"))
    at = {"anchor": ("has_anchor", "x.anchor"), "exclude": ("has_exclude", "x.exclude"), "label": ("has_label", "x.label"),
          "year": ("has_year", "x.lone_year is not null"), "day": ("has_day", "x.lone_day is not null")}
    points = "named_struct(" + ", ".join(f"'{n}', {_placed(*p)}" for n, p in at.items()) + ")"
    near = _let("at", points, f"transform(filter(b, x -> size(x.tokens) > 0), x -> {_around()})")
    tier = f"array_min(transform(near, e -> array_min(transform(filter(e.x.tokens, m -> {_usable()}), m -> {tier_of('m.no')}))))"
    chosen = f"""filter(transform(near, e -> named_struct('e', e, 'c', transform(
        filter(e.x.tokens, m -> {tier_of('m.no')} = tier and {_usable()}),
        m -> named_struct('s', m.s, 'own', m.own, 'r', {_readings()})))), t -> size(t.c) > 0)"""
    listed = f"flatten(transform(dated, t -> transform(t.c, m -> {_candidate()})))"
    places = "transform(near, e -> named_struct('text', e.x.text, 'cx', e.x.cx, 'cy', e.x.cy, 'confidence', e.x.confidence))"
    row = _let("near", near, _let("tier", tier, _let("dated", chosen, _let("reference", _reference(), f"named_struct('tier', tier, 'dated', {places}, 'candidates', {listed})"))))
    second = {"primary_at": "if(has_anchor and has_primary and has_secondary, transform(filter(b, x -> x.placed and x.primary), x -> struct(x.cx, x.cy)), null)",
              "secondary_at": """if(has_anchor and has_primary and has_secondary,
                  transform(filter(b, x -> x.placed and x.anchor and not x.primary), x -> struct(x.cx, x.cy)), null)"""}
    return groups.select(*KEYS, "has_anchor", "period_low", "period_high", F.expr(row).alias("g"), *[F.expr(e).alias(n) for n, e in second.items()])


def picked(groups: DataFrame, rule: str) -> DataFrame:
    """The chosen candidate of every group as ``selected``, in the shape that ``_evidence`` and ``_detail`` of :mod:`.select` read."""
    fields = "'text', {0}.x.text, 'cx', {0}.x.cx, 'cy', {0}.x.cy, 'anchor', {0}.x.anchor, 'exclude', {0}.x.exclude, 'short', {0}.x.short, " \
             "'bare', {0}.x.bare, 'attempted', {0}.x.attempted, 'd_anchor', {0}.d_anchor, 'd_exclude', {0}.d_exclude"

    def taken(y: str, k: str, score: str) -> str:
        return f"named_struct('k', {k}, {fields.format(y)}, 'score', {score})"

    def lowest(rank: str, only: str | None = None) -> str:
        """SQL: the candidate of lowest rank; equal ranks are told apart by its own fields."""
        listed = "c" if only is None else f"filter(c, x -> {only})"
        return f"if(size(c) = 1, c[0], array_min(transform({listed}, y -> named_struct({rank}, 'z', y))).z)"

    k1 = "y.k1"
    second = "has_anchor and primary_at is not null and not {} < {}".format(*(
        _nearest(p).replace("x.", "y.x.") for p in ("primary_at", "secondary_at")))
    best = lowest(f"""'a', if(has_anchor, int(y.own), int(not {is_complete(k1)})), 'b', int(has_anchor and y.d_anchor > y.d_exclude),
        'c', int({second}), 'd', if(has_anchor, -{latest_meaning(k1)}, if({is_complete(k1)}, -y.k1, 0)),
        'e', if(has_anchor, y.d_anchor, double(0)), 'f', y.x.box_index, 'g', y.s, 'h', y.x.text""")
    earliest = lowest("'k', y.k0, 'b', y.x.box_index, 's', y.s, 't', y.x.text")
    place = "'b', y.x.box_index, 's', y.s, 't', y.x.text"
    amount, unit = "int(split_part(period_low, ' ', 1))", "split_part(period_low, ' ', 2)"
    moved = add_period("y.k0", amount, unit)
    dated = "filter(c, y -> y.k0 >= 10000)"
    same_base = f"exists({dated}, y -> true) and array_min(transform({dated}, y -> y.k0)) = array_max(transform({dated}, y -> y.k0))"
    base = f"array_min(transform({dated}, y -> named_struct({place}, 'z', y))).z"
    shown = _let("o", lowest(place), taken("o", "o.k0", "o.score0"))
    derived = f"case {rule} when 'computed' then {taken('y', moved, '0')} when 'printed_base' then {shown} end"
    derived = _let("y", base, f"if({moved} is null, null, {derived})")
    labelled = f"""size(c) >= 2 and forall(c, y -> {is_complete('y.k0')} and not y.x.exclude and y.x.words <> '' and y.x.words = c[0].x.words)
        and exists(c, y -> y.k0 <> c[0].k0) and size(array_distinct(transform(c, y -> y.x.text))) = size(c)"""
    selected = f"""case when size(c) = 0 then null
        when forall(c, y -> y.own) then if(period_low = period_high and {same_base}, {derived}, null)
        when {labelled} then {_let('o', earliest, taken('o', 'o.k0', 'o.score0'))}
        else {_let('o', best, taken('o', 'o.k1', 'o.score'))} end"""
    same = """transform(filter(g.dated, p -> p.text = sel.text and p.cx = sel.cx and p.cy = sel.cy), p -> p.confidence)"""
    row = _let("c", "g.candidates", _let("sel", selected, _let("same", same, """named_struct('selected', sel, 'q', array_min(same),
        'q_high', array_max(same), 'n', bigint(size(c)), 'found_dates', array_distinct(transform(c, y -> y.k0)))""")))
    return groups.select(*KEYS, "has_anchor", F.col("g.tier").alias("tier"), F.expr(row).alias("_p")).select(*KEYS, "has_anchor", "tier", "_p.*")
