"""Row step of the parser: everything one text box tells by itself.

No shuffle happens here.  The result is one slim row per box whose ``tokens`` column holds
the date tokens of every tier, so that the image step only moves what it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.geometry import box_geometry
from ..functions.text import MATCH_MARK
from ..functions.tokens import days_in_month, matches, with_token_lanes, with_tokens
from ..rules import PRODUCTION, RuleSet
from ..rules import constants as C
from ..rules import patterns as P

# token numbers: which tier a token belongs to (see ``tier_of``); SURE/NEEDS says whether the
# box itself gives the evidence a fallback needs, or an anchor box has to be close
HINTED, COMPACT, YEARLESS = 100, 200, 300
SIX_SURE, SIX_NEEDS, PADDED_SURE, PADDED_NEEDS = 400, 450, 500, 550

EMPTY_TOKENS = ("cast(array() as array<struct<s:int,e:int,no:int,own:boolean,year_month:boolean,"
                "slash:boolean,r:array<struct<k:int,score:int,score_dmy:int>>>>)")


def tier_of(no: str) -> str:
    return (f"(case when {no} < {COMPACT} then 1 when {no} < {YEARLESS} then 2 "
            f"when {no} < {SIX_SURE} then 3 when {no} < {PADDED_SURE} then 4 else 5 end)")


def _nearest_word_is_exclude() -> str:
    """SQL: among the words of both kinds in the box, the one closest to the token excludes it."""
    def closest(spans: str) -> str:
        return (f"array_min(transform({spans}, w -> case when w.e <= m.s then 2 * (m.s - w.e) "
                f"when w.s >= m.e then 2 * (w.s - m.e) + 1 else 0 end))")
    return f"{closest('exclude_spans')} <= {closest('anchor_spans')}"


def measure(boxes: DataFrame) -> DataFrame:
    """The slim form of a box table: polygons become centre, edges and height."""
    return boxes.select(
        "image_id", "stage", "box_index", F.coalesce(F.col("text"), F.lit("")).alias("text"), "confidence",
        (F.coalesce(F.size("bbox"), F.lit(0)) > 0).alias("placed"),
        *[c.alias(n) for n, c in box_geometry(F.col("bbox")).items()])


#: What a box tells by its place, and what the reading of its text depends on.
PLACE = ("image_id", "stage", "box_index", "confidence", "cx", "cy", "x0", "x1", "h")
TEXT = ("text", "placed")


def _worded(measured: DataFrame) -> DataFrame:
    """What no rule set changes about a box: its repaired texts and word flags."""
    df = measured.withColumn("t", TX.clean(F.col("text")))
    df = df.withColumn("up", F.upper("t")).withColumn("digits", F.col("t").rlike(r"(?U)\d"))
    df = df.withColumn("repaired", F.when(F.col("digits"), TX.repair(F.col("t"))).otherwise(F.col("t")))
    df = df.withColumn("masked", TX.mask_clocks(F.col("repaired")))
    return df.withColumns({
        "anchor": F.col("up").rlike(TX.ANCHOR_REGEX),
        "exclude": F.col("up").rlike(TX.EXCLUDE_REGEX),
        "primary": F.col("up").rlike(TX.PRIMARY_REGEX),
        "yearless_text": F.regexp_replace("repaired", *P.YEARLESS_HOUR),
    })


def _sources(rules: RuleSet) -> list:
    """Texts and patterns of every tier; a fallback only counts where the box has no dated token."""
    return [
        ("masked", rules.patterns, 0, 1),
        ("t", P.HINTED_PATTERNS if rules.hinted_word else P.HINTED_PATTERNS[:1], HINTED, 1),
        ("t", P.COMPACT_PATTERNS, COMPACT, 2),
        ("yearless_text" if rules.yearless_hour else "repaired", P.YEARLESS_PATTERNS, YEARLESS, 3),
        ("t", P.SIX_DIGIT_PATTERNS if rules.six_digit else (), SIX_SURE, 4),
        ("t", P.PADDED_PATTERNS, PADDED_SURE, 5),
    ]


def _until(rules: RuleSet) -> str:
    return f"substring(t, m.e + 1) rlike r'{rules.until_after}'"


def annotate(measured: DataFrame, rules: RuleSet = PRODUCTION) -> DataFrame:
    """One row per box: word flags, format hints and date tokens of every tier. ``measured`` may also hold the distinct
    texts alone (``TEXT``): nothing here depends on the place of a box."""
    df = with_tokens(_worded(measured), _sources(rules), rules, only=F.col("placed") & F.col("digits"),
                     out="all_tokens", attempts="attempted")
    return _described(df, _until(rules), rules)


def main_dates(measured: DataFrame, *keep: str, rules: RuleSet = PRODUCTION) -> DataFrame:
    """(keep, n): how many dates of the main table a box holds, the tokens of :func:`annotate` numbered below HINTED. They
    claim their spans before all others, so no other source is read, and a text without a digit is only searched for one."""
    df = measured.withColumn("t", TX.clean(F.col("text"))).withColumn("digits", F.col("t").rlike(r"(?U)\d"))
    read = F.col("placed") & F.col("digits")
    df = df.withColumn("masked", F.when(read, TX.mask_clocks(TX.repair(F.col("t")))))
    df = with_tokens(df, _sources(rules)[:1], rules, only=read, out="main", attempts="attempted")
    return df.select(*keep, F.when(read, F.size("main")).otherwise(0).alias("n"))


def annotate_lanes(measured: DataFrame, lanes: list[RuleSet]) -> DataFrame:
    """One row per box and rule set, as :func:`annotate` gives it for each, with its number as ``lane``.

    Texts are repaired, worded and matched once, against the union of all patterns.
    """
    if len({(r.year_min, r.year_max) for r in lanes}) > 1:
        raise ValueError("rule sets beside each other share their year window")
    df = with_token_lanes(_worded(measured), [(_sources(r), r) for r in lanes], only=F.col("placed") & F.col("digits"), out="_lanes")
    df = df.select("*", F.explode_outer("_lanes").alias("_lane")).withColumns({
        "all_tokens": F.col("_lane.tokens"), "attempted": F.col("_lane.attempted"), "lane": F.col("_lane.lane")})
    until = {}
    for i, r in enumerate(lanes):
        until.setdefault(_until(r), []).append(str(i))
    cases = " ".join(f"when lane in ({', '.join(n)}) then {u}" for u, n in until.items())
    return _described(df.drop("_lanes", "_lane"), f"(case {cases} end)", lanes[0])


def _described(df: DataFrame, ends_until: str, rules: RuleSet) -> DataFrame:
    # per token: does its own box exclude it, may a day box complete it, is it a short slash date
    both = F.col("anchor") & F.col("exclude") & (F.size("all_tokens") > 0)
    words = {"anchor_words": TX.ANCHOR_REGEX, "exclude_words": TX.EXCLUDE_REGEX}
    df = df.withColumns({n: F.when(both, framed_words(F.col("up"), r)) for n, r in words.items()})
    df = df.withColumns({"anchor_spans": matches("anchor_words"), "exclude_spans": matches("exclude_words")})
    until = f"(anchor or {ends_until})"
    labelled = f"substring(up, 1, m.s) rlike r'{P.LABEL_BEFORE}'"
    df = df.withColumn("tokens", F.expr(f"""
      if(coalesce(size(all_tokens), 0) <= 0, {EMPTY_TOKENS}, transform(all_tokens, m -> named_struct(
        's', m.s, 'e', m.e,
        'no', case m.tier when 4 then m.no + if({until}, 0, {SIX_NEEDS - SIX_SURE})
                          when 5 then m.no + if({until} or {labelled}, 0, {PADDED_NEEDS - PADDED_SURE})
                          else m.no end,
        'own', exclude and (not anchor or m.no between {COMPACT} and {SIX_SURE - 1}
                            or coalesce({_nearest_word_is_exclude()}, true)),
        'year_month', m.no < {COMPACT} and size(m.g) = 2 and length(m.g[0]) = 4
                      and m.g[0] rlike r'(?U)^[\\dOoUu]+$' and t rlike r'{P.YEAR_MONTH_AT_END}',
        'slash', m.no < {HINTED} and array_contains(
            regexp_extract_all(t, r'{P.SHORT_SLASH}', 0), concat_ws('/', m.g)),
        'r', m.r)))"""))

    # what the image as a whole learns from this box
    def number_if(regex: str):
        return F.when(F.col("t").rlike(regex), F.regexp_extract("t", regex, 1).cast("int"))

    long_dates = F.expr(f"""
      zip_with(regexp_extract_all(t, r'{P.LONG_SLASH}', 1), regexp_extract_all(t, r'{P.LONG_SLASH}', 2),
        (a, b) -> named_struct('a', int(a), 'b', int(b)))""")
    years = F.expr(f"transform(regexp_extract_all(t, r'{P.LONG_SLASH}', 3), y -> int(y))")
    df = df.withColumns({"may_hint": F.col("up").rlike("월|MM|MONAT|MONTH"),
                         "_long": F.when(F.col("t").contains("/"), long_dates),
                         "_years": F.when(F.col("t").contains("/"), years)})
    has_tokens = F.size("tokens") > 0
    return df.select(
        *[c for c in (*PLACE, *TEXT, "lane") if c in df.columns],
        "anchor", "exclude", "primary", "tokens",
        F.when(has_tokens, F.col("attempted")).alias("attempted"),
        F.when(has_tokens & F.col("anchor"), TX.words_found(F.col("up"), C.ANCHOR_WORDS))
         .when(has_tokens, F.lit("")).alias("words"),
        F.when(has_tokens, TX.squeezed_length(F.col("t")) <= C.SHORT_TEXT_CHARS).alias("short"),
        F.when(has_tokens, F.col("t").rlike(P.BARE_DATE)).alias("bare"),
        (F.col("may_hint") & TX.matches_any(F.col("t"), P.DAY_FIRST_HINTS)).alias("hint_dmy"),
        (F.col("may_hint") & TX.matches_any(F.col("t"), P.MONTH_YEAR_HINTS)).alias("hint_my"),
        (F.col("t").rlike(P.YEAR_FIRST_SLASH) | F.expr(
            "coalesce(exists(_long, x -> x.a between 1 and 12 and x.b between 13 and 31), false)"
        )).alias("slash_veto"),
        F.expr(f"""coalesce(exists(zip_with(_long, _years, (x, y) ->
            x.a > 12 and y between {rules.year_min} and {rules.year_max}
            and x.b between 1 and 12 and x.a <= {days_in_month('y', 'x.b')}), z -> z), false)""").alias("slash_dmy"),
        F.when(F.col("placed") & F.col("digits"), number_if(P.LONE_DAY)).alias("lone_day"),
        F.when(F.col("placed") & F.col("digits"), _year_in(rules)).alias("lone_year"),
        (F.col("placed") & TX.is_expiry_label(F.col("t"))).alias("label"),
        F.when(F.col("t").contains("제조일"), F.expr(f"""zip_with(
            regexp_extract_all(t, r'{P.PERIOD}', 1), regexp_extract_all(t, r'{P.PERIOD}', 2),
            (n, u) -> concat(n, ' ', u))""")).alias("periods"),
    )


def date_tokens(annotated: DataFrame, *keep: str) -> DataFrame:
    """One row per token as struct ``t``.

    The outer form matters: a plain explode makes the optimizer push a size filter below the
    projections that compute the tokens, and so compute them twice.
    """
    return annotated.select(*keep, F.explode_outer("tokens").alias("t")).where("t is not null")


def _year_in(rules: RuleSet):
    year = F.regexp_extract("t", P.LONE_YEAR, 1).cast("int")
    return F.when(F.col("t").rlike(P.LONE_YEAR) & year.between(rules.year_min, rules.year_max), year)


def framed_words(text, regex: str):
    """Framed text of one word expression, in the shape ``matches`` reads."""
    framed = F.regexp_replace(text, regex, f"{MATCH_MARK}$0{MATCH_MARK}")
    return F.array(F.struct(F.lit(0).alias("no"), framed.alias("marked")))


def stage_texts(boxes: DataFrame) -> DataFrame:
    """(image_id, stage, texts): the texts of a stage in the order of its boxes, joined; one row holds one stage's boxes."""
    ordered = F.array_sort(F.collect_list(F.struct("box_index", "text")))
    return boxes.groupBy("image_id", "stage").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), " | ").alias("texts"))
