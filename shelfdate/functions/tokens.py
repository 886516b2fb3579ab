"""Date tokens of a text, as native Spark expressions.

A pattern table is run against one text column in three steps, all inside the row:

1. every pattern frames its matches and their fields with one ``regexp_replace``; splitting
   on the frame marks gives fields and spans together,
2. each match gets every valid (year, month, day) reading with its scores,
3. matches with a reading claim their span in pattern order.

A reading keeps its date in one integer, ``year * 10000 + month * 100 + day`` with 0 for an
unknown part, so that readings compare and aggregate as plain numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import RuleSet
from ..rules import constants as C
from ..rules.patterns import DatePattern
from .text import ASCII_OF_OTHER_DIGITS, FIELD_MARK, MATCH_MARK, OTHER_DIGITS

MATCH_TYPE = "array<struct<no:int,s:int,e:int,g:array<string>>>"
TOKEN_TYPE = ("array<struct<s:int,e:int,no:int,tier:int,g:array<string>,"
              "r:array<struct<k:int,score:int,score_dmy:int>>>>")


def guards(text: str) -> dict[str, Column]:
    """Cheap markers per row; a pattern that needs one is skipped where it is absent."""
    month = "|".join((*C.MONTHS, *C.MISREAD_MONTHS))
    return {
        "has_month": F.col(text).rlike(rf"(?iU){month}"),
        "has_comma": F.col(text).contains(","),
        "has_month_unit": F.col(text).contains("월"),
        "has_label": F.col(text).rlike("(?i)EXP|BB"),
    }


GUARD_OF = {"month": "has_month", ",": "has_comma", "월": "has_month_unit", "label": "has_label"}


def marked_texts(text: Column, patterns, first: int) -> list[Column]:
    """struct<no, marked> per pattern: the text with its matches and their fields framed."""
    rows = []
    for no, pattern in enumerate(patterns, first):
        fields = FIELD_MARK.join(f"${i + 1}" for i in range(len(pattern.kinds)))
        marked = F.regexp_replace(text, pattern.regex, f"{MATCH_MARK}$0{FIELD_MARK}{fields}{MATCH_MARK}")
        if pattern.needs:
            marked = F.when(F.col(GUARD_OF[pattern.needs]), marked)
        rows.append(F.struct(F.lit(no).alias("no"), marked.alias("marked")))
    return rows


def matches(hits: str) -> Column:
    """array<struct<no, s, e, g>> from a column of framed texts that hold a match."""
    return F.expr(f"""
      flatten(transform({hits}, h -> aggregate(
        split(h.marked, '\\u0001', -1),
        named_struct('pos', 0, 'inside', false, 'out', cast(array() as {MATCH_TYPE})),
        (a, piece) -> if(a.inside,
          named_struct(
            'pos', a.pos + length(split_part(piece, '\\u0002', 1)), 'inside', false,
            'out', array_append(a.out, named_struct(
              'no', h.no, 's', a.pos, 'e', a.pos + length(split_part(piece, '\\u0002', 1)),
              'g', slice(split(piece, '\\u0002', -1), 2, 3)))),
          named_struct('pos', a.pos + length(piece), 'inside', true, 'out', a.out)),
        a -> a.out)))""")


def _sql_array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def trimmed(found: str, kinds: str, rules: RuleSet) -> str:
    """SQL: drop triples with the year in the middle, cut a third digit off a day."""
    first = "length(m.g[0]) in (2, 4)" if rules.trim_two_digit_first else "length(m.g[0]) = 4"
    return f"""
      transform(
        filter({found}, m -> not (element_at({kinds}, m.no + 1) = 'nnn'
                                  and length(m.g[1]) = 4 and length(m.g[0]) <= 2)),
        m -> named_struct('no', m.no, 's', m.s, 'e', m.e, 'g', transform(
          if(element_at({kinds}, m.no + 1) = 'nnn' and {first} and length(m.g[2]) = 3,
             array(m.g[0], m.g[1], left(m.g[2], 2)), m.g),
          x -> if(octet_length(x) = length(x), x,
                  translate(x, '{OTHER_DIGITS}', '{ASCII_OF_OTHER_DIGITS}')))))"""


def _month_map() -> str:
    pairs = {name: i + 1 for i, name in enumerate(C.MONTHS)} | C.MISREAD_MONTHS
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")"


def _score(order: str, table: dict[str, int]) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    return f"(case {order} {cases} else 0 end)"


def days_in_month(year: str, month: str) -> str:
    """SQL for the length of a month; an unknown (null) year counts as a leap year."""
    return (f"(case when {month} in (4, 6, 9, 11) then 30 when {month} <> 2 then 31 "
            f"when {year} is null or ({year} % 4 = 0 and ({year} % 100 <> 0 or {year} % 400 = 0)) "
            f"then 29 else 28 end)")


ZEROED = f"translate(x, '{C.ZERO_LETTERS}', '{'0' * len(C.ZERO_LETTERS)}')"
ONED = (f"translate(x, '{C.ZERO_LETTERS}{C.ONE_LETTERS}', "
        f"'{'0' * len(C.ZERO_LETTERS)}{'1' * len(C.ONE_LETTERS)}')")


def readings(match: str, kinds: str, orders: str, rules: RuleSet) -> str:
    """SQL: all distinct valid readings of one match."""
    low, high = rules.year_min, rules.year_max

    # the fields as numbers or months
    fields = f"""
      transform(array(element_at({kinds}, {match}.no + 1)), kinds -> named_struct('kinds', kinds, 'f',
        transform(
          transform({match}.g, (x, i) -> case substr(kinds, i + 1, 1)
            when 'n' then named_struct('n', {ZEROED}, 'mon', cast(null as int), 'plain', true)
            when 'd' then named_struct('n', {ONED}, 'mon', cast(null as int), 'plain', false)
            else named_struct('n', cast(null as string),
                              'mon', try_element_at({_month_map()}, upper(x)), 'plain', false) end),
          z -> named_struct('len', length(z.n), 'v', try_cast(z.n as int), 'mon', z.mon, 'plain', z.plain))))"""

    # every order of the fields whose parts are all in range
    parts = f"""
      transform({fields}, t -> named_struct('names', t.kinds rlike '[mc]', 'r',
        filter(transform(
          transform(element_at({orders}, {match}.no + 1), o -> named_struct('o', o,
            'y', get(t.f, instr(o, 'Y') - 1), 'm', get(t.f, instr(o, 'M') - 1), 'd', get(t.f, instr(o, 'D') - 1))),
          q -> named_struct('o', q.o, 'four', coalesce(q.y.plain and q.y.len = 4, false),
            'y', case when q.y.len = 4 and q.y.v between {low} and {high} then q.y.v
                      when q.y.len <= 2 and 2000 + q.y.v between {low} and {high} then 2000 + q.y.v
                      when q.y.len <= 2 and 1900 + q.y.v between {low} and {high} then 1900 + q.y.v end,
            'm', coalesce(q.m.mon, if(q.m.v between 1 and 12, q.m.v, null)),
            'd', if(q.d.v between 1 and 31, q.d.v, null))),
          q -> q.m is not null and (q.y is not null or instr(q.o, 'Y') = 0)
                               and (q.d is not null or instr(q.o, 'D') = 0))))"""

    # scores; a day the month does not have is cut
    bonus = f"if(q.four, {C.FOUR_DIGIT_YEAR_BONUS}, 0)"
    named = _score("q.o", C.ORDER_SCORE_MONTH_NAME)
    scored = f"""
      transform({parts}, t -> transform(t.r, q -> named_struct(
          'cut', coalesce(q.d > {days_in_month('q.y', 'q.m')}, false),
          'ym', coalesce(q.y, 0) * 10000 + q.m * 100, 'd', coalesce(q.d, 0),
          'score', if(t.names, {named}, {_score('q.o', C.ORDER_SCORE)}) + {bonus},
          'score_dmy', if(t.names, {named}, {_score('q.o', C.ORDER_SCORE_DAY_FIRST)}) + {bonus})))"""

    strict = f"""
      transform({scored}, r -> transform(
        if(exists(r, q -> not q.cut), filter(r, q -> not q.cut), r),
        q -> named_struct('k', q.ym + if(q.cut, 0, q.d), 'score', q.score, 'score_dmy', q.score_dmy)))"""

    return f"""transform({strict},
        r -> filter(r, (q, i) -> not exists(slice(r, 1, i), z -> z.k = q.k)))[0]"""


def claim(found: str, kinds: str, orders: str, codes: str, tiers: str, rules: RuleSet) -> str:
    """SQL: matches with a reading claim their span in order; earlier claims of a tier win.

    A match is only read when its span is still free, and matches of a fallback tier only when
    no token of the main table was found.
    """
    return f"""
      aggregate({found}, cast(array() as {TOKEN_TYPE}), (acc, m) ->
        if(exists(acc, c -> (c.tier = element_at({tiers}, m.no + 1) and m.s < c.e and c.s < m.e)
                            or (c.no < 100 and element_at({tiers}, m.no + 1) > 1)),
           acc,
           concat(acc, filter(
             transform(array(m), x -> named_struct(
               's', x.s, 'e', x.e, 'no', element_at({codes}, x.no + 1),
               'tier', element_at({tiers}, x.no + 1), 'g', x.g,
               'r', {readings('x', kinds, orders, rules)})),
             x -> size(x.r) > 0))))"""


def attempted(found: str) -> str:
    """SQL: ``year * 100 + month`` of full numeric dates, claimed without a valid reading."""
    return f"""
      transform(filter(transform(
        aggregate({found}, cast(array() as {MATCH_TYPE}),
          (acc, m) -> if(exists(acc, c -> m.s < c.e and c.s < m.e), acc, array_append(acc, m))),
        m -> transform(m.g, x -> {ZEROED})),
        g -> size(g) = 3 and length(g[0]) = 4 and forall(g, x -> x rlike '^[0-9]+$')),
        g -> try_cast(g[0] as int) * 100 + try_cast(g[1] as int))"""


def with_tokens(df: DataFrame, sources, rules: RuleSet, *, only: Column, out: str, attempts: str) -> DataFrame:
    """Add the date tokens of every tier as column ``out``.

    ``sources`` lists (text column, patterns, code, tier): the tokens of a source carry the
    codes ``code``, ``code + 1``, ... in pattern order, and sources of one tier share claims.
    Rows outside ``only`` are not scanned.  ``attempts`` names a second column with the
    attempted dates of the first source.
    """
    flat, codes, tiers, framed = [], [], [], []
    for text, patterns, code, tier in sources:
        framed += marked_texts(F.col(text), patterns, len(flat))
        codes += range(code, code + len(patterns))
        tiers += [tier] * len(patterns)
        flat += patterns
    kinds = _sql_array(p.kinds for p in flat)
    orders = "array(" + ", ".join(_sql_array(p.orders()) for p in flat) + ")"
    code_array, tier_array = ("array(" + ", ".join(map(str, v)) + ")" for v in (codes, tiers))
    hits = F.filter(F.array(*framed), lambda h: F.contains(h["marked"], F.lit(MATCH_MARK)))
    df = df.withColumns({n: F.when(only, g) for n, g in guards(sources[0][0]).items()})
    df = df.withColumn("_hits", F.when(only, hits)).withColumn("_found", matches("_hits"))
    df = df.withColumn("_found", F.expr(trimmed("_found", kinds, rules)))
    df = df.withColumn(out, F.expr(claim("_found", kinds, orders, code_array, tier_array, rules)))
    # only a date without a day can have lost one
    first = f"filter(_found, m -> m.no < {len(sources[0][1])})"
    partial = f"exists({out}, t -> exists(t.r, q -> q.k >= 10000 and q.k % 100 = 0))"
    return df.withColumn(attempts, F.expr(f"if({partial}, {attempted(first)}, null)")).drop(
        "_hits", "_found", *guards(sources[0][0]))


def with_token_lanes(df: DataFrame, lanes, *, only: Column, out: str) -> DataFrame:
    """Add the tokens of several rule sets as column ``out``, array<struct<lane, tokens, attempted>>.

    ``lanes`` lists (sources, rules), each as :func:`with_tokens` takes them. A text is matched once against the union of
    the patterns read on it; every lane puts these matches into its own pattern order and lets them claim their spans.
    """
    numbers, framed = {}, []
    for sources, _ in lanes:
        for text, patterns, _, _ in sources:
            for p in patterns:
                if (text, p) not in numbers:
                    framed += marked_texts(F.col(text), [p], len(numbers))
                    numbers[text, p] = len(numbers)
    hits = F.filter(F.array(*framed), lambda h: F.contains(h["marked"], F.lit(MATCH_MARK)))
    df = df.withColumns({n: F.when(only, g) for n, g in guards(lanes[0][0][0][0]).items()})
    df = df.withColumn("_hits", F.when(only, hits)).withColumn("_matched", matches("_hits"))
    each = []
    for lane, (sources, rules) in enumerate(lanes):
        flat = [(text, p, code + i, tier) for text, patterns, code, tier in sources for i, p in enumerate(patterns)]
        kinds = _sql_array(p.kinds for _, p, _, _ in flat)
        orders = "array(" + ", ".join(_sql_array(p.orders()) for _, p, _, _ in flat) + ")"
        code_array, tier_array, order = ("array(" + ", ".join(map(str, v)) + ")" for v in (
            [code for _, _, code, _ in flat], [tier for _, _, _, tier in flat], [numbers[text, p] for text, p, _, _ in flat]))
        mine = f"""flatten(transform({order}, (u, i) -> transform(filter(_matched, m -> m.no = u),
            m -> named_struct('no', i, 's', m.s, 'e', m.e, 'g', m.g))))"""
        found, tokens = f"_found_{lane}", f"_tokens_{lane}"
        df = df.withColumn(found, F.expr(f"if(size(_matched) > 0, {mine}, _matched)")).withColumn(found, F.expr(trimmed(found, kinds, rules)))
        df = df.withColumn(tokens, F.expr(claim(found, kinds, orders, code_array, tier_array, rules)))
        first = f"filter({found}, m -> m.no < {len(sources[0][1])})"
        partial = f"exists({tokens}, t -> exists(t.r, q -> q.k >= 10000 and q.k % 100 = 0))"
        each.append(F.struct(F.lit(lane).alias("lane"), F.col(tokens).alias("tokens"), F.expr(f"if({partial}, {attempted(first)}, null)").alias("attempted")))
    df = df.withColumn(out, F.array(*each))
    return df.drop("_hits", "_matched", *[f"{n}_{i}" for n in ("_found", "_tokens") for i in range(len(lanes))], *guards(lanes[0][0][0][0]))
