"""The same questions as plain SQL over the source tables, for an independent engine.

Expected dates come in closed form from the date columns the test boxes were rendered from;
nothing here parses text.
"""

from __future__ import annotations

STAGES = ("original_512", "rotation_270", "highres_1024", "clahe", "clahe_1024")

LI = """li AS (
  SELECT *, CAST(l_shipdate + INTERVAL 28 YEAR AS DATE) AS d, printf('%06d', l_orderkey) AS img,
    concat_ws('-', printf('%06d', l_orderkey), l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS line_img,
    l_linenumber * 1000000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS ord,
    100.0 * (l_partkey % 5) + 100 AS cx, 40.0 * l_linenumber + 10 AS cy, 1 - 2 * l_discount AS conf
  FROM lineitem)"""
ORD = """o AS (
  SELECT *, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS d, printf('%06d', o_orderkey) AS img FROM orders)"""
FORMATTED = """CASE l_partkey % 6 WHEN 0 THEN strftime(d, '%Y.%m.%d') WHEN 1 THEN strftime(d, '%Y-%m-%d')
  WHEN 2 THEN strftime(d, '%d/%m/%Y') WHEN 3 THEN strftime(d, '%Y%m%d')
  WHEN 4 THEN upper(strftime(d, '%d%b%Y')) ELSE strftime(d, '%Y년 %m월 %d일') END"""
ISO = "strftime(d, '%Y-%m-%d')"
SWAPPED = "CASE WHEN day(d) <= 12 AND l_partkey % 6 < 4 THEN make_date(year(d), day(d), month(d)) END"


def selection(boxes: str) -> str:
    """Choice per image over b(image_id, ord, kw, d, alts, text, cx, cy)."""
    return f"""WITH {LI}, b AS ({boxes}),
    dist AS (SELECT b.image_id, b.ord,
        min(CASE WHEN p.kw = 'A' THEN sqrt((b.cx - p.cx) ^ 2 + (b.cy - p.cy) ^ 2) END) AS da,
        min(CASE WHEN p.kw = 'R' THEN sqrt((b.cx - p.cx) ^ 2 + (b.cy - p.cy) ^ 2) END) AS de
      FROM b JOIN b p USING (image_id) GROUP BY 1, 2),
    m AS (SELECT * FROM b JOIN dist USING (image_id, ord)),
    ref AS (SELECT image_id, d AS ref FROM m WHERE da IS NOT NULL AND de < da
      QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY de, ord) = 1),
    k AS (SELECT m.*, CASE WHEN ref IS NOT NULL AND da < de THEN coalesce(list_filter(alts, lambda x: x > ref)[1], d) ELSE d END AS k1
      FROM m LEFT JOIN ref USING (image_id)),
    best AS (SELECT image_id, k1 FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY
        CASE WHEN da IS NULL THEN 0 WHEN kw = 'R' THEN 1 ELSE 0 END, CASE WHEN da > de THEN 1 ELSE 0 END, k1 DESC) = 1),
    agg AS (SELECT image_id, bool_and(kw = 'R') AS all_own, count(*) AS n, count(DISTINCT text) AS texts,
        bool_and(kw = 'A') AS all_a, count(DISTINCT d) AS dates, min(d) AS earliest FROM b GROUP BY 1)
    SELECT image_id, CASE WHEN all_own THEN 'NONE'
        WHEN n >= 2 AND texts = n AND all_a AND dates >= 2 THEN strftime(earliest, '%Y-%m-%d')
        ELSE strftime(k1, '%Y-%m-%d') END AS final_date
    FROM agg JOIN best USING (image_id)"""


STANDARD = f"""SELECT img AS image_id, ord, l_returnflag AS kw, d,
    list_filter([d, {SWAPPED}], lambda x: x IS NOT NULL) AS alts, {FORMATTED} AS text, cx, cy FROM li"""
SHORT_YEAR = """SELECT img AS image_id, ord, l_returnflag AS kw, d,
    list_filter([d,
      CASE WHEN l_returnflag = 'A' AND day(d) >= 15 AND year(d) - 2000 <= day(last_day(make_date(2000 + day(d), month(d), 1)))
           THEN make_date(2000 + day(d), month(d), year(d) - 2000) END,
      CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END], lambda x: x IS NOT NULL) AS alts,
    strftime(d, '%Y-%m-%d') AS text, cx, cy FROM li WHERE l_returnflag <> 'N'"""

STAGE_NAME = "CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STAGES)) + " END"
DAY_OR_NONE = "CASE WHEN l_partkey % 13 = 0 THEN 'NONE' ELSE strftime(d, '%d') END"
ST = f"""{LI}, st AS (
  SELECT img AS image_id, {STAGE_NAME} AS stage, l_quantity > 12 AS has,
    CASE WHEN l_quantity > 12 THEN strftime(d, '%Y') ELSE 'NONE' END AS year,
    CASE WHEN l_quantity > 12 THEN strftime(d, '%m') ELSE 'NONE' END AS month,
    CASE WHEN l_quantity > 12 THEN {DAY_OR_NONE} ELSE 'NONE' END AS day,
    CASE WHEN l_quantity > 12 THEN strftime(d, '%Y-%m-') || {DAY_OR_NONE} ELSE 'NONE' END AS f,
    CASE WHEN l_quantity > 12 THEN conf END AS q, l_quantity > 12 AND l_linenumber % 3 = 0 AS many,
    l_quantity > 12 AND l_partkey % 7 = 0 AS short, l_quantity > 12 AND l_partkey % 26 = 0 AS damaged,
    l_quantity > 12 AND l_returnflag = 'A' AS sa, l_quantity > 12 AND l_returnflag = 'R' AS se, l_tax,
    CASE WHEN l_quantity > 12 THEN CASE WHEN l_linenumber % 3 = 0
      THEN [strftime(d - INTERVAL 400 DAY, '%Y-%m-%d'), strftime(d, '%Y-%m-') || {DAY_OR_NONE}]
      ELSE [strftime(d, '%Y-%m-') || {DAY_OR_NONE}] END END AS cd
  FROM li QUALIFY row_number() OVER (PARTITION BY img, l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_quantity) = 1)"""
TRUTH = """tr AS (
  SELECT image_id, ty, tm, td, CASE WHEN k % 17 = 0 THEN 'NONE' ELSE ty || '-' || tm || '-' || td END AS truth, CAST(k % 3 AS VARCHAR) AS cohort
  FROM (SELECT printf('%06d', l_orderkey) AS image_id, l_orderkey AS k,
      CASE WHEN l_orderkey % 17 = 0 THEN 'NONE' ELSE strftime(max(d), '%Y') END AS ty,
      CASE WHEN l_orderkey % 17 = 0 THEN 'NONE' ELSE strftime(max(d), '%m') END AS tm,
      CASE WHEN l_orderkey % 17 = 0 OR l_orderkey % 13 = 0 THEN 'NONE' ELSE strftime(max(d), '%d') END AS td
    FROM li GROUP BY l_orderkey))"""


def _prefer(a: str, b: str) -> str:
    return f"""(coalesce({b}.has AND {b}.q > {a}.q, false) AND NOT coalesce({a}.sa AND {b}.se, false)
      AND NOT coalesce({a}.f NOT LIKE '%NONE%' AND {b}.f <> 'NONE' AND {b}.f LIKE '%-NONE' AND left({a}.f, 7) = left({b}.f, 7), false)
      AND NOT coalesce({a}.many AND NOT {b}.many AND NOT {a}.se AND NOT {b}.sa AND {a}.f NOT LIKE '%NONE%' AND {b}.f NOT LIKE '%NONE%'
        AND {b}.f < {a}.f AND (list_contains({a}.cd, {b}.f) OR (left({b}.f, 7) < left({a}.f, 7)
        AND list_contains({a}.cd, left({b}.f, 7) || '-NONE'))), false))"""


def cascade_cte(short: str = "o.short", fallback: str = "rhc") -> str:
    names, codes = dict(zip("rhc", STAGES[1:4])), fallback.upper()
    chain = [f"WHEN coalesce({a}.has AND {a}.f NOT LIKE '%NONE%', false) THEN ['{names[a]}', '{names[a]}', 'O{codes[:i + 1]}']" for i, a in enumerate(fallback)]
    chain += [f"WHEN coalesce({a}.has, false) THEN ['{names[a]}', '{names[a]}', 'O{codes}']" for a in fallback]
    sides = " ".join(f"LEFT JOIN st {a} ON {a}.image_id = i.image_id AND {a}.stage = '{s}'" for a, s in zip("orhck", STAGES))
    return f"""w AS (SELECT i.image_id, o, r, h, c, k,
        coalesce(o.has, false) AS ev, coalesce(o.has AND (o.q < 0.9 OR o.many), false) AS unc,
        coalesce(o.has AND (o.q < 0.9 OR o.many OR {short} OR o.damaged)
          AND NOT (o.sa AND o.q >= 0.9 AND NOT o.damaged AND o.f NOT LIKE '%NONE%'), false) AS retry,
        coalesce(h.has AND NOT o.many AND NOT h.many AND o.f NOT LIKE '%NONE%' AND h.f NOT LIKE '%NONE%' AND o.f <> h.f, false) AS differ,
        {_prefer('o', 'h')} AS take_h, {_prefer('o', 'c')} AS take_c,
        [o.stage, r.stage, h.stage, c.stage, k.stage] AS present
      FROM (SELECT DISTINCT image_id FROM st) i {sides}),
    a AS (SELECT *, CASE
        WHEN ev AND NOT retry THEN ['original_512', 'original_512', 'O']
        WHEN ev AND NOT coalesce(h.has, false) AND unc AND o.sa AND coalesce(c.sa, false) AND take_c THEN ['clahe', 'clahe_retry', 'OHC']
        WHEN ev AND NOT coalesce(h.has, false) AND unc AND o.sa THEN ['original_512', 'original_512_retry_kept', 'OHC']
        WHEN ev AND unc AND differ AND coalesce(c.f = o.f, false) THEN ['original_512', 'original_512_retry_kept', 'OHC']
        WHEN ev AND unc AND differ AND coalesce(c.f = h.f, false) THEN ['highres_1024', 'highres_1024_retry', 'OHC']
        WHEN ev AND take_h THEN ['highres_1024', 'highres_1024_retry', CASE WHEN unc AND differ THEN 'OHC' ELSE 'OH' END]
        WHEN ev THEN ['original_512', 'original_512_retry_kept', CASE WHEN unc AND differ THEN 'OHC' ELSE 'OH' END]
        {' '.join(chain)}
        ELSE ['original_512', 'original_no_candidate', 'O{codes}'] END AS x FROM w),
    p AS (SELECT *, CASE x[1] WHEN 'original_512' THEN o WHEN 'rotation_270' THEN r WHEN 'highres_1024' THEN h ELSE c END AS s FROM a),
    z AS (SELECT *, coalesce(s.f, 'NONE') = 'NONE' AS empty, coalesce(k.has, false) AS last FROM p),
    full_ AS (SELECT image_id, CASE WHEN empty AND last THEN k ELSE s END AS s,
        CASE WHEN empty AND last THEN 'clahe_1024' ELSE x[2] END AS method,
        list_transform(string_split(x[3] || CASE WHEN empty THEN 'K' ELSE '' END, ''), lambda v: CASE v WHEN 'O' THEN 'original_512'
          WHEN 'R' THEN 'rotation_270' WHEN 'H' THEN 'highres_1024' WHEN 'C' THEN 'clahe' ELSE 'clahe_1024' END) AS asked, present FROM z),
    res AS (SELECT image_id, list_filter(asked, lambda v: NOT list_contains(list_filter(present, lambda y: y IS NOT NULL), v))[1] AS missing_stage,
        s, method, asked FROM full_),
    done AS (SELECT image_id, s.f AS f, method, asked, s.q AS q, coalesce(len(s.cd), 0) AS n_dates FROM res WHERE missing_stage IS NULL)"""


FIRST = """fc AS (SELECT image_id, coalesce(arg_min(f, no) FILTER (has), 'NONE') AS f, coalesce(arg_min(year, no) FILTER (has), 'NONE') AS y,
    coalesce(arg_min(month, no) FILTER (has), 'NONE') AS m, coalesce(arg_min(day, no) FILTER (has), 'NONE') AS dd,
    coalesce(arg_min(stage, no) FILTER (has), 'original_no_candidate') AS method
  FROM (SELECT *, list_position(['original_512', 'rotation_270', 'highres_1024', 'clahe'], stage) AS no FROM st WHERE stage <> 'clahe_1024')
  GROUP BY 1)"""
GROUP_OF = ("CASE (ty = 'NONE')::INT + (tm = 'NONE')::INT + (td = 'NONE')::INT WHEN 0 THEN 'complete' "
            "WHEN 3 THEN 'all_none' ELSE 'partial_none' END")
SCORED = f"sc AS (SELECT *, {GROUP_OF} AS g FROM fc JOIN tr USING (image_id))"

EV = "ev AS (SELECT *, CAST(round(value * 1000000) AS BIGINT) AS micros FROM events)"


def _exclusive(p: float) -> str:
    pos = f"greatest(1.0, least(len(l)::DOUBLE, (len(l) + 1) * {p}))"
    low = f"l[CAST(floor({pos}) AS BIGINT)]"
    high = f"l[least(CAST(floor({pos}) AS BIGINT) + 1, len(l))]"
    return f"round({low} + ({high} - {low}) * ({pos} - floor({pos})), 3)"


RECORDS = f"""{ORD}, rec AS (
  SELECT CASE WHEN o_orderkey % 43 = 0 THEN o_orderkey || 'a' WHEN o_orderkey % 4700 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS image_id, 'first' AS source,
    CASE WHEN o_orderkey % 19 = 0 THEN 'none' WHEN o_orderkey % 23 = 0 THEN strftime(d, '%y') ELSE strftime(d, '%Y') END AS year,
    CASE WHEN o_orderkey % 29 = 0 THEN CAST(month(d) AS VARCHAR) ELSE strftime(d, '%m') END AS month,
    CASE WHEN o_orderkey % 31 = 0 THEN 'xx' WHEN o_orderkey % 37 = 0 THEN '45' ELSE strftime(d, '%d') END AS day,
    CASE WHEN o_orderkey % 41 = 0 THEN 'NONE' ELSE strftime(d, '%Y-%m-%d') END AS final_date,
    CASE WHEN o_orderkey % 43 <> 0 AND o_orderkey % 4700 <> 0 THEN o_orderkey END AS k, d FROM o
  UNION ALL
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 7, '0'), 'second', strftime(d, '%Y'),
    CASE WHEN o_orderkey % 11 = 0 AND day(d) <= 12 THEN strftime(d, '%d') ELSE strftime(d, '%m') END,
    CASE WHEN o_orderkey % 11 = 0 AND day(d) <= 12 THEN strftime(d, '%m') ELSE strftime(d, '%d') END,
    CASE WHEN o_orderkey % 11 = 0 AND day(d) <= 12 THEN strftime(d, '%Y-%d-%m') ELSE strftime(d, '%Y-%m-%d') END, o_orderkey, d
  FROM o WHERE o_orderkey % 5 <> 0),
canon AS (SELECT *, CASE WHEN day = 'xx' THEN 'invalid_day' END AS bad,
    CASE WHEN year = 'none' THEN 'NONE' WHEN length(year) = 2 THEN '20' || year ELSE year END AS y, lpad(month, 2, '0') AS m, day AS dd FROM rec),
checked AS (SELECT *, CASE WHEN bad IS NULL THEN y || '-' || m || '-' || dd END AS cf,
    CASE WHEN dd <> 'xx' AND CAST(dd AS INT) > 31 THEN 'day_out_of_range'
         WHEN dd <> 'xx' AND CAST(dd AS INT) > day(last_day(make_date(CASE WHEN y = 'NONE' THEN 2000 ELSE CAST(y AS INT) END, CAST(m AS INT), 1)))
         THEN 'calendar_invalid' END AS cal FROM canon)"""
REASONED = f"""{RECORDS}, why AS (SELECT *, coalesce(CAST(k AS VARCHAR), image_id, '') AS key, list_sort(list_filter([
    CASE WHEN k IS NULL THEN 'invalid_image_id' END,
    CASE WHEN bad IS NOT NULL THEN 'invalid_component' END,
    CASE WHEN bad IS NULL AND y = 'NONE' THEN 'partial_none' END,
    CASE WHEN bad IS NULL AND cal IS NOT NULL THEN 'calendar_invalid' END,
    CASE WHEN bad IS NULL AND y = 'NONE' AND CAST(dd AS INT) BETWEEN 1 AND 12 AND m <> dd THEN 'ambiguous_date_order' END,
    CASE WHEN bad IS NULL AND final_date <> cf THEN 'component_final_mismatch' END], lambda x: x IS NOT NULL)) AS reasons FROM checked)"""
IMAGES = f"""{REASONED}, img AS (SELECT key, count(*) AS n_records, count(DISTINCT source) AS n_sources,
    count(DISTINCT cf) AS variants, bool_and(bad IS NULL) AS all_valid, flatten(list(reasons)) AS rs,
    min(y) AS y, min(m) AS m, min(dd) AS dd, min(cf) AS cf, count(DISTINCT y) AS ys,
    bool_or(source = 'first' AND bad IS NULL) AS f_ok,
    max(CASE WHEN source = 'first' AND bad IS NULL THEN m || dd END) AS fmd, max(CASE WHEN source = 'second' THEN dd || m END) AS sdm,
    max(CASE WHEN source = 'second' THEN m || dd END) AS smd FROM why GROUP BY 1),
rv AS (SELECT *, list_sort(list_distinct(list_concat(rs, list_filter([
    CASE WHEN n_records > n_sources THEN 'duplicate_source_id' END,
    CASE WHEN variants > 1 THEN 'label_conflict' END,
    CASE WHEN variants > 1 AND ys = 1 AND fmd = sdm AND fmd <> smd THEN 'ambiguous_date_order' END], lambda x: x IS NOT NULL)))) AS reasons FROM img)"""

SUB = f"""{ORD}, s AS (SELECT
    CASE WHEN o_orderkey % 101 = 0 THEN ' ' WHEN o_orderkey % 103 = 0 THEN img || '.jpg' WHEN o_orderkey % 107 = 0 THEN '000001' ELSE img END AS image_id,
    CASE WHEN o_orderkey % 109 = 0 THEN '27' WHEN o_orderkey % 137 <> 0 THEN strftime(d, '%Y') END AS year,
    CASE WHEN o_orderkey % 113 = 0 THEN '13' ELSE strftime(d, '%m') END AS month,
    CASE WHEN o_orderkey % 127 = 0 THEN 'NONE' WHEN o_orderkey % 131 = 0 THEN '00' ELSE strftime(d, '%d') END AS day,
    CASE WHEN o_orderkey % 139 <> 0 THEN strftime(d, '%Y-%m-%d') END AS final_date FROM o)"""

SHORT_READ = ("CASE WHEN day(d) >= 15 AND year(d) - 2000 <= day(last_day(make_date(2000 + day(d), month(d), 1))) "
              "THEN make_date(2000 + day(d), month(d), year(d) - 2000) ELSE d END")
WORK = "p / n + 1.96 * 1.96 / (2 * n)"


def shown(day: str) -> str:
    """A date of the passes below as text; dates without a day are the first of their month, marked by `part`."""
    return f"CASE WHEN part THEN strftime({day}, '%Y-%m') || '-NONE' ELSE strftime({day}, '%Y-%m-%d') END"


#: Candidates (k) and evidence (det) of every (image, stage) over boxes with complete dates, months, and no date.
PASSES = f"""WITH {LI}, x AS (SELECT img AS image_id, {STAGE_NAME} AS stage, ord, conf, cx, cy, l_partkey % 13 = 0 AS part, l_partkey % 17 = 0 AS blank, l_partkey,
    CASE WHEN l_partkey % 17 = 0 THEN 'N' ELSE l_returnflag END AS kw, d FROM li),
b AS (SELECT image_id, stage, ord, conf, cx, cy, part, kw, CASE WHEN part THEN date_trunc('month', d)::DATE ELSE d END AS d,
    CASE WHEN part THEN [d] ELSE list_filter([d, {SWAPPED}], lambda v: v IS NOT NULL) END AS alts, CASE WHEN part THEN last_day(d) ELSE d END AS until,
    CASE WHEN part THEN 13 WHEN l_partkey % 6 = 2 THEN CASE WHEN day(d) = month(d) THEN 11 ELSE 12 END ELSE 13 END AS own_score, CASE WHEN l_partkey % 6 = 2 THEN 11 ELSE 10 END AS other_score,
    CASE kw WHEN 'A' THEN 'EXP ' WHEN 'R' THEN 'MFG ' ELSE '' END || CASE WHEN part THEN strftime(d, '%Y.%m') ELSE {FORMATTED} END AS text FROM x WHERE NOT blank),
dist AS (SELECT b.image_id, b.stage, b.ord, min(CASE WHEN p.kw = 'A' THEN sqrt((b.cx - p.cx) ^ 2 + (b.cy - p.cy) ^ 2) END) AS da,
    min(CASE WHEN p.kw = 'R' THEN sqrt((b.cx - p.cx) ^ 2 + (b.cy - p.cy) ^ 2) END) AS de FROM b JOIN b p USING (image_id, stage) GROUP BY ALL),
m AS (SELECT * FROM b JOIN dist USING (image_id, stage, ord)),
ref AS (SELECT image_id, stage, d AS ref FROM m WHERE da IS NOT NULL AND de < da AND NOT part QUALIFY row_number() OVER (PARTITION BY image_id, stage ORDER BY de, ord) = 1),
k AS (SELECT * REPLACE (CASE WHEN part OR k1 IS NULL THEN d ELSE k1 END AS k1), CASE WHEN part OR k1 IS NULL OR k1 = d THEN own_score ELSE other_score END AS score
    FROM (SELECT m.*, CASE WHEN ref IS NOT NULL AND da < coalesce(de, 'infinity'::DOUBLE) THEN list_filter(alts, lambda v: v > ref)[1] END AS k1 FROM m LEFT JOIN ref USING (image_id, stage))),
agg AS (SELECT image_id, stage, bool_and(kw = 'R') AS all_own, count(*) >= 2 AND count(DISTINCT text) = count(*) AND bool_and(kw = 'A' AND NOT part) AND count(DISTINCT d) >= 2 AS labelled
    FROM b GROUP BY ALL),
won AS (SELECT k.*, labelled FROM k JOIN agg USING (image_id, stage) WHERE NOT all_own QUALIFY row_number() OVER (PARTITION BY image_id, stage ORDER BY
    CASE WHEN labelled THEN d END, CASE WHEN da IS NULL THEN part::INT WHEN kw = 'R' THEN 1 ELSE 0 END, CASE WHEN da > coalesce(de, 'infinity'::DOUBLE) THEN 1 ELSE 0 END,
    CASE WHEN da IS NULL THEN (CASE WHEN NOT part THEN k1 END) ELSE CASE WHEN part THEN until ELSE k1 END END DESC NULLS LAST, da, ord) = 1),
det AS (SELECT g.image_id, g.stage, w.ord IS NOT NULL AS has_candidate, CASE WHEN w.labelled THEN w.d ELSE w.k1 END AS day, coalesce(w.part, false) AS part, coalesce(w.text, '') AS text,
    coalesce(max(s.conf), 0) AS raw_confidence, w.da AS raw_distance, w.de, CASE WHEN w.labelled THEN w.own_score ELSE w.score END AS score
  FROM (SELECT DISTINCT image_id, stage FROM x) g LEFT JOIN won w USING (image_id, stage)
  LEFT JOIN b s ON s.image_id = w.image_id AND s.stage = w.stage AND s.text = w.text AND s.cx = w.cx AND s.cy = w.cy GROUP BY ALL)"""
DETAIL = f"""CASE WHEN has_candidate THEN {shown('day')} ELSE 'NONE' END AS final_date, has_candidate, text AS source_text, round(raw_confidence, 6) AS confidence,
    raw_distance IS NOT NULL AS anchor_found, CASE WHEN raw_distance IS NULL THEN 0 WHEN raw_distance <= coalesce(de, 'infinity'::DOUBLE) THEN 2 ELSE 1 END AS anchor_preference,
    round(raw_distance, 6) AS anchor_distance, CASE WHEN NOT has_candidate THEN 0 WHEN part THEN 2 ELSE 3 END AS valid_fields, has_candidate AND NOT part AS complete, score"""


#: Each trial's decisions, also those with a missing stage; stages of images that end in 07 are left out for `gone`.
def trial_rows(gone: str) -> str:
    orders = {"production": ("o.short", "rhc"), "high_first": ("o.short", "hrc"), "contrast_first": ("o.short", "crh"), "contrast_before_high": ("o.short", "rch"),
              "no_short_retry": ("false", "rhc"), "skip_rotation": ("o.short", "hc"), "skip_contrast": ("o.short", "rh")}
    st = f"{ST[:ST.rindex('st AS (')]}st AS (SELECT * FROM ({ST[ST.rindex('st AS (') + 7:]} WHERE {gone})"
    parts = [f"""{n} AS (WITH {cascade_cte(*args)} SELECT '{n}' AS policy, image_id, missing_stage, CASE WHEN missing_stage IS NULL THEN s.f END AS f,
        CASE WHEN missing_stage IS NULL THEN asked END AS asked FROM res)""" for n, args in orders.items()]
    cost = "(SELECT CAST(sum(CAST(round(l_tax * 1000000) AS BIGINT)) AS BIGINT) FROM st WHERE st.image_id = u.image_id AND list_contains(u.asked, st.stage))"
    union = " UNION ALL ".join(f"SELECT * FROM {n}" for n in orders)
    return f"""{st}, {TRUTH}, {", ".join(parts)}, every AS MATERIALIZED (SELECT policy, image_id, missing_stage, f, asked, {cost} AS micros FROM ({union}) u)"""


_NAMES = "(SELECT unnest(['production', 'high_first', 'contrast_first', 'contrast_before_high', 'no_short_retry', 'skip_rotation', 'skip_contrast']) AS policy)"
BESIDE = f"""{trial_rows("right(image_id, 2) <> '07'")}, beside AS (SELECT cohort, n.policy, tr.image_id, truth, b.f AS bf, p.f AS pf, b.asked AS ba, p.asked AS pa, b.micros AS bm, p.micros AS pm,
    b.f IS NULL OR p.f IS NULL AS unknown FROM tr CROSS JOIN {_NAMES} n LEFT JOIN every p ON p.policy = n.policy AND p.image_id = tr.image_id
    LEFT JOIN every b ON b.policy = 'production' AND b.image_id = tr.image_id)"""

#: Rule variants over an image per line item: the case is the part key modulo 13; what every variant makes of it, from the rules.
_VARIANTS = ("baseline", "year_month_word", "mixed_comma", "split_until", "preserve_complete", "retry_partial", "retry_damaged_day", "retry_bare_date",
             "clahe_after_empty_retry", "clahe_after_empty_anchored_retry", "no_period", "printed_period_base", "no_six")
_BY_RULE = """(VALUES ('year_month_word', 0, 'truth', 'O'), ('mixed_comma', 1, 'truth', 'O'), ('split_until', 2, 'truth', 'O'), ('preserve_complete', 3, 'truth', 'OH'),
    ('retry_partial', 1, 'month', 'OH'), ('retry_partial', 4, 'truth', 'OH'), ('retry_partial', 10, 'truth', 'OH'), ('retry_damaged_day', 10, 'truth', 'OH'),
    ('retry_bare_date', 9, 'truth', 'OH'), ('clahe_after_empty_retry', 7, 'truth', 'OHC'), ('clahe_after_empty_retry', 8, 'truth', 'OHC'),
    ('clahe_after_empty_anchored_retry', 7, 'truth', 'OHC'), ('no_period', 6, 'none', 'ORHCK'), ('printed_period_base', 6, 'printed', 'O'), ('no_six', 5, 'none', 'ORHCK'))
    t(policy, c, what, asked)"""
_BASE = """(VALUES (0, 'none', 'ORHCK'), (1, 'month', 'O'), (2, 'none', 'ORHCK'), (3, 'month', 'OH'), (4, 'month', 'O'), (5, 'truth', 'O'), (6, 'truth', 'O'), (7, 'later', 'OH'),
    (8, 'later', 'OH'), (9, 'later', 'O'), (10, 'month', 'O'), (11, 'truth', 'O'), (12, NULL, NULL)) b(c, what, asked)"""


def _dated(what: str) -> str:
    return (f"CASE {what} WHEN 'truth' THEN truth WHEN 'none' THEN 'NONE' WHEN 'month' THEN strftime(d, '%Y-%m') || '-NONE' "
            f"WHEN 'later' THEN strftime(d + INTERVAL 12 MONTH, '%Y-%m-%d') WHEN 'printed' THEN strftime(d, '%Y-%m-%d') END")


RULE_VARIANTS = f"""WITH {LI}, im AS (SELECT line_img AS image_id, l_returnflag AS cohort, d, l_partkey % 13 AS c,
    strftime(CASE WHEN l_partkey % 13 = 6 THEN d + INTERVAL 5 MONTH ELSE d END, '%Y-%m-%d') AS truth FROM li),
  each AS (SELECT im.*, v.policy, b.what AS bw, b.asked AS ba, coalesce(t.what, b.what) AS pw, coalesce(t.asked, b.asked) AS pa
    FROM im JOIN {_BASE} ON b.c = im.c CROSS JOIN (SELECT unnest({list(_VARIANTS)}) AS policy) v LEFT JOIN {_BY_RULE} ON t.policy = v.policy AND t.c = im.c),
  rv AS (SELECT *, {_dated('bw')} AS bf, {_dated('pw')} AS pf FROM each)"""

SAVED = f"""{PASSES}, {TRUTH}, pz AS (SELECT x.image_id, x.stage, count(*) FILTER (NOT blank) AS boxes, any_value(micros) AS micros FROM x
    JOIN (SELECT img AS image_id, {STAGE_NAME} AS stage, CAST(round(min(l_tax) * 1000000) AS BIGINT) AS micros FROM li GROUP BY 1, 2) USING (image_id, stage) GROUP BY ALL),
  ps AS (SELECT pz.*, coalesce(det.has_candidate, false) AS has, CASE WHEN coalesce(det.has_candidate, false) THEN {shown('day')} ELSE 'NONE' END AS f FROM pz LEFT JOIN det USING (image_id, stage)),
  side AS (SELECT tr.image_id, truth, {", ".join(c for c in "orhc")} FROM tr {" ".join(f"LEFT JOIN ps {c} ON {c}.image_id = tr.image_id AND {c}.stage = '{s}'" for c, s in zip("orhc", STAGES))})"""

COHORT = f"""WITH {ST}, {TRUTH}, {FIRST}, lists AS (SELECT image_id, CAST(image_id AS BIGINT) AS k, method FROM tr
    LEFT JOIN (SELECT * FROM fc WHERE right(image_id, 2) <> '07') USING (image_id)),
  mem AS (SELECT image_id, CASE WHEN method IS NOT NULL AND k % 97 = 0 THEN 'duplicate' WHEN k % 77 = 0 THEN 'overlap' WHEN method IS NULL THEN 'not_official'
    WHEN k % 11 = 0 THEN 'excluded_failure' WHEN k % 7 = 0 THEN 'excluded_control' WHEN method = 'original_512' THEN 'primary' ELSE 'later_stop' END AS membership
    FROM lists WHERE method IS NOT NULL OR k % 11 = 0 OR k % 7 = 0)"""
SHADOW = f"""{COHORT}, sh0 AS (SELECT image_id, truth, o, r, h, coalesce(o.q < 0.9 OR o.many, false) AS trig FROM mem JOIN tr USING (image_id)
    LEFT JOIN st o ON o.image_id = mem.image_id AND o.stage = 'original_512' LEFT JOIN st r ON r.image_id = mem.image_id AND r.stage = 'rotation_270'
    LEFT JOIN st h ON h.image_id = mem.image_id AND h.stage = 'highres_1024' WHERE membership = 'primary'),
  sh1 AS (SELECT *, NOT trig OR (r.stage IS NOT NULL AND h.stage IS NOT NULL) AS known FROM sh0),
  sh2 AS (SELECT *, known AND trig AS triggered, CASE WHEN NOT known THEN NULL WHEN trig AND h.has AND len(h.cd) = 1 AND h.q > o.q AND (NOT (r.has AND coalesce(len(r.cd), 0) = 1) OR h.q > r.q) THEN 'highres_1024'
      WHEN trig AND r.has AND len(r.cd) = 1 AND r.q > o.q THEN 'rotation_270' ELSE 'original_512' END AS selected_stage FROM sh1),
  sh AS (SELECT image_id, truth, CASE WHEN known THEN o.f END AS baseline, CASE selected_stage WHEN 'highres_1024' THEN h.f WHEN 'rotation_270' THEN r.f WHEN 'original_512' THEN o.f END AS shadow,
    triggered, selected_stage, known, CASE WHEN triggered THEN 'original_512,rotation_270,highres_1024' WHEN known THEN 'original_512' ELSE '' END AS attempts,
    CASE WHEN known THEN CAST(round(o.l_tax * 1000000) AS BIGINT) ELSE 0 END AS original_micros,
    CASE WHEN triggered THEN CAST(round(r.l_tax * 1000000) AS BIGINT) + CAST(round(h.l_tax * 1000000) AS BIGINT) ELSE 0 END AS retry_micros FROM sh2),
  shadowed AS (SELECT * EXCLUDE (known), coalesce(baseline = truth, false) AS baseline_correct, coalesce(shadow = truth, false) AS shadow_correct,
    CASE WHEN NOT known THEN 'unknown' WHEN baseline = truth AND shadow = truth THEN 'unchanged_correct' WHEN baseline = truth THEN 'regression'
      WHEN shadow = truth THEN 'recovery' WHEN baseline = shadow THEN 'unchanged_wrong' ELSE 'wrong_to_different_wrong' END AS category FROM sh)"""

ORACLES: dict[str, str] = {
    "parse_rendered_dates": f"WITH {LI} SELECT line_img AS image_id, {ISO} AS final_date FROM li GROUP BY 1, 2",
    "token_pattern_counts": f"""WITH {LI} SELECT CASE l_partkey % 6 WHEN 2 THEN 'odd_separators_year_last' WHEN 3 THEN 'yyyymmdd'
        WHEN 4 THEN 'day_word_year_spaced' WHEN 5 THEN 'korean_year_month_day' ELSE 'separated_triple' END AS pattern,
        count(*) AS n FROM li GROUP BY 1""",
    "select_expiry_per_image": selection(STANDARD),
    "select_latest_no_anchor": f"WITH {LI} SELECT img AS image_id, strftime(max(d), '%Y-%m-%d') AS final_date FROM li GROUP BY 1",
    "labelled_set_earliest": selection(STANDARD + " WHERE l_returnflag = 'A'"),
    "period_from_manufacture": f"""WITH {LI}, {ORD}, b AS (SELECT l_orderkey, count(DISTINCT d) AS n, min(d) AS d FROM li WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT img AS image_id, CASE WHEN n IS NULL OR n <> 1 THEN 'NONE' ELSE strftime(CASE o_orderkey % 3
          WHEN 0 THEN b.d + to_days(CAST(o_orderkey % 24 + 1 AS INT)) WHEN 1 THEN b.d + to_months(CAST(o_orderkey % 24 + 1 AS INT))
          ELSE b.d + to_years(CAST(o_orderkey % 24 + 1 AS INT)) END, '%Y-%m-%d') END AS final_date
        FROM o LEFT JOIN b ON o_orderkey = l_orderkey""",
    "manufacture_rerank": selection(SHORT_YEAR),
    "adjacent_day_join": f"""WITH {LI} SELECT line_img AS image_id, strftime(d, '%Y-%m-') || CASE WHEN l_partkey % 40 <= 20
        AND l_suppkey % 12 <= 8 AND 1 - 2 * l_tax >= 1 - 2 * l_discount THEN strftime(d, '%d') ELSE 'NONE' END AS final_date FROM li""",
    "nearest_year_join": f"""WITH {LI}, x AS (SELECT *, 21 + l_partkey % 60 AS d1, 20 + l_partkey % 47 AS d2 FROM li),
        y AS (SELECT *, CASE WHEN d1 <= 60 AND d1 <= d2 THEN year(d) WHEN d2 <= 60 THEN year(d) - 1 END AS y FROM x)
        SELECT line_img AS image_id, CASE WHEN y IS NULL OR day(d) > day(last_day(make_date(y, month(d), 1)))
          THEN 'NONE' ELSE CAST(y AS VARCHAR) END || strftime(d, '-%m-%d') AS final_date FROM y""",
    "format_hint_per_image": f"""WITH {ORD} SELECT img AS image_id,
        strftime(CASE WHEN o_orderkey % 3 = 0 THEN d ELSE {SHORT_READ} END, '%Y-%m-%d') AS final_date FROM o""",
    "slash_order_per_image": f"""WITH {ORD} SELECT img AS image_id, array_to_string(list_sort(list_distinct(list_filter([
        strftime(CASE WHEN o_orderkey % 3 = 0 THEN d ELSE {SHORT_READ} END, '%Y-%m-%d'),
        CASE o_orderkey % 3 WHEN 0 THEN '2022-09-28' WHEN 1 THEN '2022-09-08' END], lambda x: x IS NOT NULL))), ' | ') AS dates FROM o""",
    "fallback_tiers": f"""WITH {LI} SELECT line_img AS image_id, CASE l_partkey % 5 WHEN 2 THEN strftime(d, '%Y-%m-NONE')
        WHEN 3 THEN strftime(d, 'NONE-%m-%d') WHEN 4 THEN 'NONE' ELSE {ISO} END AS final_date,
        CASE l_partkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 0 END AS tier FROM li""",
    "stage_evidence": f"""WITH {LI}, b AS (SELECT *, {STAGE_NAME} AS stage, {FORMATTED} AS text FROM li),
        s AS (SELECT img, stage, d, text, cx, cy, l_partkey FROM b QUALIFY row_number() OVER (PARTITION BY img, stage ORDER BY d DESC, ord) = 1),
        g AS (SELECT img, stage, count(*) AS n, list_sort(list_distinct(list({ISO}))) AS ds FROM b GROUP BY 1, 2)
        SELECT s.img AS image_id, s.stage, strftime(s.d, '%Y-%m-%d') AS final_date, min(b.conf) AS q, len(any_value(ds)) >= 2 AS many,
          s.l_partkey % 6 = 3 AS short, false AS self_anchor, false AS self_exclude, false AS damaged_day, any_value(n) AS n_candidates,
          array_to_string(any_value(ds), ' | ') AS dates
        FROM s JOIN g USING (img, stage) JOIN b ON b.img = s.img AND b.stage = s.stage AND b.text = s.text AND b.cx = s.cx AND b.cy = s.cy
        GROUP BY s.img, s.stage, s.d, s.l_partkey""",
    "rule_ablation": f"""WITH {LI}, v AS (SELECT unnest(['baseline', 'year_month_word+mixed_comma', 'no_six']) AS variant)
        SELECT variant, count(*) AS n, count(*) FILTER (variant LIKE 'year%' AND l_partkey % 4 = 1) AS gains,
        count(*) FILTER (variant = 'no_six' AND l_partkey % 4 = 2) AS regressions FROM li, v GROUP BY 1""",
    "rule_variant_trials": f"""{RULE_VARIANTS} SELECT cohort, policy, count(*) AS n, count(*) FILTER (pf IS NULL) AS unknown, count(*) FILTER (pf = truth) AS correct,
        count(*) FILTER (bf <> truth AND pf = truth) AS gains, count(*) FILTER (bf = truth AND pf <> truth) AS regressions, CAST(sum(coalesce(length(pa), 0)) AS BIGINT) AS calls,
        CAST(sum(coalesce(length(pa) - length(ba), 0)) AS BIGINT) AS extra_calls, count(*) FILTER (length(pa) > 1) AS retry_images,
        count(*) FILTER (length(pa) > length(ba)) AS images_with_new_stages FROM rv GROUP BY 1, 2""",
    "rule_variant_stage_calls": f"""{RULE_VARIANTS} SELECT policy, s.stage, count(*) AS calls FROM rv JOIN (VALUES ('O', 'original_512'), ('R', 'rotation_270'), ('H', 'highres_1024'),
        ('C', 'clahe'), ('K', 'clahe_1024')) s(code, stage) ON contains(pa, s.code) GROUP BY 1, 2""",
    "rule_variant_changes": f"""{RULE_VARIANTS} SELECT cohort, policy, image_id, truth, bf AS "old", pf AS "new",
        CASE WHEN pf = truth THEN 'gain' WHEN bf = truth THEN 'regression' ELSE 'changed_wrong' END AS kind FROM rv WHERE bf IS DISTINCT FROM pf""",
    "cascade_production": f"""WITH {ST}, {cascade_cte()} SELECT image_id, CASE WHEN missing_stage IS NULL THEN s.f END AS final_date,
        CASE WHEN missing_stage IS NULL THEN method END AS method,
        coalesce(CASE WHEN missing_stage IS NULL THEN array_to_string(asked, ',') END, NULL) AS attempts, missing_stage FROM res""",
    "cascade_first_candidate": f"WITH {ST}, {FIRST} SELECT image_id, f AS final_date, method FROM fc",
    "review_route": f"""WITH {ST}, {cascade_cte()} SELECT CASE WHEN missing_stage IS NOT NULL THEN 'unknown' WHEN s.f LIKE '%NONE%' THEN 'MANUAL' WHEN len(s.cd) >= 2 THEN 'CHOOSE'
        WHEN s.q IS NULL OR s.q < 0.9 THEN 'RECHECK' ELSE 'CONFIRM' END AS route, count(*) AS n FROM res GROUP BY 1""",
    "policy_grid": f"""WITH {ST}, {TRUTH}, i AS (SELECT DISTINCT image_id FROM st WHERE stage IN ('original_512', 'rotation_270', 'highres_1024')),
        t AS (SELECT o.* EXCLUDE (image_id), o.image_id IS NULL OR r.image_id IS NULL OR h.image_id IS NULL AS unk, r.f AS rf, r.q AS rq, r.has AS rh, r.cd AS rcd, h.f AS hf, h.q AS hq, h.has AS hh, h.cd AS hcd, truth
          FROM i LEFT JOIN st o ON o.image_id = i.image_id AND o.stage = 'original_512'
          LEFT JOIN st r ON r.image_id = i.image_id AND r.stage = 'rotation_270' LEFT JOIN st h ON h.image_id = i.image_id AND h.stage = 'highres_1024'
          JOIN tr ON tr.image_id = i.image_id),
        gr AS (SELECT unnest(['forced', 'A', 'B']) AS gate), ru AS (SELECT unnest(['keep_stage1', 'retry_agreement', 'highest_q',
          'unique_evidence_higher_q', 'latest_highres_reference']) AS rule),
        e AS (SELECT *, CASE gate WHEN 'forced' THEN true WHEN 'A' THEN coalesce(q < 0.9, false) ELSE coalesce(q < 0.9 OR many, false) END AS trig FROM t, gr, ru),
        c AS (SELECT *, CASE WHEN NOT trig OR rule = 'keep_stage1' THEN f WHEN rule = 'latest_highres_reference' THEN hf
          WHEN rule = 'retry_agreement' THEN CASE WHEN rh AND hh AND rf = hf THEN rf ELSE f END
          WHEN rule = 'highest_q' THEN CASE WHEN hh AND hq > coalesce(q, -1) AND (NOT rh OR hq > rq) THEN hf
             WHEN rh AND rq > coalesce(q, -1) THEN rf ELSE f END
          ELSE CASE WHEN q IS NULL THEN f WHEN hh AND len(hcd) = 1 AND hq > q AND (NOT (rh AND len(rcd) = 1) OR hq > rq) THEN hf
             WHEN rh AND len(rcd) = 1 AND rq > q THEN rf ELSE f END END AS sel FROM e)
        SELECT gate, rule, count(*) AS n, count(*) FILTER (unk) AS unknown_count, count(*) FILTER (NOT unk AND trig) AS triggered_count,
          count(*) FILTER (NOT unk AND sel = truth) AS correct_count, count(*) FILTER (NOT unk AND sel <> f) AS changed_count,
          count(*) FILTER (NOT unk AND f <> truth AND sel = truth) AS recovery_count,
          count(*) FILTER (NOT unk AND f = truth AND sel <> truth) AS regression_count FROM c GROUP BY 1, 2""",
    "retry_trigger_summary": f"""WITH {ST}, {cascade_cte()}, f1 AS (SELECT * FROM st WHERE stage = 'original_512')
        SELECT count(*) AS n, count(*) FILTER (q < 0.9) AS a, count(*) FILTER (q < 0.9 OR (q IS NOT NULL AND many)) AS b,
        count(*) FILTER (q IS NULL) AS unevaluable, (SELECT count(*) FROM w WHERE retry) AS production FROM f1""",
    "outcome_categories": f"""WITH {ST}, {TRUTH} SELECT CASE WHEN o.f IS NULL OR h.f IS NULL THEN 'unknown' WHEN o.f = truth AND h.f = truth THEN 'unchanged_correct'
        WHEN o.f = truth THEN 'regression' WHEN h.f = truth THEN 'recovery' WHEN o.f = h.f THEN 'unchanged_wrong'
        ELSE 'wrong_to_different_wrong' END AS outcome, count(*) AS n
        FROM (SELECT DISTINCT image_id FROM st) i LEFT JOIN st o ON o.image_id = i.image_id AND o.stage = 'original_512'
        LEFT JOIN st h ON h.image_id = i.image_id AND h.stage = 'highres_1024' JOIN tr ON tr.image_id = i.image_id GROUP BY 1""",
    "candidates_of_passes": f"""{PASSES} SELECT image_id, stage, ord AS box_index, CASE WHEN kw = 'N' THEN 0 ELSE 4 END AS start,
        {shown('d')} AS printed_date, {shown('k1')} AS final_date, score, kw = 'R' AS self_excluded, 1 AS tier, round(da, 6) AS d_anchor, round(de, 6) AS d_exclude FROM k""",
    "candidate_detail_per_pass": f"""{PASSES} SELECT image_id, stage, {DETAIL} FROM det""",
    "best_pass_per_image": f"""{PASSES} SELECT image_id, passes, passes_with_candidate, CASE WHEN found THEN stage END AS pass, coalesce(final_date, 'NONE') AS final_date,
        CASE WHEN found THEN source_text END AS source_text, CASE WHEN found THEN confidence END AS confidence, CASE WHEN found THEN anchor_preference END AS anchor_preference,
        anchor_distance, CASE WHEN found THEN valid_fields END AS valid_fields, CASE WHEN found THEN complete END AS complete, score FROM (
        SELECT *, has_candidate AS found, count(*) OVER (PARTITION BY image_id) AS passes, count(*) FILTER (has_candidate) OVER (PARTITION BY image_id) AS passes_with_candidate,
          row_number() OVER (PARTITION BY image_id ORDER BY has_candidate DESC, anchor_preference DESC, coalesce(-raw_distance, 0) DESC, complete DESC, valid_fields DESC,
            raw_confidence DESC, list_position({list(STAGES)}, stage)) AS rn FROM (SELECT image_id, stage, {DETAIL}, raw_distance, raw_confidence FROM det)) WHERE rn = 1""",
    "cascade_order_trials": f"""WITH {trial_rows('true')} SELECT policy AS trial, count(*) AS n, count(missing_stage) AS unknown, CAST(sum(len(asked)) AS BIGINT) AS calls
        FROM every GROUP BY 1""",
    "cohort_policy_trials": f"""WITH {BESIDE} SELECT cohort, policy, count(*) AS n, count(*) FILTER (unknown) AS unknown, count(*) FILTER (NOT unknown AND pf = truth) AS correct,
        count(*) FILTER (NOT unknown AND bf <> truth AND pf = truth) AS gains, count(*) FILTER (NOT unknown AND bf = truth AND pf <> truth) AS regressions,
        CAST(sum(CASE WHEN unknown THEN 0 ELSE len(pa) END) AS BIGINT) AS calls, CAST(sum(CASE WHEN unknown THEN 0 ELSE len(pa) - len(ba) END) AS BIGINT) AS extra_calls,
        count(*) FILTER (NOT unknown AND len(pa) > 1) AS retry_images, count(*) FILTER (NOT unknown AND len(list_filter(pa, lambda v: NOT list_contains(ba, v))) > 0) AS images_with_new_stages,
        CAST(sum(CASE WHEN unknown THEN 0 ELSE pm END) AS BIGINT) AS micros, CAST(sum(CASE WHEN unknown THEN 0 ELSE pm - bm END) AS BIGINT) AS extra_micros,
        round(sum(CASE WHEN unknown THEN 0 ELSE pm END) / 1000000 * 500 / count(*), 6) AS projected_seconds FROM beside GROUP BY 1, 2""",
    "cohort_policy_changes": f"""WITH {BESIDE} SELECT cohort, policy, image_id, truth, bf AS "old", pf AS "new", coalesce(bf = truth, false) AS old_correct, coalesce(pf = truth, false) AS new_correct,
        array_to_string(pa, ',') AS attempts FROM beside WHERE bf IS DISTINCT FROM pf""",
    "fold_of_passes": f"""{SAVED}, q AS (SELECT *, CASE WHEN o.stage IS NULL THEN 'original_512' WHEN o.has THEN NULL WHEN r.stage IS NULL THEN 'rotation_270' WHEN r.has THEN NULL
          WHEN h.stage IS NULL THEN 'highres_1024' WHEN h.has THEN NULL WHEN c.stage IS NULL THEN 'clahe' END AS missing_stage,
          CASE WHEN o.has THEN 1 WHEN r.has THEN 2 WHEN h.has THEN 3 ELSE 4 END AS asked, CASE WHEN o.has THEN o WHEN r.has THEN r WHEN h.has THEN h WHEN c.has THEN c END AS s FROM side),
        fo AS (SELECT *, missing_stage IS NULL AS known, coalesce(s.f, 'NONE') AS f, coalesce(s.has, false) AS found, o.boxes + r.boxes + h.boxes + c.boxes AS boxes FROM q)
        SELECT image_id, truth, CASE WHEN known THEN f END AS final_date, CASE WHEN known THEN coalesce(s.stage, 'original_no_candidate') END AS method,
        CASE WHEN known THEN array_to_string((['original_512', 'rotation_270', 'highres_1024', 'clahe'])[1:asked], ',') END AS attempts, known AND f = truth AS correct,
        CASE WHEN NOT known THEN 'unknown' WHEN f = truth THEN 'success' WHEN found THEN 'parser_wrong_after_candidate' WHEN boxes = 0 THEN 'ocr_no_boxes'
          ELSE 'ocr_boxes_no_date_candidate' END AS failure_stage,
        CASE WHEN known THEN CASE WHEN asked > 1 THEN r.micros ELSE 0 END + CASE WHEN asked > 2 THEN h.micros ELSE 0 END + CASE WHEN asked > 3 THEN c.micros ELSE 0 END END AS fallback_micros,
        missing_stage FROM fo""",
    "control_of_passes": f"""{SAVED}, q AS (SELECT *, o.stage IS NOT NULL AND (o.has OR r.stage IS NOT NULL) AS known, NOT coalesce(o.has, false) AND coalesce(r.has, false) AS moved FROM side)
        SELECT image_id, CASE WHEN known THEN CASE WHEN moved THEN 'rotation_270' ELSE 'original_512' END END AS source,
        CASE WHEN known THEN CASE WHEN moved THEN r.f ELSE o.f END END AS final_date, CASE WHEN known THEN o.has OR moved END AS has_candidate,
        CASE WHEN known THEN CASE WHEN moved THEN r.f ELSE o.f END = truth END AS correct FROM q""",
    "cohort_membership": f"{COHORT} SELECT image_id, membership FROM mem",
    "shadow_changes": f"{SHADOW} SELECT * FROM shadowed",
    "shadow_summary": f"""{SHADOW}, s AS (SELECT count(*) AS n, count(*) FILTER (baseline_correct) AS baseline_correct, count(*) FILTER (shadow_correct) AS shadow_correct,
        count(*) FILTER (triggered) AS triggered, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in (
            "recovery", "regression", "wrong_to_different_wrong", "unchanged_correct", "unchanged_wrong", "unknown"))},
        count(*) FILTER (triggered AND baseline_correct) AS triggered_correct, CAST(sum(len(list_filter(string_split(attempts, ','), lambda x: x <> ''))) AS BIGINT) AS attempts,
        CAST(sum(original_micros) AS BIGINT) AS original_micros, CAST(sum(retry_micros) AS BIGINT) AS retry_micros FROM shadowed)
        SELECT *, triggered - triggered_correct AS triggered_wrong, shadow_correct - baseline_correct AS net_correct, round(500.0::DOUBLE / n * triggered, 6) AS projected_triggers,
        round(500.0::DOUBLE / n * 2 * triggered, 6) AS projected_retries, round(500.0::DOUBLE / n * retry_micros / 1000000, 6) AS projected_retry_seconds FROM s""",
    "retry_overlay": f"""WITH {ST}, {FIRST} SELECT fc.image_id, CASE WHEN k.has THEN k.f ELSE fc.f END AS final_date, coalesce(k.has, false) AS overlaid
        FROM fc LEFT JOIN st k ON k.image_id = fc.image_id AND k.stage = 'clahe_1024'""",
    "merged_stage_sources": f"WITH {ST} SELECT CASE WHEN has THEN 'early' ELSE 'late' END AS origin, stage, count(*) AS n FROM st GROUP BY 1, 2",
    "hybrid_fill": f"""WITH {ST} SELECT stage, count(*) AS n, count(*) FILTER (stage IN ('original_512', 'rotation_270')) AS fresh FROM st GROUP BY 1""",
    "accuracy_by_truth_group": f"""WITH {ST}, {TRUTH}, {FIRST}, {SCORED}, names AS (SELECT unnest(['all', 'complete', 'partial_none', 'all_none']) AS truth_group)
        SELECT truth_group, count(image_id) AS n, round(avg((y = ty)::INT), 9) AS year_accuracy, round(avg((m = tm)::INT), 9) AS month_accuracy,
        round(avg((dd = td)::INT), 9) AS day_accuracy, round(avg((f = truth)::INT), 9) AS final_date_accuracy
        FROM names LEFT JOIN sc ON truth_group = 'all' OR g = truth_group GROUP BY 1""",
    "gains_regressions": f"""WITH {ST}, {TRUTH}, {FIRST}, {cascade_cte()} SELECT image_id, fc.f AS "old", done.f AS "new",
        CASE WHEN fc.f IS NULL OR done.f IS NULL OR truth IS NULL THEN 'unknown' WHEN fc.f <> truth AND done.f = truth THEN 'gain'
          WHEN fc.f = truth THEN 'regression' ELSE 'changed_wrong' END AS kind
        FROM fc FULL JOIN (SELECT * FROM res LEFT JOIN (SELECT image_id, f FROM done) USING (image_id)) done USING (image_id) LEFT JOIN tr USING (image_id)
        WHERE fc.f IS DISTINCT FROM done.f OR truth IS NULL OR fc.f IS NULL""",
    "policy_comparison": f"""WITH {ST}, {TRUTH}, base AS (WITH {cascade_cte()} SELECT * FROM done), trial AS (WITH {cascade_cte('false')} SELECT * FROM done)
        SELECT cohort, 'no_short_retry' AS policy, count(*) AS n, count(*) FILTER (t.f = truth) AS correct,
        count(*) FILTER (b.f <> truth AND t.f = truth) AS gains, count(*) FILTER (b.f = truth AND t.f <> truth) AS regressions,
        CAST(sum(len(t.asked)) AS BIGINT) AS calls, CAST(sum(len(t.asked) - len(b.asked)) AS BIGINT) AS extra_calls,
        count(*) FILTER (len(list_filter(t.asked, lambda v: NOT list_contains(b.asked, v))) > 0) AS images_with_new_stages
        FROM base b JOIN trial t USING (image_id) JOIN tr USING (image_id) GROUP BY 1""",
    "stage_oracle": f"""WITH {ST}, {TRUTH}, {FIRST}, h AS (SELECT image_id, bool_or(f = truth) AS hit FROM st JOIN tr USING (image_id) GROUP BY 1)
        SELECT count(*) AS n, count(*) FILTER (f IS NULL) AS unknown, count(*) FILTER (hit) AS oracle, count(*) FILTER (f = truth) AS correct,
        count(*) FILTER (hit AND f <> truth) AS missed_choice FROM tr LEFT JOIN fc USING (image_id) LEFT JOIN h USING (image_id)""",
    "candidate_oracle": f"""WITH {ST}, {TRUTH} SELECT stage, count(*) AS errors, count(*) FILTER (list_contains(cd, truth)) AS recoverable
        FROM st JOIN tr USING (image_id) WHERE f <> truth GROUP BY 1""",
    "early_stop_oracle": f"""WITH {ST}, {TRUTH}, n AS (SELECT *, list_position(['original_512', 'rotation_270', 'highres_1024', 'clahe'], stage) AS no
          FROM st JOIN tr USING (image_id) WHERE stage <> 'clahe_1024'),
        i AS (SELECT image_id, any_value(truth) AS truth, min(no) FILTER (has) AS stop, coalesce(arg_min(f, no) FILTER (has), 'NONE') AS normal,
          max(no) FILTER (f = truth) AS last_hit, list(struct_pack(no := no, s := CAST(round(l_tax * 1000000) AS BIGINT))) AS rec FROM n GROUP BY 1)
        SELECT coalesce(['original_512', 'rotation_270', 'highres_1024', 'clahe'][stop], 'original_no_candidate') AS stop_stage,
        CASE WHEN normal = truth THEN 'preserve' WHEN last_hit > stop THEN 'fix' ELSE 'fail' END AS outcome, count(*) AS n,
        CAST(sum(coalesce(len(list_filter(rec, lambda x: x.no > stop)), 0)) AS BIGINT) AS extra,
        CAST(sum(coalesce(list_sum(list_transform(list_filter(rec, lambda x: x.no > stop), lambda x: x.s)), 0)) AS BIGINT) AS micros FROM i GROUP BY 1, 2""",
    "failure_stage_counts": f"""WITH {ST}, {TRUTH}, {FIRST} SELECT CASE WHEN method IS NULL THEN 'missing_image' WHEN method = 'original_no_candidate'
        THEN 'ocr_boxes_no_date_candidate' WHEN f = truth THEN 'success' ELSE 'parser_wrong_after_candidate' END AS failure_stage, count(*) AS n
        FROM tr LEFT JOIN fc USING (image_id) GROUP BY 1""",
    "wrong_answer_kinds": f"""WITH {ST}, {TRUTH}, {FIRST}, {SCORED} SELECT CASE WHEN f = 'NONE' THEN 'none' WHEN f LIKE '%NONE%' THEN 'partial' ELSE 'full' END AS kind,
        count(*) AS n FROM sc WHERE f <> truth GROUP BY 1""",
    "late_date_errors": f"""WITH {ST}, {TRUTH}, {FIRST}, {SCORED} SELECT method, count(*) AS errors, count(*) FILTER (
        CASE WHEN f = 'NONE' OR truth = 'NONE' THEN false WHEN dd <> 'NONE' AND td <> 'NONE' THEN f > truth
        ELSE left(f, 7) > left(truth, 7) END) AS late FROM sc WHERE f <> truth GROUP BY 1""",
    "error_classes": f"""WITH {ST}, {TRUTH}, {FIRST}, {SCORED}, h AS (SELECT image_id, bool_or(f = truth) AS hit,
          coalesce(bool_or(list_contains(cd, truth)), false) AS listed, bool_or(left(f, 7) = left(truth, 7)) AS mon
          FROM st JOIN tr USING (image_id) GROUP BY 1)
        SELECT CASE WHEN hit THEN 'D' WHEN listed THEN 'C' WHEN mon THEN 'B' ELSE 'A' END AS error_class, count(*) AS n
        FROM sc JOIN h USING (image_id) WHERE f <> truth GROUP BY 1""",
    "method_attempt_counts": f"""WITH {ST}, {cascade_cte()} SELECT 'stage' AS kind, name, count(*) AS n FROM (SELECT unnest(asked) AS name FROM done) GROUP BY 2
        UNION ALL SELECT 'method', CASE WHEN missing_stage IS NULL THEN method ELSE 'unknown' END, count(*) FROM res GROUP BY 2""",
    "coverage_gap": f"""WITH {ST}, {TRUTH}, {FIRST} SELECT image_id, count(fc.f) AS predicted, count(truth) AS labelled
        FROM fc FULL JOIN tr USING (image_id) GROUP BY 1 HAVING count(fc.f) <> 1 OR count(truth) <> 1""",
    "baseline_issues": f"""WITH {ST}, {FIRST} SELECT image_id, s.f AS stored, fc.f AS recomputed,
        CASE WHEN s.f IS NULL THEN 'not_stored' WHEN fc.f IS NULL THEN 'not_recomputed' ELSE 'differs' END AS issue
        FROM (SELECT * FROM st WHERE stage = 'original_512') s FULL JOIN fc USING (image_id) WHERE s.f IS DISTINCT FROM fc.f""",
    "grown_attempts": f"""WITH {ST}, base AS (WITH {cascade_cte()} SELECT * FROM done), trial AS (WITH {cascade_cte('false')} SELECT * FROM done)
        SELECT image_id, array_to_string(list_filter(b.asked, lambda v: NOT list_contains(t.asked, v)), ',') AS added
        FROM base b JOIN trial t USING (image_id) WHERE len(list_filter(b.asked, lambda v: NOT list_contains(t.asked, v))) > 0""",
    "oracle_change": f"""WITH {ST}, {TRUTH}, h AS (SELECT image_id, coalesce(bool_or(f = truth AND stage <> 'clahe_1024'), false) AS b,
          coalesce(bool_or(f = truth AND stage <> 'original_512'), false) AS a FROM st JOIN tr USING (image_id) GROUP BY 1)
        SELECT count(*) AS n, count(*) FILTER (b) AS before, count(*) FILTER (a) AS after, count(*) FILTER (a AND NOT b) AS gained,
        count(*) FILTER (b AND NOT a) AS lost FROM h""",
    "run_summary": f"""WITH {ST}, {TRUTH}, {FIRST}, {SCORED}, s AS (SELECT image_id, count(*) AS boxes, CAST(sum(round(l_tax * 1000000)) AS BIGINT) AS micros FROM st GROUP BY 1),
        x AS (SELECT *, method <> 'original_no_candidate' AS has, f = truth AS ok FROM sc LEFT JOIN s USING (image_id))
        SELECT count(*) AS n, count(*) FILTER (has) AS candidates, count(*) FILTER (ok) AS correct, count(*) FILTER (has AND ok) AS correct_with_candidate,
        round(count(*) FILTER (has) / count(*), 6) AS candidate_rate, round(count(*) FILTER (has AND ok) / count(*) FILTER (has), 6) AS success_given_candidate,
        CAST(sum(boxes) AS BIGINT) AS boxes, CAST(sum(micros) AS BIGINT) AS micros, round(CAST(sum(micros) AS BIGINT) / count(*), 6) AS mean_micros FROM x""",
    "method_table": f"""WITH {ST}, {TRUTH}, {FIRST}, {cascade_cte()}, b AS (SELECT tr.image_id, truth, fc.f AS ff, CASE WHEN fc.f IS NULL THEN 0 ELSE 1 END AS fcalls,
          done.f AS pf, coalesce(len(done.asked), 0) AS pcalls FROM tr LEFT JOIN fc ON fc.image_id = tr.image_id LEFT JOIN done ON done.image_id = tr.image_id),
        u AS (SELECT 'first' AS policy, ff AS f, fcalls AS calls, truth, coalesce(ff = truth, false) AS base FROM b
          UNION ALL SELECT 'production', pf, pcalls, truth, coalesce(ff = truth, false) FROM b), o AS (SELECT *, coalesce(f = truth, false) AS ok FROM u)
        SELECT policy, count(*) AS n, count(*) FILTER (f IS NULL) AS unknown, CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (ok) AS exact,
        round(count(*) FILTER (ok) / count(*), 6) AS accuracy, round(100.0 * (count(*) FILTER (ok) - count(*) FILTER (base)) / count(*), 6) AS points,
        count(*) FILTER (ok AND NOT base) AS recoveries, count(*) FILTER (base AND NOT ok) AS regressions FROM o GROUP BY 1""",
    "verdict_changes": f"""WITH {RECORDS}, e AS (SELECT *, coalesce(bad, cal, CASE WHEN final_date <> cf THEN 'component_final_mismatch' END) AS error FROM checked),
        x AS (SELECT CASE WHEN k IS NOT NULL THEN coalesce(strftime(d, '%Y-%m-%d') = final_date, false) END AS raw,
        CASE WHEN k IS NOT NULL THEN coalesce(error IS NULL AND strftime(d, '%Y-%m-%d') = cf, false) END AS normalised FROM e)
        SELECT raw, normalised, count(*) AS n FROM x GROUP BY 1, 2""",
    "stage_texts": f"""WITH {LI} SELECT img AS image_id, {STAGE_NAME} AS stage, string_agg(CASE l_returnflag WHEN 'A' THEN 'EXP ' WHEN 'R' THEN 'MFG ' ELSE '' END || {FORMATTED},
        ' | ' ORDER BY ord, CASE l_returnflag WHEN 'A' THEN 'EXP ' WHEN 'R' THEN 'MFG ' ELSE '' END || {FORMATTED}) AS texts FROM li GROUP BY 1, 2""",
    "stage_timing_profile": f"""WITH {EV}, g AS (SELECT event_type, count(*) AS calls, CAST(sum(micros) AS BIGINT) AS micros, list_sort(list(micros::DOUBLE)) AS l FROM ev GROUP BY 1)
        SELECT event_type, calls, micros, {_exclusive(0.9)} AS p90, {_exclusive(0.5)} AS median FROM g""",
    "listed_stage_seconds": f"""WITH {EV} SELECT event_type AS stage, count(*) AS calls, CAST(sum(micros) AS BIGINT) AS micros FROM ev GROUP BY 1
        UNION ALL SELECT 'total', count(*), CAST(sum(micros) AS BIGINT) FROM ev""",
    "runtime_projection": f"""WITH {EV} SELECT event_type AS stage, count(*) AS calls,
        round(count(*) * (CAST(sum(micros) AS BIGINT) / count(*) / 1000000) * 500 / 1000 / 1.9226, 4) AS projected_seconds FROM ev GROUP BY 1""",
    "speed_gate": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM ev),
        g AS (SELECT event_type, count(*) AS calls, CAST(sum(micros) FILTER (rn <= 10) AS BIGINT) / least(count(*), 10) * count(*) / 1000000 AS p FROM r GROUP BY 1)
        SELECT event_type, calls, round(p, 4) AS projected_seconds, p <= 45000 AS within_limit FROM g""",
    "wilson_by_source": """WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY 1),
        x AS (SELECT *, hits / n AS p, 1.96::DOUBLE AS z FROM g)
        SELECT source, n, hits, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS low,
        round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS high FROM x""",
    "paired_variant": """SELECT source, count(*) AS n, count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a,
        count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b, count(*) FILTER (quality = 1 AND toxic = 1) AS both
        FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "paired_sign_test": """WITH x AS (SELECT source, count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b
        FROM labels JOIN documents USING (doc_id) GROUP BY 1)
        SELECT source, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1),
          lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END, 9) AS p_value FROM x""",
    "snapshot_diff": f"""WITH {ST}, a AS (SELECT image_id, stage, f AS "old" FROM st WHERE stage <> 'clahe_1024'),
        b AS (SELECT image_id, stage, CASE WHEN se THEN 'NONE' ELSE f END AS "new" FROM st WHERE stage <> 'original_512')
        SELECT image_id, stage, "old", "new", CASE WHEN "old" IS NULL THEN 'added' WHEN "new" IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL OUTER JOIN b USING (image_id, stage) WHERE "old" IS DISTINCT FROM "new" """,
    "truth_normalise": f"""WITH {RECORDS}, e AS (SELECT *, coalesce(bad, cal, CASE WHEN final_date <> cf THEN 'component_final_mismatch' END) AS error FROM checked)
        SELECT image_id, source, CASE WHEN error IS NULL THEN y END AS year, CASE WHEN error IS NULL THEN m END AS month,
        CASE WHEN error IS NULL THEN dd END AS day, CASE WHEN error IS NULL THEN cf END AS final_date, error FROM e""",
    "id_keys": f"""WITH {RECORDS} SELECT DISTINCT image_id, CAST(k AS VARCHAR) AS number, printf('%06d', k) AS padded,
        CASE WHEN day <> 'xx' THEN day END AS legacy_day FROM rec""",
    "label_record_reasons": f"""WITH {REASONED} SELECT key, source, array_to_string(reasons, ';') AS reasons, CASE WHEN bad IS NOT NULL THEN '' ELSE
        concat_ws(';', CASE WHEN year <> y THEN 'year' END, CASE WHEN month <> m THEN 'month' END, CASE WHEN final_date <> cf THEN 'final_date' END) END AS format_changes FROM why""",
    "label_review_images": f"""WITH {IMAGES} SELECT key AS image_id, n_sources, n_records,
        CASE WHEN all_valid AND variants = 1 THEN y ELSE '' END AS candidate_year, CASE WHEN all_valid AND variants = 1 THEN m ELSE '' END AS candidate_month,
        CASE WHEN all_valid AND variants = 1 THEN dd ELSE '' END AS candidate_day, CASE WHEN all_valid AND variants = 1 THEN cf ELSE '' END AS candidate_final_date,
        array_to_string(reasons, ';') AS review_reason, CASE WHEN len(reasons) > 0 THEN 'pending' ELSE 'ready_for_review' END AS review_status FROM rv""",
    "label_review_summary": f"""WITH {IMAGES} SELECT 'total' AS kind, 'unique_images' AS value, count(*) AS n FROM rv
        UNION ALL SELECT 'total', 'source_rows', CAST(sum(n_records) AS BIGINT) FROM rv
        UNION ALL SELECT 'total', 'cross_source_overlap', count(*) FILTER (n_sources > 1) FROM rv
        UNION ALL SELECT 'reason', x, count(*) FROM (SELECT unnest(reasons) AS x FROM rv) GROUP BY 2
        UNION ALL SELECT 'status', CASE WHEN len(reasons) > 0 THEN 'pending' ELSE 'ready_for_review' END, count(*) FROM rv GROUP BY 2""",
    "approved_labels": f"""WITH {ORD} SELECT CAST(o_orderkey AS VARCHAR) AS image_id, strftime(d, '%Y') AS year, strftime(d, '%m') AS month,
        strftime(d, '%d') AS day, {ISO} AS final_date, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 10 = 0 THEN 'incomplete_approval' END AS error
        FROM o WHERE o_orderstatus = 'F'""",
    "submission_violations": f"""WITH {SUB}, v AS (SELECT image_id, unnest(list_filter([
          CASE WHEN trim(image_id) = '' THEN 'blank_id' END, CASE WHEN NOT regexp_full_match(image_id, '[0-9A-Za-z_-]+') THEN 'id_characters' END,
          CASE WHEN coalesce(length(year), 0) <> 4 THEN 'year' END, CASE WHEN month = '13' THEN 'month' END, CASE WHEN day = '00' THEN 'day' END,
          CASE WHEN coalesce(final_date <> year || '-' || month || '-' || day, true) THEN 'final_date' END], lambda x: x IS NOT NULL)) AS rule FROM s),
        known AS (SELECT img FROM o WHERE o_orderkey % 50 <> 3)
        SELECT rule, image_id, count(*) AS n FROM v GROUP BY 1, 2
        UNION ALL SELECT 'duplicate_id', image_id, count(*) FROM s GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'unknown_id', image_id, count(*) FROM s WHERE image_id NOT IN (SELECT img FROM known) GROUP BY 2""",
    "completeness_gap": f"""WITH {ST}, plan AS (SELECT image_id, unnest({list(STAGES)}) AS stage FROM (SELECT DISTINCT image_id FROM st))
        SELECT image_id, stage FROM plan ANTI JOIN (SELECT * FROM st WHERE has) USING (image_id, stage)""",
    "duplicate_stage_records": f"WITH {LI} SELECT img AS image_id, {STAGE_NAME} AS stage, count(*) AS n FROM li GROUP BY 1, 2 HAVING count(*) > 1",
    "record_checksums": """SELECT o_orderkey, sha256(printf('{"o_orderkey":%d,"o_orderpriority":"%s","o_orderstatus":"%s"}',
        o_orderkey, o_orderpriority, o_orderstatus)) AS record_sha256 FROM orders""",
    "broken_checksums": "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0",
    "table_fingerprint": """WITH h AS (SELECT sha256(printf('{"o_orderkey":%d,"o_orderstatus":"%s"}', o_orderkey, o_orderstatus)) AS h FROM orders)
        SELECT count(*) AS n, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS s{i}" for i in range(8)) + " FROM h",
    "sampled_images": f"WITH {ORD} SELECT img AS image_id, o_orderstatus FROM o ORDER BY sha256('42:' || img), img LIMIT 250",
    "sample_drift": f"WITH {ORD} SELECT img AS image_id, o_orderstatus FROM o WHERE o_orderkey % 3 = 0",
    "reuse_audit": f"""WITH {ST}, x AS (SELECT CASE WHEN stage = 'rotation_270' THEN 'not_in_plan' WHEN has AND sa THEN 'final_date' ELSE '' END AS reasons FROM st)
        SELECT reasons = '' AS reusable, reasons, count(*) AS n FROM x GROUP BY 1, 2""",
    "detection_validation": f"""WITH {LI} SELECT concat_ws(';', CASE WHEN l_partkey % 11 = 0 THEN 'text' END, CASE WHEN l_partkey % 13 = 0 THEN 'confidence' END,
        CASE WHEN l_partkey % 17 = 0 THEN 'polygon' END, CASE WHEN l_partkey % 19 = 0 THEN 'timing' END,
        CASE WHEN l_partkey % 23 = 0 THEN 'stage_shorter_than_recognition' END) AS errors, count(*) AS n FROM li GROUP BY 1""",
    "unfinished_work": f"WITH {ST} SELECT image_id, stage FROM st WHERE NOT has",
    "keyword_crop_window": f"""WITH {LI}, b AS (SELECT img, ord, cx, cy, greatest(1600.0, 512.0) AS w, greatest(200.0, 230.4) AS h FROM li WHERE l_returnflag = 'A'),
        s AS (SELECT *, greatest(cy - h / 2, 0.0) AS t0, greatest(cx - 0.6 * 1024 / 2, 0.0) AS l0 FROM b)
        SELECT img AS image_id, ord AS box_index, 0 AS crop_left, 1024 AS crop_right,
        CAST(floor(least(t0, 768 - h)) AS BIGINT) AS crop_top, CAST(ceil(least(t0, 768 - h) + h) AS BIGINT) AS crop_bottom,
        round(least(l0, 1024 * 0.4), 3) AS centre_left, round(least(l0, 1024 * 0.4) + 614.4, 3) AS centre_right FROM s""",
    "keyword_anchor_choice": f"""WITH {LI} SELECT img AS image_id, {STAGE_NAME} AS stage, ord AS box_index, conf AS confidence FROM li
        WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY img ORDER BY conf DESC, l_suppkey % 5, ord) = 1""",
}
