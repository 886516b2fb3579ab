"""Texts of one image and the date that must come out, rendered per rule from date columns.

Every rule is a way to print a date with what a printer, a label or a recogniser adds around it; it is rendered from
several dates and says which parts of the date are left.
"""

import datetime

DATES = [datetime.date(2026, 3, 14), datetime.date(2027, 11, 29), datetime.date(2028, 2, 29)]
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def fields(d):
    name = MONTHS[d.month - 1]
    return {"y": f"{d.year}", "yy": f"{d.year % 100}", "m": f"{d.month:02}", "d": f"{d.day:02}", "m1": str(d.month), "d1": str(d.day),
            "MON": name, "Mon": name.capitalize(), "mon": name.lower()}


#: lines of a rule, and what is read: "full", "month" (no day), "day" (no year), "none"
RULES = [
    # one written form each
    ("{y}.{m}.{d}", "full"), ("{y}-{m}-{d}", "full"), ("{y}/{m}/{d}", "full"), ("{d}/{m}/{y}", "full"), ("{y},{m},{d}", "full"),
    ("{y}, {m}, {d}", "full"), ("{y},{m}.{d}", "full"), ("{y}.{m},{d}", "full"), ("{y}·{m}.{d}", "full"), ("{d}.{m}·{y}", "full"),
    ("{d}.{m},{y}", "full"), ("{y}.{m}:{d}", "full"), ("{y}:{m}.{d}", "full"), ("{y}.{m}{d}", "full"), ("{y}{m} {d}", "full"),
    ("{y}{m}{d}", "full"), ("{d}{m}{y}", "full"), ("{y}{MON}{d}", "full"), ("{d}{MON}{y}", "full"), ("{d} {Mon} {y}", "full"),
    ("{d}-{Mon}-{yy}", "full"), ("{MON} {d} {y}", "full"), ("{MON}{d}{y}", "full"), ("{d}{MON} {y}", "full"),
    ("{y}년 {m}월 {d}일", "full"), ("{y}년 {m1}월 {d1}일", "full"),
    # month and year
    ("{m}/{y}", "month"), ("{y},{m}", "month"), ("{MON}{y}", "month"), ("EXP {m}{y}", "month"), ("EXP {m}/{yy}", "month"),
    ("Exp.Date: {m}/{yy}", "month"), ("expiration: {m}/{yy}", "month"), ("{y}년 {m}월 소비기한", "month"),
    (("{MON}q{y}", "Month/Year"), "month"), (("[{Mon}z{y}]", "Month/Year"), "month"), (("EXP", "{y}{m}"), "month"),
    # no year
    ("{m}.{d}까지", "day"), ("{m}월 {d}일", "day"), ("{m}.{d}17시B4", "day"), (("사용기한", "{m}.{d}.08:41.KD", "까지"), "day"),
    # with what stands around
    ("EXP:{y},{m},{d}", "full"), ("EXP:{y}X{m}/{d}", "full"), ("{y}.{m}.{d} 06:55", "full"), ("BEST BY {d}{MON}{yy}", "full"),
    ("KC41M8 {y}.{m}.{d} 까지", "full"), ("1{y}.{m}.{d}까지", "full"), ("{yy}{m}{d}까지", "full"), ("{y}.{m}.{d}까지", "full"),
    ("EXP{y}{m}{d}4", "full"), ("{y}{m}{d}52까지", "full"), (("AB207", "EXP {y}.{m}.{d}"), "full"), ("소비기한 {y}.{m}.{d}", "full"),
    (("Best before (dd/mm/yy)", "{d}.{m}.{yy}"), "full"), (("제조일자 2024.01.05", "소비기한 {y}.{m}.{d}"), "full"),
    (("PROD. DATE:21/06/2024", "EXP. DATE:{d}/{m}/{y}"), "full"), (("MFD 2024.02.03", "EXP {y}.{m}.{d}"), "full"),
    ("2025.12.20{y}.{m}.{d}까지", "full"), (("2025.01.31", "{y}.{m}.{d}"), "full"),
    # nothing that may be read
    ("PS{yy}{m}{d}", "none"), ("PROD {m}/{y}", "none"), ("제조{y}.{m}.{d}", "none"), ("LOT {yy}{m}{d}", "none"), ("Batch: {m}/{yy}", "none"),
    ("{MON}q{y}", "none"), (("LOT {MON}q{y}", "Month/Year"), "none"), ("EXP {y}{m}{d}77", "none"), ("{m}{y}", "none"), ("1{y}.{m}.{d}", "none"),
    ("KD407MFD{y}{m}{d}", "none"), (("EXP", "{m}/{yy}"), "none"), ("{y},,{m},,{d}", "none"),
]


def read(kind, d):
    return {"full": f"{d:%Y-%m-%d}", "month": f"{d:%Y-%m}-NONE", "day": f"NONE-{d:%m-%d}", "none": "NONE"}[kind]


def rendered():
    for lines, kind in RULES:
        for d in DATES:
            yield [x.format(**fields(d)) for x in ([lines] if isinstance(lines, str) else lines)], read(kind, d)


def after_manufacture():
    """A period from the date of manufacture, in the three units."""
    for made, text, end in (("2024.08.31", "6개월", "2025-02-28"), ("2023.05.17", "3년", "2026-05-17"), ("2025.11.20", "45일", "2026-01-04")):
        yield [f"제조일자 {made}", f"제조일로부터 {text}까지"], end


# Single texts that a wrong reading was seen on.
PINNED = [
    (["3,456,789"], "NONE"), (["2028,02,310"], "2028-02-NONE"), (["07:45"], "NONE"), (["2O27.C8.15"], "2027-08-15"),
    (["1992 2025"], "NONE"), (["04.1724시"], "NONE"), (["04월 31일"], "NONE-04-NONE"), (["소비기한 2027.02.30"], "2027-02-NONE"),
    (["NET 4.15 fl.oz"], "NONE"), (["영양성분표"], "NONE"), (["２０２８년 ０４월 ０９일"], "2028-04-09"),
]

STACKED = [*rendered(), *after_manufacture(), *PINNED]


def day_beside(first, gap, down=0, confidence=0.97, second=None):
    """A month and a day box beside it."""
    out = [(f"2027.{first}", 10, 20, 120, 24), ("21", 130 + gap, 20 + down, 24, 24, confidence)]
    return out + ([(second, 134 + gap, 20, 24, 24, 0.97)] if second else [])


# (text, x, y, width, height, confidence) per box, the rest as far as it is given
PLACED = [
    # the nearer keyword decides
    ([("제조일자", 0, 0), ("2027.04.18", 0, 6), ("소비기한", 0, 140), ("2028.10.18", 0, 146)], "2028-10-18"),
    ([("유통기한", 0, 0), ("2027.04.18", 0, 2), ("소비기한", 0, 140), ("2028.10.18", 0, 152)], "2028-10-18"),
    ([("소비기한", 0, 0), ("2027.04.18", 0, 2), ("2028.10.18", 0, 70)], "2028-10-18"),
    ([("제조일자", 0, 0), ("2027.04.18", 0, 6)], "2027-04-18"),
    # year and month in one number need a label beside them
    ([("EXP:", 0, 0, 44, 22), ("202811", 50, 0, 44, 22)], "2028-11-NONE"),
    ([("202811", 50, 0, 44, 22)], "NONE"),
    ([("LOT:", 0, 0, 44, 22), ("202811", 50, 0, 44, 22)], "NONE"),
    ([("EXP:", 0, 0, 44, 22), ("202811", 260, 0, 44, 22)], "NONE"),
    ([("EXP:", 0, 0, 44, 22), ("202811", 50, 95, 44, 22)], "NONE"),
    ([("EXP:", 0, 0, 44, 22), ("202814", 50, 0, 44, 22)], "NONE"),
    # a day in a box of its own
    (day_beside("05", 6), "2027-05-21"),
    (day_beside("05", 60), "2027-05-NONE"),
    (day_beside("05", 6, down=40), "2027-05-NONE"),
    (day_beside("05", 6, confidence=0.4), "2027-05-NONE"),
    (day_beside("05", 6, second="22"), "2027-05-NONE"),
]

# candidate dates of an image, in the order of its boxes: two-digit years follow the order a four-digit one shows
CANDIDATES = [
    (["27/10/21", "26/10/2023"], ["2021-10-27", "2023-10-26"]),
    (["27.10.21", "26/10/2023"], ["2023-10-26", "2027-10-21"]),
    (["27/10/21", "07/10/2023"], ["2023-10-07", "2027-10-21"]),
    (["27/10/21", "31/02/2023"], ["2023-02-NONE", "2027-10-21"]),
]
