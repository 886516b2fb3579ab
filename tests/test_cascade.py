from pyspark.sql import functions as F

from shelfdate.operators.cascade import cascade

SCHEMA = ("image_id string, stage string, year string, month string, day string, final_date string, has_candidate boolean, "
          "q double, many boolean, short boolean, bare boolean, damaged_day boolean, self_anchor boolean, "
          "self_exclude boolean, candidate_dates array<string>")
O, R, H, C, K = "original_512", "rotation_270", "highres_1024", "clahe", "clahe_1024"


def row(stage, date="NONE", q=None, **flags):
    parts = date.split("-") if date != "NONE" else ["NONE"] * 3
    found = date != "NONE"
    get = lambda n: flags.get(n, False) if found else None
    return ("x", stage, *parts, date, found, q, get("many"), get("short"), False, get("damaged"), get("anchor"),
            get("exclude"), flags.get("dates", [date]) if found else None)


CASES = [
    # (stages, date, method, attempts)
    ([row(O, "2027-01-02", .95)], "2027-01-02", O, [O]),
    ([row(O, "2027-01-02", .95, anchor=True, short=True)], "2027-01-02", O, [O]),
    ([row(O, "2027-01-02", .95, short=True), row(H, "2027-01-02", .9)], "2027-01-02", "original_512_retry_kept", [O, H]),
    ([row(O, "2027-01-02", .8), row(H, "2027-01-03", .9, many=True)], "2027-01-03", "highres_1024_retry", [O, H]),
    ([row(O, "2027-01-02", .8), row(H, "2027-01-03", .7), row(C, "2027-01-02", .5)], "2027-01-02", "original_512_retry_kept", [O, H, C]),
    ([row(O, "2027-01-02", .8), row(H, "2027-01-03", .7), row(C, "2027-01-03", .5)], "2027-01-03", "highres_1024_retry", [O, H, C]),
    ([row(O, "2027-01-02", .8, anchor=True), row(H), row(C, "2027-01-05", .9, anchor=True)], "2027-01-05", "clahe_retry", [O, H, C]),
    ([row(O, "2027-01-02", .8, anchor=True), row(H), row(C, "2027-01-05", .9)], "2027-01-02", "original_512_retry_kept", [O, H, C]),
    ([row(O, "2027-01-02", .8, anchor=True), row(H, "2027-01-01", .9, exclude=True, many=True)], "2027-01-02", "original_512_retry_kept", [O, H]),
    ([row(O, "2027-01-02", .8), row(H, "2027-01-NONE", .9)], "2027-01-02", "original_512_retry_kept", [O, H]),
    ([row(O, "2025-06-30", .85, many=True, dates=["2024-12-30", "2025-06-30"]), row(H, "2024-12-30", .99)],
     "2025-06-30", "original_512_retry_kept", [O, H]),
    ([row(O), row(R, "2027-03-NONE", .9), row(H, "2027-03-04", .6)], "2027-03-04", H, [O, R, H]),
    ([row(O), row(R, "2027-03-NONE", .9), row(H), row(C)], "2027-03-NONE", R, [O, R, H, C]),
    ([row(O), row(R), row(H), row(C), row(K, "2028-01-01", .5)], "2028-01-01", K, [O, R, H, C, K]),
    ([row(O), row(R), row(H), row(C), row(K)], "NONE", "original_no_candidate", [O, R, H, C, K]),
    ([row(O, "2027-01-02", .8)], None, None, None),
]


def test_scripted_cascades(spark):
    rows = [(str(n), *r[1:]) for n, (stages, *_) in enumerate(CASES) for r in stages]
    found = {r.image_id: r for r in cascade(spark.createDataFrame(rows, SCHEMA)).collect()}
    for n, (_, date, method, attempts) in enumerate(CASES):
        r = found[str(n)]
        assert (r.final_date, r.method, r.attempts) == (date, method, attempts), n
    assert found[str(len(CASES) - 1)].missing_stage == H
