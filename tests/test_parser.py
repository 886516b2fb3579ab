from conftest import BOXES, rect, stacked
from golden import CANDIDATES, PLACED, STACKED

from shelfdate.operators.select import stage_results


def build(spark):
    rows, expected = [], {}
    for n, (lines, want) in enumerate(STACKED):
        rows += stacked(f"s{n}", lines)
        expected[f"s{n}"] = (want, lines)
    for n, (boxes, want) in enumerate(PLACED):
        for i, (text, x, y, *size) in enumerate(boxes):
            w, h, conf = (list(size) + [10, 5, 0.9][len(size):])[:3]
            rows.append((f"p{n}", "original_512", i, text, conf, rect(x, y, w, h)))
        expected[f"p{n}"] = (want, boxes)
    rows.append(("empty", "original_512", 0, "2026.07.15", 0.9, []))
    rows.append(("null", "original_512", 0, None, 0.9, rect(0, 0, 10, 5)))
    expected["empty"] = expected["null"] = ("NONE", None)
    return spark.createDataFrame(rows, BOXES), expected


def test_golden_cases(spark):
    boxes, expected = build(spark)
    found = {r.image_id: r.final_date for r in stage_results(boxes, crowded=False).collect()}
    wrong = {k: (found.get(k), *want) for k, want in expected.items() if found.get(k) != want[0]}
    assert not wrong, wrong


def test_candidate_dates(spark):
    rows = [r for n, (lines, _) in enumerate(CANDIDATES) for r in stacked(str(n), lines)]
    found = {r.image_id: r.candidate_dates for r in
             stage_results(spark.createDataFrame(rows, BOXES), crowded=False).collect()}
    assert [found[str(n)] for n in range(len(CANDIDATES))] == [want for _, want in CANDIDATES]
