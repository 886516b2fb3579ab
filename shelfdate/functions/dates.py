"""Dates as one integer (year * 10000 + month * 100 + day, 0 = unknown) and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.constants import NONE
from .tokens import days_in_month


def parts(k: Column) -> tuple[Column, Column, Column]:
    """(year, month, day), null where unknown or where there is no date at all."""
    year = (k / 10000).cast("int")
    month = F.pmod((k / 100).cast("int"), F.lit(100))
    day = F.pmod(k, F.lit(100))
    return tuple(F.when(v > 0, v) for v in (year, month, day))


def render(k: Column) -> dict[str, Column]:
    """The four output strings of a date."""
    y, m, d = parts(k)
    texts = [F.coalesce(F.lpad(v.cast("string"), n, "0"), F.lit(NONE)) for v, n in ((y, 4), (m, 2), (d, 2))]
    final = F.when(y.isNull() & m.isNull() & d.isNull(), F.lit(NONE)).otherwise(F.concat_ws("-", *texts))
    return dict(zip(("year", "month", "day", "final_date"), [*texts, final]))


def final_date(k: Column) -> Column:
    return render(k)["final_date"]


def is_complete(k: str) -> str:
    return f"({k} >= 10000 and {k} % 100 > 0)"


def latest_meaning(k: str) -> str:
    """SQL: the last day a reading can mean; 0 when it has no year."""
    y, m = f"{k} div 10000", f"({k} div 100) % 100"
    return f"(case when {k} < 10000 then 0 when {k} % 100 > 0 then {k} else {k} + {days_in_month(f'({y})', m)} end)"


def exists_on_calendar(year: str, month: str, day: str) -> str:
    return f"({day} between 1 and {days_in_month(year, month)})"


def add_period(k: str, amount: str, unit: str) -> str:
    """SQL: date plus n years, months or days; a day needs a complete date, months clamp."""
    months = f"(({k} div 100) % 100 - 1 + if({unit} = '년', {amount} * 12, {amount}))"
    y, m = f"({k} div 10000 + {months} div 12)", f"({months} % 12 + 1)"
    moved = f"date_add(make_date({k} div 10000, ({k} div 100) % 100, {k} % 100), {amount})"
    return f"""(case
      when {unit} = '일' and {is_complete(k)} then
        year({moved}) * 10000 + month({moved}) * 100 + day({moved})
      when {unit} <> '일' then {y} * 10000 + {m} * 100 + least({k} % 100, {days_in_month(y, m)}) end)"""
