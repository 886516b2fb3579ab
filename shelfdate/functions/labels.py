"""Ground-truth labels: normalisers and reason codes.

The steps add columns one after another instead of nesting one large expression, so that the
optimizer sees each part once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import constants as C


def is_none(value: Column) -> Column:
    return F.lower(F.trim(value)) == "none"


def _digits(value: Column) -> Column:
    return F.trim(value).rlike("^[0-9]+$")


def short_year(number: Column, low: int = C.YEAR_MIN, high: int = C.YEAR_MAX) -> Column:
    """A two-digit year inside the window, the 2000s first."""
    return (F.when((number + 2000).between(low, high), number + 2000)
            .when((number + 1900).between(low, high), number + 1900))


def _component(value: Column, width: int) -> Column:
    number = F.trim(value).try_cast("int")
    if width == 4:
        length = F.length(F.trim(value))
        number = F.when(length <= 2, short_year(number)).when(length == 4, number)
    text = number.cast("string")
    # zero padding never shortens: a longer number stays as it is
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.when(is_none(value), F.lit(C.NONE)).when(_digits(value), padded)


def join_date(y: Column, m: Column, d: Column) -> Column:
    return F.when((y == C.NONE) & (m == C.NONE) & (d == C.NONE), F.lit(C.NONE)).otherwise(F.concat_ws("-", y, m, d))


def month_length(y: Column, m: Column) -> Column:
    leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
    return F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31).when(leap, 29).otherwise(28)


def calendar_error(y: Column, m: Column, d: Column) -> Column:
    """Reason code of a date that does not exist, empty when it may; parts may be NONE."""
    yi, mi, di = (v.try_cast("int") for v in (y, m, d))
    return (F.when(yi.isNotNull() & ~yi.between(1, 9999), "year_out_of_calendar_range")
            .when(mi.isNotNull() & ~mi.between(1, 12), "month_out_of_range")
            .when(di.isNotNull() & ~di.between(1, 31), "day_out_of_range")
            .when(mi.isNotNull() & di.isNotNull()
                  & (di > month_length(F.coalesce(yi, F.lit(2000)), mi)), "calendar_invalid")
            .otherwise(""))


PARTS = ("year", "month", "day")


def with_canonical(df: DataFrame, columns=PARTS, prefix: str = "c") -> DataFrame:
    """Add c_year, c_month, c_day, c_final_date (null when malformed), c_error and c_calendar.

    ``c_error`` names the malformed part; ``c_calendar`` is the reason the date cannot exist,
    empty when it can.  Month and day ranges are left to ``c_calendar``.
    """
    y, m, d = (F.col(f"_{prefix}{n}") for n in PARTS)
    df = df.withColumns({f"_{prefix}{n}": _component(F.col(c), 4 if n == "year" else 2) for n, c in zip(PARTS, columns)})
    df = df.withColumn(f"{prefix}_error", F.when(y.isNull(), "invalid_year").when(m.isNull(), "invalid_month")
                       .when(d.isNull(), "invalid_day"))
    ok = F.col(f"{prefix}_error").isNull()
    return df.withColumns({
        **{f"{prefix}_{n}": F.when(ok, F.col(f"_{prefix}{n}")) for n in PARTS},
        f"{prefix}_final_date": F.when(ok, join_date(y, m, d)),
        f"{prefix}_calendar": F.when(ok, calendar_error(y, m, d)),
    }).drop(*[f"_{prefix}{n}" for n in PARTS])


def with_stored(df: DataFrame, final: str = "final_date") -> DataFrame:
    """Add ``stored``: the canonical form of a stored final date (null when it is not one), and
    ``s_calendar``, the reason it cannot exist."""
    none = is_none(F.col(final))
    df = df.withColumn("_parts", F.when(none, F.array(*[F.lit(C.NONE)] * 3)).otherwise(F.split(F.trim(final), "-")))
    whole = F.size("_parts") == 3
    df = df.withColumns({f"_p_{n}": F.when(whole, F.get("_parts", F.lit(i))) for i, n in enumerate(PARTS)})
    df = with_canonical(df, [f"_p_{n}" for n in PARTS], "s")
    return df.withColumn("stored", F.col("s_final_date")).drop(
        "_parts", *[f"_p_{n}" for n in PARTS], *[f"s_{n}" for n in PARTS], "s_final_date", "s_error")


def with_truth(df: DataFrame) -> DataFrame:
    """Add t_year ... t_final_date and t_error: a possible calendar date whose stored final date
    is the one its components make."""
    df = with_stored(with_canonical(df))
    mismatch = ~F.coalesce(F.col("stored") == F.col("c_final_date"), F.lit(False))
    df = df.withColumn("t_error", F.coalesce(
        "c_error", F.when(F.col("c_calendar") != "", F.col("c_calendar")),
        F.when(mismatch, "component_final_mismatch")))
    return df.withColumns({f"t_{n}": F.when(F.col("t_error").isNull(), F.col(f"c_{n}")) for n in (*PARTS, "final_date")})


def legacy_component(value: Column, width: int) -> Column:
    """Early label files: blanks and NaN are unknown, numbers may be written as floats."""
    text = F.trim(F.coalesce(value, F.lit("")))
    number = text.try_cast("double").cast("int").cast("string")
    return F.when(F.upper(text).isin("", "NONE", "NAN"), C.NONE).otherwise(
        F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number))


def numeric_key(value: Column) -> Column:
    """Numeric id without leading zeros, null when it is not numeric."""
    return F.when(_digits(value), F.trim(value).try_cast("bigint").cast("string"))


def padded_key(value: Column) -> Column:
    key = numeric_key(value)
    return F.when(F.length(key) < 6, F.lpad(key, 6, "0")).otherwise(key)
