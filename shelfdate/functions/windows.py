"""Crop windows around a keyword, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
WIDTH_FACTOR, HEIGHT_FACTOR = 8, 10
MIN_WIDTH_SHARE, MIN_HEIGHT_SHARE = 0.50, 0.30


def bounded_window(center: Column, span: Column, limit: Column) -> tuple[Column, Column]:
    """A window of the wanted span, shifted into [0, limit] and widened to whole pixels."""
    size = F.least(limit.cast("double"), F.greatest(F.lit(1.0), span))
    start = F.least(F.greatest(center - size / 2, F.lit(0.0)), limit - size)
    return F.greatest(F.lit(0), F.floor(start)), F.least(limit.cast("bigint"), F.ceil(start + size))


def keyword_window(x0: Column, x1: Column, y0: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Crop of an image around a keyword box, scaled by the size of the word."""
    w = F.greatest(F.lit(1.0), x1 - x0)
    h = F.greatest(F.lit(1.0), y1 - y0)
    left, right = bounded_window((x0 + x1) / 2, F.greatest(w * WIDTH_FACTOR, width * MIN_WIDTH_SHARE), width)
    top, bottom = bounded_window((y0 + y1) / 2, F.greatest(h * HEIGHT_FACTOR, height * MIN_HEIGHT_SHARE), height)
    return {"crop_left": left, "crop_right": right, "crop_top": top, "crop_bottom": bottom}


def recentred_window(center: Column, ratio: float, size: Column) -> tuple[Column, Column]:
    """A window of a fixed share of the frame, centred where it fits."""
    span = size * ratio
    start = F.least(F.greatest(center - span / 2, F.lit(0.0)), size - span)
    return start, start + span
