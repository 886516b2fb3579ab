"""Image-level facts for box rows.

Ordinary images hold at most a few hundred boxes.  They are hash-partitioned by image once and
every fact is a window aggregate over that one exchange (:class:`Together`).

A broken or blank image id can gather a large share of all boxes.  Such crowded groups never go
through a window: facts come from map-side combined aggregates joined back, distances from the
spatial search in :mod:`.spatial` (:class:`Spread`).  Both give the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import nearest_in
from ..rules import constants as C
from . import spatial
from .boxes import TEXT

KEYS = ["image_id", "stage"]
LANE_KEYS = [*KEYS, "lane"]
MAX_GROUP_BOXES = 4096

INF = "double('infinity')"


def crowded_images(boxes: DataFrame, limit: int = MAX_GROUP_BOXES) -> DataFrame:
    """(image_id, n) of the images with more boxes than one task should hold together."""
    return boxes.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def told(boxes: DataFrame, described: DataFrame) -> DataFrame:
    """Boxes with the columns that their texts have in ``described``, a bounded table of distinct texts."""
    return boxes.join(F.broadcast(described), list(TEXT))


def slim(rows: DataFrame) -> DataFrame:
    """Annotated boxes as they are exchanged: only boxes with a date token keep their text."""
    return rows.withColumn("text", F.when(F.size("tokens") > 0, F.col("text")))


def _point(kind: Column, *extra: str) -> Column:
    return F.when(F.col("placed") & kind, F.struct("cx", "cy", *extra))


def image_flags() -> dict[str, Column]:
    placed = F.col("placed")
    return {
        "any_dmy": F.max("hint_dmy"),
        "any_my": F.max("hint_my"),
        "any_slash_veto": F.max("slash_veto"),
        "any_slash_dmy": F.max("slash_dmy"),
        "has_anchor": F.max(placed & F.col("anchor")),
        "has_exclude": F.max(placed & F.col("exclude")),
        "has_primary": F.max(placed & F.col("primary")),
        "has_secondary": F.max(placed & F.col("anchor") & ~F.col("primary")),
        "first_box": F.min("box_index"),
        "period_low": F.min(F.array_min("periods")),
        "period_high": F.max(F.array_max("periods")),
    }


class Together:
    """Facts by window over one exchange on the image, into ``parts`` tasks (None: the session's)."""

    def __init__(self, keys=KEYS, parts: int | None = None):
        self.keys, self.parts = keys, parts
        self.window = Window.partitionBy(*keys)

    def prepare(self, measured: DataFrame, read, texts: DataFrame | None) -> DataFrame:
        """Boxes as ``read`` describes them, exchanged once: every window below and the cascade's grouping by image reuse
        it. With ``texts`` the boxes move and sort as they are measured and get what their text tells where they arrive."""
        spread = ([] if self.parts is None else [self.parts]) + ["image_id"]
        if texts is None:
            return slim(read(measured)).repartition(*spread)
        rows = measured.repartition(*spread).withColumn("first_box", F.min("box_index").over(Window.partitionBy(*KEYS)))
        return slim(told(rows, read(texts)))

    def facts(self, rows: DataFrame) -> DataFrame:
        points = {
            "anchor_at": _point(F.col("anchor")),
            "exclude_at": _point(F.col("exclude")),
            "primary_at": _point(F.col("primary")),
            "secondary_at": _point(F.col("anchor") & ~F.col("primary")),
            "label_at": _point(F.col("label")),
            "year_at": _point(F.col("lone_year").isNotNull(), "box_index", "lone_year"),
            "day_at": _point(F.col("lone_day").isNotNull(), "x0", "h", "confidence", "lone_day"),
        }
        facts = {n: a for n, a in image_flags().items() if n not in rows.columns} | {n: F.collect_list(p) for n, p in points.items()}
        rows = rows.withColumns({n: a.over(self.window) for n, a in facts.items()})
        dated = F.size("tokens") > 0

        def lone(expression: str) -> Column:
            return F.when(dated, F.expr(expression))

        return rows.withColumns({
            "d_anchor": F.when(dated, nearest_in("anchor_at")),
            "d_exclude": F.when(dated, nearest_in("exclude_at")),
            "d_primary": F.when(dated, nearest_in("primary_at")),
            "d_secondary": F.when(dated, nearest_in("secondary_at")),
            "label_near": lone(
                "exists(label_at, p -> abs(cy - p.cy) <= h and "
                f"sqrt((cx - p.cx) * (cx - p.cx) + (cy - p.cy) * (cy - p.cy)) <= {C.NEAR_HEIGHTS} * h)"),
            "year_near": lone(f"""
                array_min(filter(transform(year_at, p -> named_struct(
                    'd', sqrt((cx - p.cx) * (cx - p.cx) + (cy - p.cy) * (cy - p.cy)),
                    'b', p.box_index, 'y', p.lone_year)),
                  q -> q.d <= {C.NEAR_HEIGHTS} * if(h = 0, 1.0, h))).y"""),
            "days_right": lone("""
                filter(day_at, p -> p.confidence >= confidence and p.x0 - x1 between 0 and h
                  and p.h between 0.5 * h and 1.5 * h and abs(p.cy - cy) <= 0.4 * h)"""),
        }).withColumn(
            "day_right", F.expr("if(h > 0 and x1 - x0 > h and size(days_right) = 1, days_right[0].lone_day, null)")
        ).drop(*points, "days_right")

    def over(self, rows: DataFrame, **facts: Column) -> DataFrame:
        return rows.withColumns({n: a.over(self.window) for n, a in facts.items()})

    def source_confidence(self, rows: DataFrame, picks: DataFrame) -> DataFrame:
        """Lowest and highest confidence among boxes with the text and centre of the selected one."""
        same = F.expr("""transform(filter(sources, b -> b.text = selected.text and b.cx = selected.cx
                                                        and b.cy = selected.cy), b -> b.confidence)""")
        return picks.withColumn("_same", same).withColumns({"q": F.array_min("_same"), "q_high": F.array_max("_same")}).drop("_same")

    def found(self, rows: DataFrame, reference: Column) -> DataFrame:
        """Per image, beside every box: the manufacture date, all dates, the number of texts that hold one, and the places and
        confidences of dated texts."""
        found = F.size("_c") > 0
        return self.over(
            rows, reference=reference, found_dates=F.collect_list(F.when(found, F.expr("transform(_c, x -> x.r[0].k)"))),
            n_texts=F.collect_set(F.when(found, F.col("text"))),
            sources=F.collect_list(F.when(F.size("tokens") > 0, F.struct("text", "cx", "cy", "confidence"))),
        ).withColumns({"found_dates": F.array_distinct(F.flatten("found_dates")), "n_texts": F.size("n_texts")})


class Spread:
    """Facts by aggregate and join, for groups too large to hold together."""

    def __init__(self, keys=KEYS):
        self.keys = keys

    def prepare(self, measured: DataFrame, read, texts: DataFrame | None) -> DataFrame:
        return spatial.cut(slim(read(measured) if texts is None else told(measured, read(texts))))

    def over(self, rows: DataFrame, **facts: Column) -> DataFrame:
        # one row per crowded group: there are at most rows / MAX_GROUP_BOXES of them, and
        # Spark broadcasts that side only below its own size threshold
        return rows.join(rows.groupBy(*self.keys).agg(*[a.alias(n) for n, a in facts.items()]), self.keys)

    def facts(self, rows: DataFrame) -> DataFrame:
        rows = self.over(rows, **image_flags())
        probes = rows.where((F.size("tokens") > 0) & F.col("placed"))
        where = {
            "d_anchor": F.col("anchor"),
            "d_exclude": F.col("exclude"),
            "d_primary": F.col("primary"),
            "d_secondary": F.col("anchor") & ~F.col("primary"),
        }
        out = rows
        for name, kind in where.items():
            points = rows.where(F.col("placed") & kind).select(*self.keys, "cx", "cy")
            near = spatial.nearest(probes.select(*self.keys, "cx", "cy"), points, self.keys)
            out = out.join(near.withColumnRenamed("d", name), [*self.keys, "cx", "cy"], "left")
            out = out.withColumn(name, F.when(F.size("tokens") > 0, F.coalesce(name, F.expr(INF))))
        years = rows.where(F.col("lone_year").isNotNull()).select(
            *self.keys, "cx", "cy", F.struct("box_index", "lone_year").alias("payload"))
        near = spatial.nearest(probes.select(*self.keys, "cx", "cy"), years, self.keys)
        out = out.join(near.select(*self.keys, "cx", "cy", F.col("d").alias("_dy"), F.col("payload.lone_year").alias("_ny")),
                       [*self.keys, "cx", "cy"], "left")
        out = out.withColumn("year_near", F.expr(f"if(_dy <= {C.NEAR_HEIGHTS} * if(h = 0, 1.0, h), _ny, null)"))
        labels = rows.where("label").select(*self.keys, "cx", "cy")
        close = spatial.label_on_line(probes, labels, self.keys)
        out = out.join(close, [*self.keys, "cx", "cy", "h"], "left")
        out = out.withColumn("label_near", F.coalesce("label_near", F.lit(False)))
        days = rows.where(F.col("lone_day").isNotNull())
        right = spatial.day_to_the_right(probes, days, self.keys)
        out = out.join(right, [*self.keys, "x0", "x1", "cy", "h", "confidence"], "left")
        return spatial.cut(out.drop("_dy", "_ny"))

    def found(self, rows: DataFrame, reference: Column) -> DataFrame:
        # the dates of a group are bounded by the calendar; its texts are only counted
        rows = self.over(rows, reference=reference)
        facts = rows.select(*self.keys, "text", F.explode("_c").alias("x")).groupBy(*self.keys).agg(
            F.collect_set(F.expr("x.r[0].k")).alias("found_dates"), F.count_distinct("text").alias("n_texts"))
        rows = rows.join(facts, self.keys, "left").withColumn("sources", F.lit(None))
        return rows.withColumns({"found_dates": F.coalesce("found_dates", F.expr("cast(array() as array<int>)")), "n_texts": F.coalesce("n_texts", F.lit(0))})

    def source_confidence(self, rows: DataFrame, picks: DataFrame) -> DataFrame:
        same = [*self.keys, "text", "cx", "cy"]
        lowest = rows.where(F.size("tokens") > 0).groupBy(*same).agg(F.min("confidence").alias("q"), F.max("confidence").alias("q_high"))
        wanted = picks.withColumns({n: F.col("selected")[n] for n in ("text", "cx", "cy")})
        return wanted.join(lowest, same, "left").drop("text", "cx", "cy")
