"""Exact spatial search for image groups too large for one task.

Points are summarised in a pyramid of cells with tight bounds; cells halve the ranks of the
points, so one far point does not press the others into one cell.  Probes descend three
levels at a time and keep only the cells that can still hold their answer, so no step pairs
every probe with every point, and no group is gathered anywhere.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import constants as C

STEP, LEAF_POINTS = 3, 64


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder the session names; a folder of its own only for a local session without one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            shared = tempfile.mkdtemp(prefix="cut-")
        if shared is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def _numbered(values: DataFrame, keys: list[str], value: str, number: str) -> DataFrame:
    """Distinct (keys, value) with the place of the value among those of its group, from 0. Places come from one range sort
    over all groups, so a group may spread over any number of tasks; the driver holds one count per task."""
    ordered = cut(values.select(*keys, value).distinct().repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
                  .withColumn("_at", F.monotonically_increasing_id()))
    task, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in ordered.groupBy(task.alias("task")).count().orderBy("task").collect():
        offsets.append((r["task"], before))
        before += r["count"]
    starts = ordered.sparkSession.createDataFrame(offsets, "_task bigint, _before bigint")
    placed = ordered.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn("_at", row + F.col("_before"))
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return placed.join(first, keys).select(*keys, value, (F.col("_at") - F.col("_first")).alias(number))


def _gridded(points: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Points with their ranks by x and by y in their group as cell numbers of the deepest level, and that level: halving
    the ranks splits at the median, however the coordinates lie, and at the deepest level a cell is one point."""
    at = points
    for value, number in (("px", "i"), ("py", "j")):
        at = at.join(_numbered(points, keys, value, number), [*keys, value])
    at = cut(at)
    most = at.agg(F.max(F.greatest("i", "j"))).first()[0] or 0
    return at, -(-max(1, most.bit_length()) // STEP) * STEP


def _cells(points: DataFrame, keys: list[str], level: int, depth: int) -> DataFrame:
    shift, up = depth - level, STEP
    at = points.select(*keys, "px", "py", F.shiftright("i", shift).alias("i"), F.shiftright("j", shift).alias("j"))
    return at.groupBy(*keys, "i", "j").agg(
        F.min("px").alias("lx"), F.max("px").alias("hx"), F.min("py").alias("ly"), F.max("py").alias("hy"),
        F.count("*").alias("points")
    ).withColumns({"pi": F.shiftright("i", up), "pj": F.shiftright("j", up)})


NEAR_X = "greatest(lx - cx, cx - hx, 0D)"
NEAR_Y = "greatest(ly - cy, cy - hy, 0D)"
FAR_X = "greatest(abs(cx - lx), abs(cx - hx))"
FAR_Y = "greatest(abs(cy - ly), abs(cy - hy))"


def _descend(probes: DataFrame, points: DataFrame, keys: list[str], probe: list[str], depth: int, keep):
    """(frontier, level): for every probe the cells ``keep`` could not rule out."""
    frontier = probes.withColumns({"i": F.lit(0).cast("bigint"), "j": F.lit(0).cast("bigint")})
    level = 0
    while True:
        level += STEP
        below = _cells(points, keys, level, depth).withColumnsRenamed({"i": "ci", "j": "cj"})
        parents = frontier.select(*probe, F.col("i").alias("pi"), F.col("j").alias("pj"))
        frontier = cut(keep(parents.join(below, [*keys, "pi", "pj"])).withColumnsRenamed({"ci": "i", "cj": "j"}))
        widest = frontier.agg(F.max("points")).first()[0]
        if widest is None or widest <= LEAF_POINTS or level >= depth:
            return frontier, level


def _leaves(frontier: DataFrame, points: DataFrame, keys: list[str], probe: list[str], level: int, depth: int) -> DataFrame:
    shift = depth - level
    at = points.withColumns({"i": F.shiftright("i", shift), "j": F.shiftright("j", shift)})
    return frontier.select(*probe, "i", "j").join(at, [*keys, "i", "j"])


def nearest(probes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy, d, payload): distance to the nearest point; ties take the lowest payload."""
    payload = F.min("payload") if "payload" in points.columns else F.min(F.lit(None).cast("int"))
    unique = points.select(*keys, F.col("cx").alias("px"), F.col("cy").alias("py"),
                           *(["payload"] if "payload" in points.columns else [])
                           ).groupBy(*keys, "px", "py").agg(payload.alias("payload"))
    gridded, depth = _gridded(unique, keys)
    probe = [*keys, "cx", "cy"]
    mine = Window.partitionBy(*probe)        # a handful of cells per probe

    def keep(pairs: DataFrame) -> DataFrame:
        bounded = pairs.withColumns({
            "low": F.expr(f"sqrt({NEAR_X} * {NEAR_X} + {NEAR_Y} * {NEAR_Y})"),
            "high": F.expr(f"sqrt({FAR_X} * {FAR_X} + {FAR_Y} * {FAR_Y})")})
        best = bounded.withColumn("best", F.min("high").over(mine))
        return best.where("low <= best * (1 + 1e-9)").drop("low", "high", "best")

    frontier, level = _descend(probes.distinct(), gridded, keys, probe, depth, keep)
    pairs = _leaves(frontier, gridded, keys, probe, level, depth)
    gap = F.struct(F.expr("sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py))").alias("d"), "payload")
    return pairs.groupBy(*probe).agg(F.min(gap).alias("g")).select(*probe, "g.d", "g.payload")


def label_on_line(probes: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy, h, label_near): probes with a label on their line within three heights."""
    probe = [*keys, "cx", "cy", "h"]
    wanted = probes.select(*probe).distinct()
    unique = labels.select(*keys, F.col("cx").alias("px"), F.col("cy").alias("py")).distinct()
    gridded, depth = _gridded(unique, keys)
    limit = f"{C.NEAR_HEIGHTS} * h"
    mine = Window.partitionBy(*probe)

    def keep(pairs: DataFrame) -> DataFrame:
        near = f"{NEAR_Y} <= h and sqrt({NEAR_X} * {NEAR_X} + {NEAR_Y} * {NEAR_Y}) <= {limit}"
        inside = f"{FAR_Y} <= h and sqrt({FAR_X} * {FAR_X} + {FAR_Y} * {FAR_Y}) <= {limit}"
        reached = pairs.where(near).withColumn("inside", F.expr(inside))
        # one cell fully inside settles a probe; it then needs no other cell
        settled = reached.withColumn("any_inside", F.max("inside").over(mine))
        return settled.where("inside or not any_inside").withColumn(
            "points", F.when(F.col("any_inside"), F.lit(1)).otherwise(F.col("points"))).drop("inside", "any_inside")

    frontier, level = _descend(wanted, gridded, keys, probe, depth, keep)
    pairs = _leaves(frontier, gridded, keys, probe, level, depth)
    hit = pairs.where(f"abs(cy - py) <= h and sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) <= {limit}")
    return hit.select(*probe).distinct().withColumn("label_near", F.lit(True))


def day_to_the_right(probes: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """The only lone day box just right of a date box, by a grid at the scale of the box."""
    probe = [*keys, "x0", "x1", "cy", "h", "confidence"]
    cell = "pow(2D, scale + 1)"
    wanted = (probes.select(*probe).distinct().where("h > 0 and x1 - x0 > h")
              .withColumn("scale", F.expr("int(floor(log2(h)))"))
              .withColumn("gx", F.expr(f"explode(array_distinct(array(floor(x1 / {cell}), floor((x1 + h) / {cell}))))"))
              .withColumn("gy", F.expr(f"explode(array_distinct(array(floor((cy - 0.4 * h) / {cell}), "
                                       f"floor((cy + 0.4 * h) / {cell}))))")))
    unique = days.where("h > 0").groupBy(*keys, F.col("x0").alias("dx"), F.col("cy").alias("dy"), F.col("h").alias("dh"),
                                         F.col("confidence").alias("dc"), "lone_day").agg(F.count("*").alias("n"))
    placed = (unique.withColumn("scale", F.expr("explode(sequence(int(floor(log2(dh))) - 1, int(floor(log2(dh))) + 1))"))
              .withColumns({"gx": F.expr(f"floor(dx / {cell})"), "gy": F.expr(f"floor(dy / {cell})")}))
    pairs = wanted.join(placed, [*keys, "scale", "gx", "gy"]).where(
        "dc >= confidence and dx - x1 between 0 and h and dh between 0.5 * h and 1.5 * h and abs(dy - cy) <= 0.4 * h")
    return pairs.groupBy(*probe).agg(F.sum("n").alias("n"), F.max("lone_day").alias("day")).select(
        *probe, F.when(F.col("n") == 1, F.col("day")).alias("day_right"))
