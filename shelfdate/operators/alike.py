"""Images that are alike, parsed once.

What the parser and the cascade make of an image depends on its boxes only, not on its id. Where images repeat (copies, a
handful of layouts) one image of each kind is parsed and its result joined to all images of that kind; the rows are those of
parsing every image. Where hardly any image repeats, this costs an exchange and saves nothing, so the caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial
from .groups import MAX_GROUP_BOXES, crowded_images

#: Kinds of images whose results are broadcast; the results of more are joined by exchange.
MAX_SHARED_KINDS = 120_000

# A box alone in its (image, stage) has no neighbour: every distance is 0 or infinite wherever it lies and no order counts.
ANYWHERE = "size({0}.bbox) > 0 and forall({0}.bbox, p -> size(p) >= 2 and forall(p, v -> coalesce(abs(v) <= 1e15, false)))"


def _alone(box: str, index: str) -> str:
    """SQL: ``box``, alone in its stage, without its place."""
    return f"""'box_index', if({box}.box_index is null, null, cast(0 as {index})), 'text', {box}.text, 'confidence', {box}.confidence,
        'bbox', array(array(0D, 0D))"""


def kinds_of_images(boxes: DataFrame) -> DataFrame:
    """(image_id, kind): images with equal boxes in all stages are of one kind (SHA-256)."""
    box = F.struct("box_index", "text", "confidence", "bbox")
    by_stage = boxes.repartition("image_id").groupBy("image_id", "stage").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    index = boxes.schema["box_index"].dataType.simpleString()
    by_stage = by_stage.withColumn("boxes", F.expr(
        f"if(size(boxes) = 1 and {ANYWHERE.format('boxes[0]')}, array(named_struct({_alone('boxes[0]', index)})), boxes)"))
    stages = F.sort_array(F.collect_list(F.struct("stage", "boxes")))
    return by_stage.groupBy("image_id").agg(F.unhex(F.sha2(F.to_json(stages), 256)).alias("kind"))


def with_kinds(images: DataFrame) -> DataFrame:
    """``images``, a row each with the boxes of all its stages as array ``boxes`` (stage, box_index, text, confidence, bbox), with
    its ``kind`` as :func:`kinds_of_images` tells kinds apart, and ``boxes`` in the form that all of a kind share. Nothing moves."""
    index = images.schema["boxes"].dataType.elementType["box_index"].dataType.simpleString()
    ordered = """sort_array(transform(boxes, b -> named_struct('stage', b.stage, 'box_index', b.box_index, 'text', b.text,
        'confidence', b.confidence, 'bbox', b.bbox)))"""
    other = "({0} or not get(boxes, {1}).stage <=> b.stage)"
    lone = f"{other.format('i = 0', 'i - 1')} and {other.format('i = size(boxes) - 1', 'i + 1')} and {ANYWHERE.format('b')}"
    shared = f"transform(boxes, (b, i) -> if({lone}, named_struct('stage', b.stage, {_alone('b', index)}), b))"
    rows = images.withColumn("boxes", F.expr(ordered)).withColumn("boxes", F.expr(shared))
    # never null: a filter on nulls before a join would be worked out from the boxes as they come, in every place that names them
    return rows.withColumn("kind", F.coalesce(F.unhex(F.sha2(F.to_json("boxes"), 256)), F.lit(b"")))


def counted_kinds(images: DataFrame, *labels: str) -> DataFrame:
    """(kind, key, boxes, labels, n): how many images with the same boxes and labels there are, kept; a row of ``images`` holds the boxes
    of all its stages as array ``boxes``, in any order, but one order is one row here. Only different rows are exchanged, no row
    per image; kinds are told from them. ``key`` is a hash of the boxes as they come, for :func:`tell`."""
    counted = images.groupBy("boxes", *labels).agg(F.count("*").alias("n"))
    return spatial.cut(with_kinds(counted.withColumn("key", F.xxhash64("boxes"))))


def parsed_kinds(counted: DataFrame, run, **options) -> DataFrame:
    """(kind, ...): what ``run(boxes, **options)`` makes of one image of each of the :func:`counted_kinds`."""
    each = spatial.cut(counted.select(F.col("kind").alias("image_id"), "boxes").dropDuplicates(["image_id"]))
    return run(each.select("image_id", F.inline("boxes")), **options).withColumnRenamed("image_id", "kind")


def tell(images: DataFrame, counted: DataFrame, told: DataFrame) -> DataFrame:
    """Images with what is told of their kind (``told``: kind, ...), a row for each told; where that is little it goes to the images,
    not they to it. An image knows its kind by the key of its boxes, as ``counted`` shows that no key is of two kinds;
    otherwise it works out its kind."""
    keys = counted.select("key", "kind").distinct()
    if keys.groupBy("key").count().where("count > 1").isEmpty():
        by, images, told = "key", images.withColumn("key", F.xxhash64("boxes")), keys.join(told, "kind").drop("kind")
    else:
        by, images = "kind", with_kinds(images)
    told = spatial.cut(told)
    return images.drop("boxes").join(F.broadcast(told) if told.count() <= MAX_SHARED_KINDS else told, by).drop(by)


def once_per_kind(boxes: DataFrame, run, *, crowded: DataFrame | bool | None = None, max_group_boxes: int = MAX_GROUP_BOXES, **options) -> DataFrame:
    """``run(boxes, crowded=..., **options)``, rows with ``image_id``, on one image of each kind, told to all of that kind.
    Crowded images (as for the parser) are no rows to hold together: they run as they are."""
    if crowded is None:
        crowded = crowded_images(boxes, max_group_boxes)
        if crowded.isEmpty():
            crowded = False
    ids = None if crowded is False else crowded.select("image_id").distinct()
    plain = boxes if ids is None else boxes.join(ids, "image_id", "left_anti")
    images = spatial.cut(kinds_of_images(plain))
    shown = spatial.cut(images.groupBy("kind").agg(F.min("image_id").alias("shown")))
    few = shown.count() <= MAX_SHARED_KINDS

    def bounded(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    each = spatial.cut(plain.join(bounded(shown), F.col("image_id").eqNullSafe(F.col("shown")), "left_semi"))
    told = run(each, crowded=False, **options)
    named = shown.join(told, F.col("image_id").eqNullSafe(F.col("shown"))).drop("image_id", "shown")
    out = images.join(bounded(named), "kind").select(*told.columns)
    return out if ids is None else out.unionByName(run(boxes.join(ids, "image_id", "left_semi"), crowded=crowded, **options))
