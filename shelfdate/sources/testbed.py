"""Box, stage and label tables derived from the TPC-H-like test tables.

Everything is a projection of the source rows, without a numbering window, so the tables grow with their source and
cost no more than a scan; only rows of a table of few parts are dealt out first, before their texts are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.constants import STAGES

FORMATS = ("yyyy.MM.dd", "yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "ddMMMyyyy", "yyyy년 MM월 dd일")
YEARS_AHEAD = 28          # keeps leap days and lands inside the default year window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key where the scan has fewer parts than there are cores (a small file is one part, however much
    work its rows make); larger tables stay as they are read."""
    parts, cores = df._jdf.rdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    # a number of its own: parts that are small as bytes, but slow to read, would be put together again
    return df.repartition(4 * cores, *keys) if parts < cores else df


def moved(column: str) -> Column:
    return F.add_months(F.col(column).cast("date"), 12 * YEARS_AHEAD)


def rendered(date: Column, choice: Column) -> Column:
    text = F.lit(None).cast("string")
    for i, pattern in reversed(list(enumerate(FORMATS))):
        value = F.date_format(date, pattern)
        text = F.when(choice == i, F.upper(value) if "MMM" in pattern else value).otherwise(text)
    return text


def rectangle(x: Column, y: Column, w: float = 200.0, h: float = 20.0) -> Column:
    x, y = x.cast("double"), y.cast("double")
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return F.array(*[F.array(a, b) for a, b in corners])


def image_key(column: str) -> Column:
    return F.format_string("%06d", F.col(column))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items with ``line``, a key of every row: the id it shows and where the row lies, as several rows may show one id."""
    place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    return table(spark, sf_dir, "lineitem").select("*", F.concat_ws("/", per_line(), place).alias("line"))


def shown_line(key: str = "image_id") -> Column:
    """The id that a line item shows, from the key of its row."""
    return F.substring_index(key, "/", 1)


def lineitem_boxes(spark: SparkSession, sf_dir: str, *, text: Column | None = None,
                   stage: Column | None = None, keep: Column | None = None,
                   image: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One text box per line item; ``truth`` is the date it shows."""
    li = dealt(lines(spark, sf_dir), "l_orderkey", "l_partkey")
    if keep is not None:
        li = li.where(keep)
    li = li.withColumn("truth", moved("l_shipdate"))
    word = F.when(F.col("l_returnflag") == "A", "EXP ").when(F.col("l_returnflag") == "R", "MFG ").otherwise("")
    return li.select(
        (image_key("l_orderkey") if image is None else image).alias("image_id"),
        (F.lit(STAGES[0]) if stage is None else stage).alias("stage"),
        (F.col("l_linenumber") * 1000000000000 + F.col("l_partkey") * 100
         + F.col("l_quantity").cast("bigint")).alias("box_index"),
        (F.concat(word, rendered(F.col("truth"), F.col("l_partkey") % 6)) if text is None else text).alias("text"),
        (1 - 2 * F.col("l_discount")).alias("confidence"),
        rectangle(100 * (F.col("l_partkey") % 5), 40 * F.col("l_linenumber")).alias("bbox"),
        "truth", *[c.alias(n) for n, c in (extra or {}).items()])


def stage_of(column: str = "l_suppkey") -> Column:
    """One of the five stages by key."""
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col(column) % 5 + 1).cast("int"))


DATE_TEXT = "yyyy-MM-dd"


def per_line() -> Column:
    """The id that a line item shows."""
    return F.concat_ws("-", image_key("l_orderkey"), F.col("l_linenumber").cast("string"),
                       F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))


def companion_boxes(spark: SparkSession, sf_dir: str, layout: list[tuple[Column, Column, Column, float, Column]]) -> DataFrame:
    """Several boxes per line item, an image for each; the layout lists (text, x, y, width, confidence)."""
    li = dealt(lines(spark, sf_dir), "l_orderkey", "l_partkey").withColumn("truth", moved("l_shipdate"))
    boxes = F.array(*[F.struct(F.lit(i).cast("bigint").alias("box_index"), t.alias("text"),
                               c.cast("double").alias("confidence"), rectangle(x, y, w).alias("bbox"))
                      for i, (t, x, y, w, c) in enumerate(layout)])
    return li.select(F.col("line").alias("image_id"), F.lit(STAGES[0]).alias("stage"), F.inline(boxes))


def order_boxes(spark: SparkSession, sf_dir: str, texts: list[Column], keep: Column | None = None,
                first_index: int = 0) -> DataFrame:
    """Stacked boxes per order; null texts give no box."""
    orders = dealt(table(spark, sf_dir, "orders"), "o_orderkey")
    if keep is not None:
        orders = orders.where(keep)
    orders = orders.withColumn("truth", moved("o_orderdate"))
    boxes = F.array(*[F.struct(F.lit(i + first_index).cast("bigint").alias("box_index"), t.alias("text"),
                               F.lit(0.95).alias("confidence"), rectangle(F.lit(0), F.lit(40 * i)).alias("bbox"))
                      for i, t in enumerate(texts)])
    return orders.select(image_key("o_orderkey").alias("image_id"), F.lit(STAGES[0]).alias("stage"),
                         F.inline(boxes)).where("text is not null")


def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage results made from line items without the parser: the first line of each
    (order, stage) becomes the outcome of that stage."""
    li = table(spark, sf_dir, "lineitem").withColumn("d", moved("l_shipdate"))
    has = F.col("l_quantity") > 12
    partial = F.col("l_partkey") % 13 == 0
    year, month = F.date_format("d", "yyyy"), F.date_format("d", "MM")
    day = F.when(partial, "NONE").otherwise(F.date_format("d", "dd"))
    many = F.col("l_linenumber") % 3 == 0
    final = F.concat_ws("-", year, month, day)
    earlier = F.date_format(F.date_sub("d", 400), DATE_TEXT)

    def shown(value: Column) -> Column:
        return F.when(has, value).otherwise("NONE")

    outcome = F.struct(
        shown(year).alias("year"), shown(month).alias("month"), shown(day).alias("day"), shown(final).alias("final_date"),
        has.alias("has_candidate"), F.when(has, 1 - 2 * F.col("l_discount")).alias("q"),
        F.when(has, many).alias("many"), F.when(has, F.col("l_partkey") % 7 == 0).alias("short"),
        F.when(has, F.lit(False)).alias("bare"), F.when(has, partial & (F.col("l_partkey") % 2 == 0)).alias("damaged_day"),
        F.when(has, F.col("l_returnflag") == "A").alias("self_anchor"),
        F.when(has, F.col("l_returnflag") == "R").alias("self_exclude"),
        F.when(has, F.when(many, F.array(earlier, final)).otherwise(F.array(final))).alias("candidate_dates"),
        F.when(has, 1).otherwise(0).alias("n_candidates"), F.col("l_tax").alias("seconds"))
    order = F.struct("l_linenumber", "l_partkey", "l_quantity")
    return (li.groupBy(image_key("l_orderkey").alias("image_id"), stage_of().alias("stage"))
            .agg(F.min_by(outcome, order).alias("r")).select("image_id", "stage", "r.*"))


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth per order: the last ship date of its lines, with unknown parts for some orders."""
    li = table(spark, sf_dir, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max(moved("l_shipdate")).alias("d"))
    key = F.col("l_orderkey")
    year = F.when(key % 17 == 0, "NONE").otherwise(F.date_format("d", "yyyy"))
    month = F.when(key % 17 == 0, "NONE").otherwise(F.date_format("d", "MM"))
    day = F.when((key % 17 == 0) | (key % 13 == 0), "NONE").otherwise(F.date_format("d", "dd"))
    final = F.when(key % 17 == 0, "NONE").otherwise(F.concat_ws("-", year, month, day))
    return last.select(image_key("l_orderkey").alias("image_id"), year.alias("year"), month.alias("month"),
                       day.alias("day"), final.alias("final_date"), (key % 3).cast("string").alias("cohort"))


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label sources over the orders; the second is edited here and there."""
    o = table(spark, sf_dir, "orders").withColumn("d", moved("o_orderdate"))
    key = F.col("o_orderkey")
    y, m, d = F.date_format("d", "yyyy"), F.date_format("d", "MM"), F.date_format("d", "dd")
    first = o.select(F.when(key % 43 == 0, F.concat(key.cast("string"), F.lit("a"))).when(key % 4700 != 0, key.cast("string")).alias("image_id"), F.lit("first").alias("source"),
                     F.when(key % 19 == 0, "none").when(key % 23 == 0, F.substring(y, 3, 2)).otherwise(y).alias("year"),
                     F.when(key % 29 == 0, F.date_format("d", "M")).otherwise(m).alias("month"),
                     F.when(key % 31 == 0, "xx").when(key % 37 == 0, "45").otherwise(d).alias("day"),
                     F.when(key % 41 == 0, "NONE").otherwise(F.concat_ws("-", y, m, d)).alias("final_date"))
    swap = (key % 11 == 0) & (F.dayofmonth("d") <= 12)
    second = o.where(key % 5 != 0).select(
        F.lpad(key.cast("string"), 7, "0").alias("image_id"), F.lit("second").alias("source"), y.alias("year"),
        F.when(swap, d).otherwise(m).alias("month"), F.when(swap, m).otherwise(d).alias("day"),
        F.when(swap, F.concat_ws("-", y, d, m)).otherwise(F.concat_ws("-", y, m, d)).alias("final_date"))
    return first.unionByName(second)
