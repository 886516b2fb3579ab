"""Incremental ingest of recognition results with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import stage_results
from ..rules import PRODUCTION, RuleSet
from ..sources.io import STAGE_RECORD, to_boxes

ARRIVAL = STAGE_RECORD + ", arrived timestamp"


def arriving_records(spark: SparkSession, folder: str, *, lateness: str | None,
                     files_per_batch: int = 1000) -> DataFrame:
    """Each (image, stage) once.

    The state of a key is dropped ``lateness`` after its arrival; None has to be said, as it keeps
    every key for ever and so suits finite inputs only.
    """
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).json(folder)
    keys = ["image_id", "stage"]
    if lateness:
        return stream.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def ingest(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the deduplicated records to a parquet table; resumes from its checkpoint."""
    return (records.writeStream.format("parquet").option("path", table)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def parse_arrivals(records: DataFrame, table: str, checkpoint: str, rules: RuleSet = PRODUCTION) -> StreamingQuery:
    """Parse every micro-batch of arriving stages with the batch parser.

    Each batch writes its own folder, so a batch that is run again after a failure replaces
    what its first try left and no stage is counted twice.
    """
    def one_batch(batch: DataFrame, number: int) -> None:
        stage_results(to_boxes(batch), rules).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (records.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stage_counts(records: DataFrame) -> DataFrame:
    """Running number of records per stage, for a sink in update mode."""
    return records.groupBy("stage").agg(F.count("*").alias("n"))
