"""Session defaults for running the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "shelfdate", *, master: str | None = None,
                  shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; a cluster's own settings are kept."""
    builder = (SparkSession.builder.appName(name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
