"""Sinks with a commit per micro-batch: an append-only trail, and windows with their late rows beside them.

A micro-batch that is run again, after a failure between its write and its commit, overwrites its own
folder; one that was committed is skipped. Readers look at committed batches only, so a row is there once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"
_COMMIT = f"{BATCH} long"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COMMIT).parquet(f"{path}/commits")


def _start(spark: SparkSession, path: str) -> None:
    """The table of commits, empty if it isn't there."""
    spark.createDataFrame([], _COMMIT).write.mode("append").parquet(f"{path}/commits")


def append_once(stream: DataFrame, path: str, checkpoint: str, before_commit: Callable[[int], None] = lambda number: None) -> None:
    """Run a stream to its end and append its rows to a trail in path. before_commit is called between a
    batch's write and its commit."""
    spark = stream.sparkSession
    _start(spark, path)

    def put(batch: DataFrame, number: int) -> None:
        if not _commits(spark, path).where(F.col(BATCH) == number).isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={number}")
        before_commit(number)
        spark.createDataFrame([(number,)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of committed batches. Commits are one row a batch."""
    rows = spark.read.schema(f"{schema}, {_COMMIT}").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(F.broadcast(_commits(spark, path).distinct()), BATCH, "left_semi").drop(BATCH)


def windows_with_late_rows(stream: DataFrame, path: str, checkpoint: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> None:
    """Run a stream (ts, key and further columns) to its end: counts of rows per window and key go to
    path/windows, one partial count a batch; rows whose window the watermark had passed when they came go
    whole to path/late. The watermark of a batch is the latest time of all batches before it less delay.
    Spark's own windowed counts look a batch further back, so they drop none but these rows. All rows with
    a time are in one of the two."""
    spark = stream.sparkSession
    spark.createDataFrame([], "number long, most timestamp").write.mode("append").parquet(f"{path}/times")

    def put(batch: DataFrame, number: int) -> None:
        times = spark.read.schema("number long, most timestamp").parquet(f"{path}/times")
        seen = times.where(F.col("number") < number).agg(F.max("most").alias("most"))
        w = F.window("ts", width)
        dated = batch.where("ts is not null").withColumn("start_ts", w["start"]).withColumn("_end", w["end"]).join(F.broadcast(seen))
        late = F.coalesce(F.col("_end") <= F.col("most") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        dated = dated.withColumn("_late", late).persist()
        try:
            dated.where("_late").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/late/{BATCH}={number}")
            dated.where("not _late").groupBy("start_ts", key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/windows/{BATCH}={number}")
            dated.agg(F.lit(number).cast("long").alias("number"), F.max("ts").alias("most")).where("most is not null").write.mode("append").parquet(f"{path}/times")
        finally:
            dated.unpersist()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """start_ts, key and n of the rows that came in time."""
    return spark.read.schema(f"start_ts timestamp, {key} {kind}, n long").parquet(f"{path}/windows").groupBy("start_ts", key).agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/late")
