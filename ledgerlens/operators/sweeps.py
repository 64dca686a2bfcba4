"""Running totals and open intervals along time, for any number of rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import new_folder


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows of equal keys up to each row; rows that tie in order count
    together, null amounts count nothing (a total of nulls alone is 0).

    Rows are cut by ranges of (keys, order), so that a key with very many rows, or no key at all, takes
    many tasks. Totals run inside each range; what lies before it is carried over from the ranges' sums,
    one row a key and range."""
    cut = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    path = new_folder(df.sparkSession, "sweep")
    cut.write.parquet(path)
    cut = df.sparkSession.read.schema(cut.schema).parquet(path)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    carried = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    both = cut.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(carried, same)
    return both.select(*df.columns, (F.col("_inside") + F.col("_carried")).alias(name))


def concurrency(spans: DataFrame) -> DataFrame:
    """Most spans (start_ts, end_ts) open at once, per hour (hour, most_open); a span counts in every
    hour it touches. In an hour: a sweep over +1 and -1. A span that ends when another starts is closed
    first. Steps are added up per moment before they are sorted."""
    hours = F.sequence(F.date_trunc("hour", F.col("start_ts").cast("timestamp")), F.date_trunc("hour", F.col("end_ts").cast("timestamp")), F.expr("INTERVAL 1 HOUR"))
    cut = spans.select("start_ts", "end_ts", F.explode(hours).alias("hour")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    step = lambda at, n: cut.select("hour", F.col(at).alias("at"), F.lit(n).alias("step"))
    steps = step("start_ts", 1).unionByName(step("end_ts", -1)).groupBy("hour", "at").agg(F.sum("step").alias("step"))
    return running_total(steps, ["hour"], ["at"], F.col("step"), "open").groupBy("hour").agg(F.max("open").cast("long").alias("most_open"))


def open_at(spans: DataFrame, points: DataFrame) -> DataFrame:
    """points (id, at) with how many spans (start_ts, end_ts; both ends included) are open at that moment.
    One sweep over all bounds and points together; points without a moment, and spans without a bound, drop out."""
    bound = lambda at, kind, n: spans.where("start_ts is not null and end_ts is not null").groupBy(F.col(at).alias("at")).agg((F.count("*") * n).alias("step")).select(F.lit(None).cast(points.schema["id"].dataType).alias("id"), "at", F.lit(kind).alias("kind"), "step")
    asked = points.where("at is not null").select("id", "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("step"))
    steps = bound("start_ts", 0, 1).unionByName(asked).unionByName(bound("end_ts", 2, -1))
    return running_total(steps, [], ["at", "kind"], F.col("step"), "open").where("kind = 1").select("id", "at", "open")
