"""Streaming sinks: a trail without repeats after a failure, and late rows kept beside the windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import sessions as S
from ledgerlens.streaming import sinks as K


def test_a_batch_that_dies_before_its_commit_is_there_once(spark, tmp_path):
    folder, died = str(tmp_path), []
    for i in range(3):
        spark.createDataFrame([(10 * i + j,) for j in range(5)], "id long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def kill(number):
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        K.append_once(stream(), f"{folder}/trail", f"{folder}/checkpoint", kill)
    ids = lambda: sorted(r.id for r in K.read_once(spark, f"{folder}/trail", "id long").collect())
    assert len(spark.read.parquet(f"{folder}/trail/rows").collect()) == 10 and len(ids()) == 5  # written, not committed
    K.append_once(stream(), f"{folder}/trail", f"{folder}/checkpoint", kill)
    assert ids() == sorted(10 * i + j for i in range(3) for j in range(5))
    K.append_once(stream(), f"{folder}/trail", f"{folder}/other-checkpoint", kill)  # batches with committed numbers are skipped
    assert len(ids()) == 15


def test_late_rows_are_kept_and_counts_add_up(spark, tmp_path):
    folder, start = str(tmp_path), dt.datetime(2024, 5, 1, 12)
    batches = [[0, 5, 59], [130, 10], [20, 61, 119, 121, 140], [30, 400], [None, 250, 399]]
    for i, minutes in enumerate(batches):
        rows = [(100 * i + j, None if m is None else start + dt.timedelta(minutes=m), "x" if j % 2 else "y") for j, m in enumerate(minutes)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{folder}/in/batch={i}")
    schema = "event_id long, ts timestamp, event_type string, value double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    K.windows_with_late_rows(stream(), f"{folder}/out", f"{folder}/checkpoint", "event_type")
    late = sorted(r.event_id for r in K.late_rows(spark, f"{folder}/out", schema).collect())
    counted = K.window_counts(spark, f"{folder}/out", "event_type", "string").agg(F.sum("n")).first()[0]
    assert late == [200, 201, 202, 300, 401] and counted + len(late) == sum(m is not None for b in batches for m in b)
    q = S.tumbling_counts(stream()).writeStream.format("memory").queryName("late_test").outputMode("append").option("checkpointLocation", f"{folder}/own").trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < dropped <= len(late)
