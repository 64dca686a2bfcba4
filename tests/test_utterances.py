"""Partial and final transcripts that come out of order, late or never."""

import datetime as dt

import pytest

from ledgerlens.streaming import sessions as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 5, 1, 12)


def test_out_of_order_files(spark, tmp_path):
    schema = "conv_id long, utterance long, ts timestamp, seq long, text string, final boolean"
    batches = [
        [(1, 1, 0, 1, "where is", False), (1, 1, 0, 0, "where", False), (1, 2, 1, 1, "my card", False), (2, 1, 1, 0, "hel", False)],
        [(1, 1, 2, 2, "where is it", True), (1, 2, 2, 0, "my", False), (2, 1, 2, 1, "hello", True), (2, 1, 2, 1, "hello", True)],
        [(1, 1, 3, 1, "where is", False), (3, 1, 3, 0, "gone", False)],
        [(9, 9, 300, 0, "later", False)],
    ]
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame([(c, u, START + dt.timedelta(minutes=m), s, t, f) for c, u, m, s, t, f in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/batch={i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = S.utterances(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER)
    got = sorted(tuple(r) for r in spark.read.schema("conv_id long, utterance long, text string, rows long, closed_by string").parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1, "where is it", 3, "final"), (1, 2, "my card", 2, "timeout"), (2, 1, "hello", 2, "final"), (3, 1, "gone", 1, "timeout")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == pytest.approx(1, abs=1)  # the last utterance alone
