"""Pending confirmations: late and repeated answers, interruptions, expiry, and what state is left."""

import datetime as dt

import pytest

from ledgerlens.streaming import sessions as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 5, 1, 12)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def run(spark, folder, batches, **limits):
    """Each batch (user, event, minute, role, resource) is a file and a micro-batch of its own."""
    schema = "user_id long, event_id long, ts timestamp, role string, resource long"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(u, e, START + dt.timedelta(minutes=m), role, x) for u, e, m, role, x in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/batch={i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = S.pending_confirmations(files, **limits).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.schema("user_id long, request_id long, event_id long, outcome string").parquet(f"{folder}/out").collect()]
    return sorted(got, key=repr), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_how_requests_end(spark, tmp_path, rocksdb):
    batches = [
        [(1, 1, 0, "request", 5), (1, 2, 1, "request", 6), (1, 3, 2, "answer", 5), (1, 4, 3, "answer", 5)],  # executed, then a repeated answer
        [(1, 5, 4, "interruption", 0), (1, 6, 5, "answer", 6), (2, 7, 5, "request", 1), (2, 8, 6, "request", 1)],  # cancelled, late answer; superseded
        [(2, 9, 7, "other", 0), (2, 10, 8, "other", 0), (2, 11, 9, "other", 0), (2, 12, 10, "other", 0), (2, 13, 11, "answer", 1)],  # expired by turns
        [(3, 14, 20, "request", 9)],
        [(4, 15, 500, "other", 0)],  # far later: the timer of user 3
    ]
    got, left = run(spark, str(tmp_path), batches)
    want = [(1, 1, 3, "executed"), (1, None, 4, "unmatched"), (1, 2, 5, "cancelled"), (1, None, 6, "unmatched"), (2, 7, 8, "superseded"), (2, 8, None, "expired"), (2, None, 13, "unmatched"), (3, 14, None, "expired")]
    assert got == sorted(want, key=repr)
    assert left == 0


def test_open_requests_wait_in_state(spark, tmp_path, rocksdb):
    got, left = run(spark, str(tmp_path), [[(1, 1, 0, "request", 5), (1, 2, 1, "request", 6)], [(1, 3, 119, "answer", 6)]])
    assert got == [(1, 2, 3, "executed")] and left > 0
