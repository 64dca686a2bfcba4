"""Replay from a snapshot equals the live run, wherever it is cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import sessions as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 5, 1, 12)
EVENTS = "user_id long, event_id long, ts timestamp, event_type string, turn int"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def trace(spark, folder):
    r, rows = random.Random(9), []
    for user in (1, 2, None):
        for turn in range(1, 15):
            rows.append((user, 100 * (user or 0) + turn, START + dt.timedelta(minutes=turn // 2), r.choice(["purchase", "click", "error", "view", "signup"]), turn))
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/trace")
    return spark.read.schema(EVENTS).parquet(f"{folder}/trace")


def changes(spark, folder, name, cut, start=None):
    stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/trace").where(cut)
    return S.run_to_table(S.state_machine(stream, start=start), f"{folder}/{name}/out", f"{folder}/{name}/checkpoint")


def test_replay_from_any_event(spark, tmp_path, rocksdb):
    folder = str(tmp_path)
    stored = trace(spark, folder)
    live = changes(spark, folder, "live", F.lit(True))
    assert live.where("action is not null").count() > 3
    for cut in (0, 1, 3, 4, 6, 9, 13, 14):
        before = F.col("turn") <= cut
        start = S.snapshot(stored, live, before)
        assert start.count() == (3 if cut else 0)
        replayed = changes(spark, folder, f"cut-{cut}", ~before, start)
        later = live.join(stored.where(~before).select("event_id"), "event_id", "left_semi")
        got = S.compared(replayed, later.select(*replayed.columns)).collect()
        assert len(got) == later.count() and all(r.in_replay and r.in_record for r in got), cut


def test_a_change_that_differs_is_seen_on_both_sides(spark):
    one = spark.createDataFrame([(1, 5, "READY", "LISTENING", None)], S.CHANGES)
    other = spark.createDataFrame([(1, 5, "READY", "PROCESSING", None), (None, 6, None, "LISTENING", "expired")], S.CHANGES)
    got = {(r.user_id, r.to_state): (r.in_replay, r.in_record) for r in S.compared(one, other).collect()}
    assert got == {(1, "LISTENING"): (True, False), (1, "PROCESSING"): (False, True), (None, "LISTENING"): (False, True)}
    assert S.compared(one, one.limit(0)).collect()[0].in_record is False
