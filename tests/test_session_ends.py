"""Sessions near the end of a stream against their SQL: ended by a late event, by a microsecond, and over several batches."""

from datetime import datetime, timedelta

import duckdb

from ledgerlens.plans.catalog import ORACLES, QUERIES
from ledgerlens.plans.stream_queries import PROVIDER
from ledgerlens.streaming import sessions as S

END = datetime(2024, 1, 3, 12)


def ago(minutes, us=0):
    return END - timedelta(minutes=minutes) + timedelta(microseconds=us)


def write(spark, path, times):
    spark.createDataFrame([(i, ts, u, "view", 1.0, '{"k": 1}') for i, (u, ts) in enumerate(times)], S.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_a_session_leaves_only_once_the_watermark_has_passed_it(spark, tmp_path, same_rows):
    times = [(9, END + timedelta(microseconds=500)), (1, ago(36)), (1, ago(1)), (2, ago(40, 500)), (3, ago(40, 501)), (4, ago(40, 499)), (5, ago(200)), (5, ago(100)), (5, ago(90)), (5, ago(2))]
    write(spark, tmp_path, times)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES["st2_session_timers"]).df()
    assert sorted(want.user_id) == [2, 4, 5, 5]
    same_rows(QUERIES["st2_session_timers"](spark, str(tmp_path)).toPandas(), want)


def test_events_of_later_batches_join_sessions_that_are_kept(spark, tmp_path):
    for i, minutes in enumerate(([100, 45, 41], [60, 50, 38], [-10])):
        write(spark, tmp_path / str(i), [(1, ago(m)) for m in minutes])
    stream = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*/events.parquet")
    stream = stream.selectExpr("user_id", "cast(ts as timestamp) as ts")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = S.run_to_table(S.timed_sessions(stream, most_minutes=None), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    end = int((END - datetime(1970, 1, 1)).total_seconds()) * 1000
    assert sorted(((end - r.start_ms) // 60_000, (end - r.end_ms) // 60_000, r.n_events) for r in got) == [(60, 38, 5), (100, 100, 1)]
