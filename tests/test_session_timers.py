"""Sessions by timers against their SQL, on users who are busy all day and gaps that are half an hour but for microseconds."""

from datetime import datetime, timedelta

import duckdb

from ledgerlens.plans.catalog import ORACLES, QUERIES
from ledgerlens.streaming.sessions import EVENTS


def test_long_sessions_and_microseconds_are_as_in_sql(spark, tmp_path, same_rows):
    start = datetime(2024, 1, 1)
    half = timedelta(minutes=30)
    times = [(1, start + timedelta(minutes=20 * i)) for i in range(40)]  # 13 hours without a break
    times += [(2, start + timedelta(microseconds=999)), (2, start + half + timedelta(microseconds=998)), (2, start + 2 * half + timedelta(microseconds=1200))]
    times += [(3, start + timedelta(days=3))]
    rows = [(i, ts, u, "view", 1.0, '{"k": 1}') for i, (u, ts) in enumerate(times)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES["st2_session_timers"]).df()
    assert len(want) == 3
    same_rows(QUERIES["st2_session_timers"](spark, str(tmp_path)).toPandas(), want)
