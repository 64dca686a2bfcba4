"""Scenario, stage, limit and store operators on small golden rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlens.operators import decisions as D
from ledgerlens.operators import lookups as L
from ledgerlens.operators import providers as P
from ledgerlens.operators import scenarios as S
from ledgerlens.operators import stages as V
from ledgerlens.operators import sweeps as W
from ledgerlens.sources import stores

SCENARIO = "customer_id long, category string, expected array<string>, prohibited array<string>, asked array<string>, executed array<string>"


def test_expected_against_done(spark):
    rows = [
        (1, "a", ["x", "y"], ["z"], ["x", "y"], ["x", "y"]),
        (2, "a", ["x", "y"], ["z"], ["x", "z", "y"], ["x", "y", "z"]),
        (3, "b", ["x"], ["z"], ["y"], []),
    ]
    s = spark.createDataFrame(rows, SCENARIO)
    assert {r.category: (r.rate, r.n) for r in S.success(s).collect()} == {"a": (0.5, 2), "b": (0.0, 1), None: (round(1 / 3, 6), 3)}
    assert {r.category: (r.selected, r.exact) for r in S.tool_selection(s).collect()} == {"a": (1.0, 0.5), "b": (0.0, 0.0)}
    assert [(r.customer_id, r.tools) for r in S.violations(s).collect()] == [(2, "z")]
    calls = spark.createDataFrame([(1, "x", 5, 2, 1), (1, "x", 6, 1, 0), (2, "x", None, 1, 2), (2, "y", 4, 1, 3)], "customer_id long, tool string, resource long, ts long, call_id long")
    got = {(r.category, r.tool): (r.rate, r.n) for r in S.argument_accuracy(s, calls, F.when(F.col("customer_id") == 1, 6)).collect()}
    assert got == {("a", "x"): (1.0, 2), ("a", "y"): (0.0, 1)}
    runs = spark.createDataFrame([("t", "big", 0.9, 5.0), ("t", "small", 0.7, 1.0), ("t", "tiny", 0.2, 0.1), ("u", "tiny", 0.2, 0.1)], "task string, model string, success double, cost double")
    assert {r.task: (r.model, r.cost) for r in S.cheapest(runs, ["task"], 0.6).collect()} == {"t": ("small", 1.0), "u": (None, None)}


def test_an_answer_closes_its_request(spark):
    rows = [(1, 0, "ask"), (1, 1, "yes"), (1, 2, "yes"), (1, 3, "other"), (1, 4, "ask"), (1, 5, "ask"), (1, 6, "other"), (1, 7, "yes"), (2, 8, "yes")]
    e = spark.createDataFrame([(c, datetime(2024, 1, 1) + timedelta(seconds=i), i, k) for c, i, k in rows], "customer_id long, ts timestamp, call_id long, kind string")
    got = {r.call_id: (r.request_id, r.turns_since) for r in D.match_confirmations(e, "customer_id", F.col("kind") == "ask", F.col("kind") == "yes").collect()}
    assert got == {1: (0, 1), 2: (None, None), 7: (5, 2), 8: (None, None)}


def test_sessions_count_in_every_hour_they_touch(spark):
    at = lambda h, m: datetime(2024, 1, 1, 0, 0) + timedelta(hours=h, minutes=m)
    spans = spark.createDataFrame([(at(22, 50), at(25, 10)), (at(24, 5), at(24, 20)), (at(24, 20), at(24, 30)), (at(23, 0), at(23, 0))], "start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert {r.hour.hour: r.most_open for r in W.concurrency(spans).collect()} == {22: 1, 23: 1, 0: 2, 1: 1}


def test_cases_and_disputes_are_opened_once(spark):
    sessions = spark.createDataFrame([(1, 1, 4, 0, "fraud"), (1, 2, 4, 0, None), (2, 1, 3, 0, "fraud")], "user_id long, session_no long, n_events long, end_ts long, reason string")
    existing = spark.createDataFrame([("CASE-2-1",)], "case_id string")
    assert [(r.case_id, r.category, r.priority, r.status) for r in D.escalate(sessions, {"fraud": ("money", "high")}, existing).collect()] == [("CASE-1-1", "money", "high", "OPEN")]
    t = spark.createDataFrame([(1, 7, "a", 1), (1, 7, "b", 2), (2, 7, "a", 1)], "transaction_id long, customer_id long, reason_code string, ts long")
    got = L.open_disputes(t, spark.createDataFrame([(2,)], "transaction_id long")).collect()
    assert [(r.dispute_id, r.reason_code) for r in got] == [("DSP-1", "a")]
    over = D.over_limits(spark.createDataFrame([(1, 5.0, 1), (2, 1.0, 9), (3, 9.0, 9), (4, None, 1)], "i long, a double, b long"), {"b": 3, "a": 2})
    assert {r.i: r.exceeded for r in over.collect()} == {1: "a", 2: "b", 3: "b,a"}


def test_stage_latencies_and_gaps(spark):
    rows = [
        (1, "USER_SPEECH_ENDED", 0, "m"), (1, "STT_STARTED", 1, "m"), (1, "STT_COMPLETED", 100, "m"), (1, "LLM_REQUESTED", 150, "m"), (1, "LLM_FIRST_TOKEN", 400, "m"), (1, "TOOL_STARTED", 200, "m"), (1, "TOOL_FAILED", 260, "m"),
        (1, "RESPONSE_READY", 500, "m"), (1, "TTS_STARTED", 510, "m"), (1, "TTS_FIRST_AUDIO", 600, "m"), (2, "STT_STARTED", 0, None), (2, "LLM_REQUESTED", 5, "m"),
    ]
    s = spark.createDataFrame(rows, "turn_id long, stage string, at_ms long, model string")
    got = {r.turn_id: [r[n] for n in V.LATENCIES] for r in V.stage_latencies(s, ["turn_id"]).collect()}
    assert got == {1: [100, 50, 250, 60, 10, 90, 600], 2: [None] * 7}
    assert [(r.turn_id, r.unfinished, r.missing_metadata) for r in V.gaps(s, ["turn_id"], ["model"]).collect()] == [(2, "LLM_REQUESTED,STT_STARTED", "model")]
    for exact in (True, False):
        p = {r.latency: (r.p50, r.n) for r in V.latency_percentiles(V.stage_latencies(s, ["turn_id"]), [], exact).collect()}
        assert p["tool_ms"] == (60.0, 1) and len(p) == 7


def test_session_clock_ends_long_sessions(spark, tmp_path):
    """Inactivity and maximum duration, against a plain loop; open sessions are ended by their timers."""
    from ledgerlens.plans.stream_queries import PROVIDER
    from ledgerlens.streaming import sessions as X

    minutes = {1: [0, 20, 40, 60, 80, 200], 2: [0, 100, 101], 3: [10_000]}
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=m), u, "view", 1.0, "{}") for i, (u, m) in enumerate((u, m) for u, ms in minutes.items() for m in ms)]
    spark.createDataFrame(rows, X.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = X.run_to_table(X.timed_sessions(X.event_stream(spark, str(tmp_path)), 30, 60), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    base = int(datetime(2024, 1, 1).timestamp() * 1000)
    offset = min(r.start_ms for r in got)
    assert sorted((r.user_id, (r.start_ms - offset) // 60_000, (r.end_ms - offset) // 60_000, r.n_events, r.reason) for r in got) == [
        (1, 0, 40, 3, "duration"), (1, 60, 80, 2, "inactivity"), (1, 200, 200, 1, "inactivity"), (2, 0, 0, 1, "inactivity"), (2, 100, 101, 2, "inactivity"),
    ], base


def test_provider_errors_are_kept(spark):
    class Flaky:
        calls = 0

        def generate(self, prompts):
            Flaky.calls += 1
            if Flaky.calls % 2:
                raise TimeoutError
            return [p.upper() for p in prompts]

    class Down:
        def generate(self, prompts):
            raise ConnectionError

    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, text string").coalesce(1)
    assert sorted(P.answered(df, "text", Flaky).select("i", "answer", "error").collect()) == [(1, "A", None), (2, None, None)]
    assert sorted(P.answered(df, "text", Down).select("i", "answer", "error").collect()) == [(1, None, "ConnectionError"), (2, None, None)]


def test_readiness_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    got = {r.table_name: tuple(r)[1:] for r in stores.readiness({"t": (df, ["a", "b"]), "u": (df, ["a"]), "v": (df, ["a", "z"])}).collect()}
    assert got == {"t": (False, "", 2, 1), "u": (True, "", 2, 0), "v": (False, "z", 2, 0)}


def test_policies_of_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    got = stores.read_policies(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in got] == [("a.txt", "one\ntwo")]
