"""Injected faults, confirmations in a log, open intervals and labelled retrieval against plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlens.operators import decisions as D
from ledgerlens.operators import faults as X
from ledgerlens.operators import metrics as M
from ledgerlens.operators import sweeps as W
from ledgerlens.sources.domain import calls, tools

T0 = datetime(2024, 1, 1)


def test_open_at_equals_counting(spark):
    r = random.Random(5)
    spans = [(T0 + timedelta(minutes=(a := r.randrange(300))), T0 + timedelta(minutes=a + r.randrange(40))) for _ in range(300)]
    points = [(i, T0 + timedelta(minutes=r.randrange(-5, 345))) for i in range(200)]
    s = spark.createDataFrame([*spans, (None, T0), (T0, None)], "start_ts timestamp_ntz, end_ts timestamp_ntz")
    p = spark.createDataFrame([*points, (999, None)], "id long, at timestamp_ntz").repartition(7)
    got = {x.id: x.open for x in W.open_at(s, p).collect()}
    assert got == {i: sum(a <= at <= b for a, b in spans) for i, at in points}
    assert W.open_at(s.limit(0), p.limit(0)).isEmpty()
    assert {x.open for x in W.open_at(s.limit(0), p).collect()} == {0}


def test_running_total_of_a_hot_key(spark):
    r = random.Random(6)
    rows = [(r.choice([None, "hot", "hot", "hot", "b"]), r.randrange(400), r.choice([None, 1, 2, -3])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key string, at long, n long")
    got = W.running_total(df, ["key"], ["at"], F.col("n"), "total").select("key", "at", "n", "total").collect()
    want = [(k, at, n, sum(m or 0 for j, b, m in rows if j == k and b <= at)) for k, at, n in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def fault_rows(spark, *rows):
    """call_id, fault, fails, confirmed, answered, reply_confirms"""
    by = {name: (error, ends) for name, error, ends in X.FAULTS}
    c = [(i, "freeze_card", 1, 1, True, confirmed, True, fault, *by[fault], fails) for i, fault, fails, confirmed, _, _ in rows]
    faulty = spark.createDataFrame(c, "call_id long, tool string, customer_id long, resource_owner long, authenticated boolean, confirmed boolean, arguments_valid boolean, fault string, error string, ends string, fails int")
    replies = spark.createDataFrame([(i, yes) for i, _, _, _, answered, yes in rows if answered], "call_id long, reply_confirms boolean")
    return faulty, replies


def test_attempts_by_fault(spark):
    faulty, replies = fault_rows(
        spark,
        (1, "tool_500", 1, True, False, None),
        (2, "llm_timeout", 3, True, False, None),
        (3, "duplicate_tool_request", 1, True, False, None),
        (4, "stale_confirmation", 1, True, True, True),
        (5, "stale_confirmation", 1, True, True, False),
        (6, "stale_confirmation", 1, True, False, None),
        (7, "invalid_transaction_id", 1, True, True, None),
        (8, "retrieval_empty", 1, True, False, None),
    )
    log = X.attempts(faulty, replies, tools(spark))
    got = {}
    for r in log.orderBy("call_id", "attempt").collect():
        got.setdefault(r.call_id, []).append((r.outcome, r.action))
    assert got == {
        1: [("failed", "retry"), ("executed", None)],
        2: [("failed", "retry"), ("failed", "retry"), ("failed", "escalate")],
        3: [("executed", None), ("replayed", None)],
        4: [("confirm", "ask_user"), ("executed", None)],
        5: [("confirm", "ask_user"), ("confirm", None)],
        6: [("confirm", "ask_user")],
        7: [("denied", "ask_user"), ("executed", None)],
        8: [("failed", "clarify")],
    }
    plain = faulty.select("call_id", F.lit("executed").alias("outcome"))
    found = {r.fault: (r.n, r.recovered, r.attempts, r.escalated, r.effects, r.doubled) for r in X.recovery(log, plain).collect()}
    assert found["duplicate_tool_request"] == (1, 1.0, 2, 0, 1, 0)
    assert found["llm_timeout"] == (1, 0.0, 3, 1, 0, 0)
    assert found["stale_confirmation"] == (3, 0.333333, 5, 0, 1, 0)


def test_faults_are_drawn_again_alike(spark, data):
    c, t = calls(spark, data), tools(spark)
    one, two = (X.inject(x, t).select("call_id", "fault", "fails") for x in (c, c.repartition(5)))
    assert one.exceptAll(two).isEmpty() and {r.fault for r in one.collect()} == {name for name, _, _ in X.FAULTS}
    asks = X.inject(c, t).where("fault = 'stale_confirmation'").join(t, "tool", "left")
    assert asks.where("not coalesce(requires_confirmation and confirmed, false)").isEmpty()
    assert X.attempts(X.inject(c.limit(0), t), spark.createDataFrame([], "call_id long, reply_confirms boolean"), t).isEmpty()


def test_confirmation_chain(spark):
    steps = {
        "a": [("request", None, 0), ("answer", True, 1), ("execution", None, 2), ("execution", None, 3)],
        "b": [("request", None, 0), ("execution", None, 1)],
        "c": [("request", None, 0), ("answer", False, 1), ("execution", None, 2)],
        "d": [("answer", True, 0), ("execution", None, 1)],
        "e": [("request", None, 0), ("answer", True, 1), ("execution", None, 500)],
        "f": [("execution", None, 0)],
        "g": [("request", None, 0), ("answer", None, 1), ("execution", None, 2)],
    }
    rows = [(u, i, T0 + timedelta(minutes=m), role, yes) for u, s in steps.items() for i, (role, yes, m) in enumerate(s)]
    df = spark.createDataFrame(rows, "user string, event_id long, ts timestamp_ntz, role string, affirmed boolean")
    got = {(r.user, r.event_id): r.fault for r in D.confirmation_chain(df, ["user"], 7200).collect()}
    assert got == {("a", 2): None, ("a", 3): "reused", ("b", 1): "unanswered", ("c", 2): "refused", ("d", 1): "unasked", ("e", 2): "expired", ("f", 0): "unasked", ("g", 2): "refused"}


def test_alternatives_count_as_hits(spark):
    ranked = spark.createDataFrame([("p", "x", 1), ("p", "b", 2), ("p", "b", 3), ("q", "a", 1), ("r", "z", 1), ("p", "c", 11)], "query string, document string, rank int")
    labels = spark.createDataFrame(
        [("p", "a", None, ["b", "c", "b"]), ("q", "a", "s", None), ("r", "a", None, []), ("s", "a", None, ["b"]), ("t", None, None, [])],
        "query string, expected_document string, expected_section string, acceptable_alternatives array<string>",
    )
    r = M.labelled_metrics(ranked, labels, 10).first()
    assert tuple(r) == (0.25, 0.5, round((1 / 3 + 1) / 4, 6), round((0.5 + 1) / 4, 6), 0.25, 4)
