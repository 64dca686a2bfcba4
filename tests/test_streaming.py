"""The session machine against a plain loop, and stores written and read again."""

from pyspark.sql import functions as F

from ledgerlens.plans.catalog import QUERIES
from ledgerlens.sources import stores
from ledgerlens.sources.tables import table


def plain_machine(events, expiry=3):
    out, sessions = [], {}
    for e in sorted(events, key=lambda e: (e.user_id, e.ts, e.event_id)):
        state, turn, pending, asked = sessions.get(e.user_id, ("READY", 0, None, None))
        turn, action, before = turn + 1, None, state
        if pending and turn - asked > expiry:
            pending, asked, action = None, None, "expired"
        match e.event_type:
            case "purchase":
                pending, asked, state = "create_dispute", turn, "WAITING_FOR_CONFIRMATION"
            case "click" if pending:
                action, state, pending = f"executed {pending}", "TOOL_EXECUTION", None
            case "error":
                action, state, pending = "cancelled" if pending else action, "INTERRUPTED", None
            case "signup":
                state = "LISTENING"
            case _ if not pending:
                state = "PROCESSING"
        if state != before or action:
            out.append((e.user_id, e.event_id, before, state, action))
        sessions[e.user_id] = (state, turn, pending, asked)
    return out


def test_state_machine_equals_plain_loop(spark, data):
    got = [tuple(r) for r in QUERIES["st1_state_machine"](spark, data).collect()]
    assert sorted(got, key=repr) == sorted(plain_machine(table(spark, data, "events").collect()), key=repr)


def test_logs_round_trip(spark, tmp_path):
    logs = spark.sql("select 't1' trace_id, 's1' session_id, 'u1' turn_id, 'TOOL_COMPLETED' event, timestamp '2024-01-01 00:00:00' ts, 'freeze_card' tool, 82L duration_ms, true success")
    stores.write_logs(logs, str(tmp_path / "logs"))
    (tmp_path / "logs" / "bad.json").write_text("not json\n")
    back = stores.read_logs(spark, str(tmp_path / "logs")).cache()
    assert back.where("_corrupt is null").drop("_corrupt").exceptAll(logs).isEmpty()
    assert back.where("_corrupt is not null").count() == 1


def test_chunk_store_prunes_by_category(spark, data, tmp_path):
    docs = table(spark, data, "documents").select("doc_id", "text", F.col("lang").alias("policy_category"))
    stores.write_chunks(docs, str(tmp_path / "chunks"))
    found = spark.read.parquet(str(tmp_path / "chunks")).where("policy_category = 'de'")
    assert "PartitionFilters: [isnotnull(policy_category" in found._jdf.queryExecution().toString()
    assert found.count() == docs.where("policy_category = 'de'").count()


def test_scenarios_and_labels(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "a", "initial_state": {"customer_id": "c", "authenticated": true}, "expected": {"tools": ["freeze_card"], "prohibited_tools": []}}\n')
    s = stores.read_scenarios(spark, str(tmp_path / "s.json")).first()
    assert s.expected.tools == ["freeze_card"] and s.initial_state.authenticated and s.user_goal is None
    (tmp_path / "l.json").write_text('{"query": "q", "expected_document": "d"}\n')
    assert stores.read_retrieval_labels(spark, str(tmp_path / "l.json")).first().acceptable_alternatives is None


def test_migrate_and_audio(spark, tmp_path):
    from pyspark.sql import types as T

    out = stores.migrate(spark.sql("select 1 a"), 2, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
    assert [tuple(r) for r in out.collect()] == [(1, None, 2)]
    (tmp_path / "x.wav").write_bytes(b"RIFF")
    assert stores.read_audio(spark, str(tmp_path)).first().bytes == 4
