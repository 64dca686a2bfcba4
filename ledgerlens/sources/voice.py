"""Stage events of voice turns, derived from the given events: each event stands for one turn.

A stage's time is the event's time plus a fixed number of milliseconds and a number that grows with the
event's k; some stages only happen in some turns. The same rules make the SQL view for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.domain import SQL, trace

# Stage, milliseconds after the event, milliseconds per k, and the turns that have it (valid in both engines).
STAGES = [
    ("USER_SPEECH_STARTED", -2000, 0, "true"),
    ("USER_SPEECH_ENDED", 0, 0, "true"),
    ("STT_STARTED", 20, 0, "true"),
    ("STT_COMPLETED", 120, 3, "k % 23 <> 0"),
    ("LLM_REQUESTED", 140, 4, "k % 23 <> 0"),
    ("LLM_FIRST_TOKEN", 300, 9, "k % 13 <> 0 AND k % 23 <> 0"),
    ("RETRIEVAL_STARTED", 310, 9, "event = 'view'"),
    ("RETRIEVAL_COMPLETED", 350, 11, "event = 'view' AND k % 19 <> 0"),
    ("TOOL_STARTED", 320, 9, "event <> 'view'"),
    ("TOOL_COMPLETED", 400, 15, "event <> 'view' AND event <> 'error'"),
    ("TOOL_FAILED", 1000, 15, "event = 'error' AND k % 3 <> 0"),
    ("RESPONSE_READY", 1200, 15, "k % 13 <> 0"),
    ("TTS_STARTED", 1230, 15, "k % 13 <> 0"),
    ("TTS_FIRST_AUDIO", 1300, 17, "k % 13 <> 0 AND k % 11 <> 0"),
    ("USER_SPOKE_OVER", 1500, 17, "k % 5 = 0"),
    ("INTERRUPTION_DETECTED", 1550, 17, "(k % 5 = 0 AND k % 7 <> 0) OR k % 29 = 0"),
    ("TTS_CANCELLED", 1600, 18, "k % 5 = 0 AND k % 7 <> 0"),
    ("TURN_COMPLETED", 5000, 20, "k % 13 <> 0 AND event <> 'error'"),
]

#: Version fields of a turn, each by its rule (valid in both engines).
VERSIONS = {
    "model": "CASE WHEN k % 17 <> 0 THEN concat('model-', CAST(k % 3 AS STRING)) END",
    "provider": "CASE WHEN k % 31 <> 0 THEN concat('provider-', CAST(k % 2 AS STRING)) END",
    "prompt_version": "concat('p', CAST(k % 4 AS STRING))",
    "tool_schema_version": "concat('t', CAST(user_id % 2 AS STRING))",
    "retrieval_version": "concat('r', CAST(user_id % 3 AS STRING))",
}


def voice_stages(spark: SparkSession, d: str) -> DataFrame:
    """turn_id, user_id, session_no, event, k, value, version fields, stage, at_ms."""
    each = F.array(*[F.when(F.expr(cond), F.struct(F.lit(name).alias("stage"), (F.lit(base) + F.lit(per_k) * F.col("k")).cast("long").alias("after"))) for name, base, per_k, cond in STAGES])
    t = trace(spark, d).select(F.col("event_id").alias("turn_id"), "user_id", "session_no", "event", "k", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), *[F.expr(e).alias(v) for v, e in VERSIONS.items()], F.explode(F.array_compact(each)).alias("s"))
    return t.select("turn_id", "user_id", "session_no", "event", "k", "value", *VERSIONS, "s.stage", (F.col("ms") + F.col("s.after")).alias("at_ms"))


_versions = ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {v}" for v, e in VERSIONS.items())
_of_turn = " UNION ALL ".join(f"SELECT event_id AS turn_id, user_id, session_no, event, k, value, {_versions}, '{name}' AS stage, epoch_us(ts) // 1000 + {base} + {per_k} * k AS at_ms FROM trace WHERE {cond}" for name, base, per_k, cond in STAGES)
STAGE_SQL = f"{SQL['trace']}, stages AS ({_of_turn})"


def playback_and_speech(stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals of a session: what the agent plays (from its first audio to its cancellation or its
    turn's end) and what the user says (from start to end, and where they speak over the agent until it
    is noticed, two seconds at most). turn_id, user_id, session_no, start_ms, end_ms; end excluded."""
    at = lambda *names: F.min(F.when(F.col("stage").isin(*names), F.col("at_ms")))
    turns = stages.groupBy("turn_id", "user_id", "session_no").agg(
        at("TTS_FIRST_AUDIO").alias("audio"), at("TTS_CANCELLED", "TURN_COMPLETED").alias("done"), at("USER_SPEECH_STARTED").alias("said"), at("USER_SPEECH_ENDED").alias("ended"), at("USER_SPOKE_OVER").alias("over"), at("INTERRUPTION_DETECTED").alias("noticed")
    )
    keys = ["turn_id", "user_id", "session_no"]
    played = turns.where("audio is not null").select(*keys, F.col("audio").alias("start_ms"), F.coalesce("done", F.col("audio") + 60_000).alias("end_ms"))
    own = F.struct(F.col("said").alias("start_ms"), F.col("ended").alias("end_ms"))
    over = F.when(F.col("over").isNotNull(), F.struct(F.col("over").alias("start_ms"), F.least(F.coalesce("noticed", F.col("over") + 2000), F.col("over") + 2000).alias("end_ms")))
    spoken = turns.select(*keys, F.explode(F.array_compact(F.array(own, over))).alias("s")).select(*keys, "s.*")
    return played, spoken


OUTPUT_SQL = """, turns AS (SELECT turn_id, user_id, session_no, min(at_ms) FILTER (stage = 'TTS_FIRST_AUDIO') AS audio, min(at_ms) FILTER (stage IN ('TTS_CANCELLED', 'TURN_COMPLETED')) AS done, min(at_ms) FILTER (stage = 'USER_SPEECH_STARTED') AS said, min(at_ms) FILTER (stage = 'USER_SPEECH_ENDED') AS ended, min(at_ms) FILTER (stage = 'USER_SPOKE_OVER') AS over, min(at_ms) FILTER (stage = 'INTERRUPTION_DETECTED') AS noticed FROM stages GROUP BY 1, 2, 3),
played AS (SELECT turn_id, user_id, session_no, audio AS start_ms, coalesce(done, audio + 60000) AS end_ms FROM turns WHERE audio IS NOT NULL),
spoken AS (SELECT turn_id, user_id, session_no, said AS start_ms, ended AS end_ms FROM turns UNION ALL SELECT turn_id, user_id, session_no, over, least(coalesce(noticed, over + 2000), over + 2000) FROM turns WHERE over IS NOT NULL)"""


def stage_sql(body: str) -> str:
    return f"WITH {STAGE_SQL}\n{body}"


def stage_stream(events: DataFrame) -> DataFrame:
    """Stage events of a stream of events: user_id, turn_id, ts, event_type, no, stage, at_ms."""
    each = F.array(*[F.when(F.expr(cond), F.struct(F.lit(i).alias("no"), F.lit(name).alias("stage"), (F.lit(base) + F.lit(per_k) * F.col("k")).cast("long").alias("after"))) for i, (name, base, per_k, cond) in enumerate(STAGES)])
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("event", F.col("event_type"))
    return e.select("user_id", F.col("event_id").alias("turn_id"), "ts", "event_type", F.explode(F.array_compact(each)).alias("s")).select("user_id", "turn_id", "ts", "event_type", "s.no", "s.stage", (F.unix_millis("ts") + F.col("s.after")).alias("at_ms"))
