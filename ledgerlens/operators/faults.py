"""Failure injection: faults put into calls, the attempts that follow, and whether calls recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.decisions import decide, retry_action

# The nine faults, the typed error that each raises, and how it ends: after some attempts (transient), when
# the user answers (dialogue), or never (duplicate: nothing fails, the call only comes twice).
FAULTS = [
    ("database_timeout", "TimeoutError", "transient"),
    ("tool_500", "TransientDependencyError", "transient"),
    ("retrieval_empty", "NotFoundError", "dialogue"),
    ("stt_timeout", "TimeoutError", "transient"),
    ("tts_timeout", "TimeoutError", "transient"),
    ("llm_timeout", "TimeoutError", "transient"),
    ("duplicate_tool_request", None, "duplicate"),
    ("stale_confirmation", "ConflictError", "dialogue"),
    ("invalid_transaction_id", "ValidationError", "dialogue"),
]
FAULT_SCHEMA = "fault_no int, fault string, error string, ends string"


def draw(key: Column) -> Column:
    """A number from a key that any engine can compute again: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def inject(calls: DataFrame, tools: DataFrame, tenths: int = 3) -> DataFrame:
    """That many tenths of the calls, each with a fault, its error, how it ends, and how many attempts
    fail (1 to 4, for transient faults). Drawn by call_id, so a rerun injects the same. Confirmations
    can be stale only in confirmed calls that need one; others draw no fault in its place."""
    some = calls.withColumn("_n", draw(F.col("call_id"))).where(F.col("_n") % 10 < tenths)
    numbered = calls.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(FAULTS)], FAULT_SCHEMA)
    some = some.withColumn("fault_no", (F.floor(F.col("_n") / 10) % len(FAULTS)).cast("int")).withColumn("fails", (1 + F.floor(F.col("_n") / 90) % 4).cast("int"))
    out = some.join(F.broadcast(numbered), "fault_no").join(F.broadcast(tools.select("tool", F.col("requires_confirmation").alias("_asks"))), "tool", "left")
    return out.where("fault <> 'stale_confirmation' or (coalesce(_asks, false) and confirmed)").drop("_n", "_asks", "fault_no")


def attempts(faulty: DataFrame, replies: DataFrame, tools: DataFrame, most: int = 2) -> DataFrame:
    """One row per attempt of each injected call: attempt, outcome, error and action.

    replies (call_id, reply_confirms): calls whose user answered a question about them, and whether the answer
    confirms. Transient faults are tried again, at most ``most`` times, then escalated. Faults of the dialogue lead
    to a question; if it is answered, the call is made once more, without the fault. Each attempt goes through
    ``decide()`` with what the fault does to it: an unknown id makes its arguments invalid, a stale confirmation
    makes it unconfirmed, a dependency's error stops it before (outcome failed). A call that comes again after it
    was executed has no second effect (outcome replayed)."""
    answered = replies.select("call_id", "reply_confirms", F.lit(True).alias("_answered"))
    c = faulty.join(answered, "call_id", "left").withColumn("_answered", F.coalesce("_answered", F.lit(False)))
    transient, dialogue = F.col("ends") == "transient", F.col("ends") == "dialogue"
    made = F.when(transient, F.least(F.col("fails") + 1, F.lit(most + 1))).when(dialogue & ~F.col("_answered"), 1).otherwise(2)
    c = c.withColumn("attempt", F.explode(F.sequence(F.lit(1), made)))
    active = (transient & (F.col("attempt") <= F.col("fails"))) | (dialogue & (F.col("attempt") == 1))
    stale, unknown = F.col("fault") == "stale_confirmation", F.col("fault") == "invalid_transaction_id"
    c = c.withColumn("_active", active).withColumn("confirmed", F.when(stale & active, False).when(stale, F.coalesce("reply_confirms", F.lit(False))).otherwise(F.col("confirmed")))
    c = c.withColumn("arguments_valid", F.when(unknown & active, False).otherwise(F.col("arguments_valid")))
    d = decide(c, tools)
    stopped = F.col("_active") & ~stale & ~unknown
    d = d.withColumn("error", F.when(F.col("_active"), F.col("error"))).withColumn("outcome", F.when(stopped, "failed").otherwise(F.col("outcome")))
    before = Window.partitionBy("call_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("outcome") == "executed").over(before), F.lit(False))
    d = d.withColumn("outcome", F.when(done & (F.col("outcome") == "executed"), "replayed").otherwise(F.col("outcome")))
    action = F.when(F.col("error").isNotNull(), retry_action(F.col("error"), F.col("attempt"), most))
    return d.select("call_id", "tool", "fault", "attempt", "outcome", "error", action.alias("action"))


def recovery(log: DataFrame, plain: DataFrame) -> DataFrame:
    """By fault: calls, the share that recovered, attempts, calls escalated, effects, and calls with more
    than one effect. A call recovers if its last attempt ends as the call does without the fault
    (plain: call_id, outcome), where a replay is as good as the execution that it repeats."""
    one = log.groupBy("fault", "call_id").agg(
        F.max_by("outcome", "attempt").alias("last"), F.count("*").alias("made"), F.max(F.coalesce(F.col("action") == "escalate", F.lit(False))).alias("escalated"), F.count_if(F.col("outcome") == "executed").alias("effects")
    )
    ended = F.when(F.col("last") == "replayed", "executed").otherwise(F.col("last"))
    both = one.join(plain.select("call_id", F.col("outcome").alias("_plain")), "call_id")
    return both.groupBy("fault").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(ended == F.col("_plain"), 1.0).otherwise(0.0)), 6).alias("recovered"), F.sum("made").alias("attempts"),
        F.count_if("escalated").alias("escalated"), F.sum("effects").alias("effects"), F.count_if(F.col("effects") > 1).alias("doubled"),
    )
