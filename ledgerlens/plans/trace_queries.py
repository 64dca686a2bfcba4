"""Trace, latency and usage queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import traces as T
from ledgerlens.plans.decision_queries import SESSION_SQL, session_sql
from ledgerlens.plans.registry import query
from ledgerlens.sources.domain import trace, with_views
from ledgerlens.sources.scratch import new_folder
from ledgerlens.sources.tables import table
from ledgerlens.sources.voice import OUTPUT_SQL, playback_and_speech, stage_sql, voice_stages

W = "(PARTITION BY user_id, session_no ORDER BY ts, event_id)"
DELTAS = f"d AS (SELECT *, round((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6, 3) AS delta_s, lag(event) OVER {W} AS previous_event FROM trace)"


def trace_sql(extra: str, body: str) -> str:
    return with_views("trace", "").rstrip() + (", " + extra if extra else "") + "\n" + body


@query("ev11_latency_percentiles", trace_sql(DELTAS, "SELECT event, round(quantile_cont(delta_s, 0.5), 3) AS p50, round(quantile_cont(delta_s, 0.9), 3) AS p90, round(quantile_cont(delta_s, 0.95), 3) AS p95, count(*) AS n FROM d WHERE delta_s IS NOT NULL GROUP BY event"))
def ev11(spark, d):
    return T.percentiles(T.deltas(trace(spark, d)), ["event"], "delta_s")


@query(
    "ev11_sketched_percentiles",
    trace_sql(DELTAS, "SELECT event, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours, true AS p50_near, true AS p90_near, true AS p95_near FROM d WHERE delta_s IS NOT NULL GROUP BY event"),
)
def ev11_sketched(spark, d):
    """Percentiles from sketches that were stored by hour and merged: whether the share of values below
    each, counted exactly, is within twice the stated error; and that no row or hour was lost."""
    path = new_folder(spark, "sketches")
    values = T.deltas(trace(spark, d)).where("delta_s is not null").select("event", "ts", "delta_s")
    T.sketches(values, ["event"], "delta_s", "ts").write.parquet(path)
    found = T.merged_percentiles(spark.read.parquet(path), ["event"])
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    ranks = values.join(F.broadcast(found), "event").groupBy("event", "n", "hours").agg(
        *[F.avg((F.col("delta_s") < F.col(p)).cast("double")).alias(f"{p}_below") for p in names], *[F.avg((F.col("delta_s") <= F.col(p)).cast("double")).alias(f"{p}_to") for p in names]
    )
    most = 2 * T.SKETCH_RANK_ERROR
    return ranks.select("event", "n", "hours", *[((F.col(f"{p}_below") <= x + most) & (F.col(f"{p}_to") >= x - most)).alias(f"{p}_near") for p, x in names.items()])


@query("lt1_stage_latency", trace_sql("", f"SELECT event_id, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) AS latency_s FROM (SELECT *, first_value(CASE WHEN event = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM trace) WHERE event = 'view'"))
def lt1(spark, d):
    return T.next_event(trace(spark, d), "view", "purchase").select("event_id", "latency_s")


@query("lt2_session_timeline", trace_sql("", f"SELECT event_id, session_no, CAST(row_number() OVER {W} AS INTEGER) AS sequence, round((epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) / 1e6, 3) AS elapsed_s FROM trace"))
def lt2(spark, d):
    return T.timeline(trace(spark, d)).select("event_id", "session_no", "sequence", "elapsed_s")


@query("lt3_drilldown", trace_sql("", "SELECT user_id, session_no, string_agg(event, '>' ORDER BY ts, event_id) AS path FROM trace GROUP BY 1, 2"))
def lt3(spark, d):
    return T.drilldown(trace(spark, d))


@query("lt4_event_deltas", trace_sql(DELTAS, "SELECT event_id, previous_event, delta_s FROM d"))
def lt4(spark, d):
    return T.deltas(trace(spark, d)).select("event_id", "previous_event", "delta_s")


@query("lt5_cancel_latency", trace_sql("", "SELECT event_id, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) AS latency_s FROM (SELECT *, first_value(CASE WHEN event = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM trace) WHERE event = 'click'"))
def lt5(spark, d):
    return T.next_event(trace(spark, d), "click", "error").select("event_id", "latency_s")


@query(
    "lt6_incomplete_outputs",
    stage_sql(
        OUTPUT_SQL
        + """
SELECT p.turn_id, count(*) AS overlaps, CAST(sum(least(p.end_ms, s.end_ms) - greatest(p.start_ms, s.start_ms)) AS BIGINT) AS spoken_ms, min(greatest(0, s.start_ms - p.start_ms)) AS heard_ms
FROM played p JOIN spoken s ON p.user_id = s.user_id AND p.session_no = s.session_no AND p.start_ms < s.end_ms AND s.start_ms < p.end_ms AND p.start_ms < p.end_ms AND s.start_ms < s.end_ms GROUP BY 1"""
    ).replace("\n, turns", ", turns"),
)
def lt6(spark, d):
    """Outputs that play while the user speaks, in their turn or in another of the session."""
    return T.interrupted_outputs(*playback_and_speech(voice_stages(spark, d)))


@query("lt7_usage", session_sql("SELECT user_id, count(*) AS sessions, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(max(tokens) AS BIGINT) AS most_tokens FROM session GROUP BY 1"))
def lt7(spark, d):
    return T.sessions(trace(spark, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"))


@query("lt8_errors", trace_sql("", "SELECT event, count(*) AS n, count(*) FILTER (value > 100) AS slow, round(avg(CASE WHEN value > 100 THEN 1e0 ELSE 0e0 END), 6) AS slow_rate FROM trace GROUP BY 1"))
def lt8(spark, d):
    slow = F.col("value") > 100
    return trace(spark, d).groupBy("event").agg(F.count("*").alias("n"), F.count_if(slow).alias("slow"), F.round(F.avg(F.when(slow, 1.0).otherwise(0.0)), 6).alias("slow_rate"))


@query("lt9_by_version", trace_sql("", "SELECT event, k % 3 AS prompt_version, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens FROM trace GROUP BY GROUPING SETS ((event, k % 3), (event), ())"))
def lt9(spark, d):
    t = trace(spark, d).withColumn("prompt_version", F.col("k") % 3)
    return t.groupingSets([["event", "prompt_version"], ["event"], []], "event", "prompt_version").agg(F.count("*").alias("n"), F.sum("k").alias("tokens"))


@query("lt10_final_transcripts", "SELECT conv_id, role, arg_max(text, turn) AS text, count(*) AS revisions FROM conversations GROUP BY 1, 2")
def lt10(spark, d):
    return T.latest_per_key(table(spark, d, "conversations"), ["conv_id", "role"], "text", ["turn"])


@query("lt11_transitions", trace_sql("", f"SELECT from_state, event AS to_state, count(*) AS n FROM (SELECT *, lag(event) OVER {W} AS from_state FROM trace) WHERE from_state IS NOT NULL GROUP BY 1, 2"))
def lt11(spark, d):
    return T.transitions(trace(spark, d)).groupBy("from_state", F.col("event").alias("to_state")).agg(F.count("*").alias("n"))


@query("lt12_replay", trace_sql("", f"SELECT event_id, event, value, CAST(row_number() OVER {W} AS INTEGER) AS sequence FROM trace"))
def lt12(spark, d):
    return T.timeline(trace(spark, d)).select("event_id", "event", "value", "sequence")


@query("lt13_trace_gaps", trace_sql("", "SELECT DISTINCT user_id, session_no FROM trace WHERE event = 'click' AND (user_id, session_no) NOT IN (SELECT (user_id, session_no) FROM trace WHERE event = 'view')"))
def lt13(spark, d):
    return T.unanswered(trace(spark, d), "click", "view")


@query("io13_dashboard", session_sql("SELECT count(*) AS sessions, CAST(sum(n_events) AS BIGINT) AS events, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(CASE WHEN errors = 0 THEN 1e0 ELSE 0e0 END), 6) AS clean_rate FROM session"))
def io13(spark, d):
    return T.sessions(trace(spark, d)).agg(F.count("*").alias("sessions"), F.sum("n_events").alias("events"), F.sum("errors").alias("errors"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.when(F.col("errors") == 0, 1.0).otherwise(0.0)), 6).alias("clean_rate"))


@query("st2_session_window", session_sql("SELECT user_id, start_ts, end_ts, n_events FROM session"))
def st2(spark, d):
    return T.sessions(trace(spark, d)).select("user_id", "start_ts", "end_ts", "n_events")


__all__ = ["SESSION_SQL"]
