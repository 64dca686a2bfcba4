"""Voice queries: stage latencies, completeness, voice metrics, breakdown by version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import stages as S
from ledgerlens.plans.registry import query
from ledgerlens.sources.voice import VERSIONS, stage_sql, voice_stages


def _first(stage: str) -> str:
    names = "('TOOL_COMPLETED', 'TOOL_FAILED')" if stage == "TOOL_ENDED" else f"('{stage}')"
    return f"min(CASE WHEN stage IN {names} THEN at_ms END)"


LATENCY_SQL = ", ".join(f"{_first(b)} - {_first(a)} AS {name}" for name, (a, b) in S.LATENCIES.items())


@query("lt1_seven_latencies", stage_sql(f"SELECT turn_id, {LATENCY_SQL} FROM stages GROUP BY turn_id"))
def lt1_seven(spark, d):
    return S.stage_latencies(voice_stages(spark, d), ["turn_id"])


_LONG = " UNION ALL ".join(f"SELECT '{name}' AS latency, {name} AS ms FROM wide WHERE {name} IS NOT NULL" for name in S.LATENCIES)


@query("lt1_latency_percentiles", stage_sql(f", wide AS (SELECT turn_id, {LATENCY_SQL} FROM stages GROUP BY turn_id) SELECT latency, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.9), 3) AS p90, round(quantile_cont(ms, 0.95), 3) AS p95, count(*) AS n FROM ({_LONG}) GROUP BY latency").replace("\n, wide", ", wide"))
def lt1_percentiles(spark, d):
    return S.latency_percentiles(S.stage_latencies(voice_stages(spark, d), ["turn_id"]), [])


def _has(stage: str) -> str:
    return f"({_first(stage)} IS NOT NULL)"


_UNFINISHED = ", ".join(f"CASE WHEN {_has(a)} AND NOT {_has(b)} THEN '{a}' END" for a, b in S.PAIRS)
_NULLS = ", ".join(f"CASE WHEN count({v}) < count(*) THEN '{v}' END" for v in VERSIONS)
_TEXT = "array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), ',')"


@query("lt13_trace_completeness", stage_sql(f"SELECT * FROM (SELECT turn_id, {_TEXT.format(_UNFINISHED)} AS unfinished, {_TEXT.format(_NULLS)} AS missing_metadata FROM stages GROUP BY turn_id) WHERE unfinished <> '' OR missing_metadata <> ''"))
def lt13_completeness(spark, d):
    return S.gaps(voice_stages(spark, d), ["turn_id"], list(VERSIONS))


@query(
    "ev16_six_voice_metrics",
    stage_sql(
        f""", t AS (SELECT turn_id, {_first('STT_COMPLETED')} - {_first('USER_SPEECH_ENDED')} AS transcript, {_first('TTS_FIRST_AUDIO')} - {_first('USER_SPEECH_ENDED')} AS audio, {_first('TTS_CANCELLED')} - {_first('INTERRUPTION_DETECTED')} AS cancel, {_has('INTERRUPTION_DETECTED')} AS detected, {_has('USER_SPOKE_OVER')} AS spoken, {_has('TURN_COMPLETED')} AS done FROM stages GROUP BY turn_id)
SELECT round(avg(transcript), 6) AS transcript_ms, round(avg(audio), 6) AS first_audio_ms, round(avg(cancel), 6) AS cancel_ms, round(avg(CASE WHEN detected AND NOT spoken THEN 1e0 ELSE 0e0 END), 6) AS false_rate, round(avg(CASE WHEN spoken AND NOT detected THEN 1e0 ELSE 0e0 END), 6) AS missed_rate, round(avg(CASE WHEN done THEN 1e0 ELSE 0e0 END), 6) AS completion_rate, count(*) AS turns FROM t"""
    ).replace("\n, t AS", ", t AS"),
)
def ev16_six(spark, d):
    return S.voice_metrics(voice_stages(spark, d), ["turn_id"])


_SETS = ", ".join(f"({v})" for v in VERSIONS)


@query("lt9_by_all_versions", stage_sql(f"SELECT {', '.join(VERSIONS)}, count(*) AS turns, CAST(sum(k) AS BIGINT) AS tokens, round(avg(value), 6) AS mean_value FROM stages WHERE stage = 'USER_SPEECH_ENDED' GROUP BY GROUPING SETS ({_SETS}, ())"))
def lt9_all(spark, d):
    """Each of the five version fields by itself, and the total."""
    turns = voice_stages(spark, d).where("stage = 'USER_SPEECH_ENDED'")
    return turns.groupingSets([*[[v] for v in VERSIONS], []], *VERSIONS).agg(F.count("*").alias("turns"), F.sum("k").alias("tokens"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("lt7_usage_by_model", stage_sql("SELECT model, provider, count(DISTINCT turn_id) AS turns, CAST(sum(CASE WHEN stage = 'LLM_REQUESTED' THEN k ELSE 0 END) AS BIGINT) AS tokens, round(sum(CASE WHEN stage = 'USER_SPEECH_ENDED' THEN at_ms WHEN stage = 'USER_SPEECH_STARTED' THEN -at_ms ELSE 0 END) / 1e3, 3) AS audio_seconds FROM stages GROUP BY 1, 2"))
def lt7_by_model(spark, d):
    of = lambda stage, c: F.when(F.col("stage") == stage, c)
    spoken = F.sum(F.coalesce(of("USER_SPEECH_ENDED", F.col("at_ms")), of("USER_SPEECH_STARTED", -F.col("at_ms")), F.lit(0)))
    return voice_stages(spark, d).groupBy("model", "provider").agg(F.count_distinct("turn_id").alias("turns"), F.sum(F.coalesce(of("LLM_REQUESTED", F.col("k")), F.lit(0))).alias("tokens"), F.round(spoken / 1e3, 3).alias("audio_seconds"))
