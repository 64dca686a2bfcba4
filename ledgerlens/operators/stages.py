"""Voice stages of turns: latencies between stage events, completeness, voice metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The latencies by name, first and last event.
LATENCIES = {
    "final_transcript_ms": ("USER_SPEECH_ENDED", "STT_COMPLETED"),
    "llm_start_ms": ("STT_COMPLETED", "LLM_REQUESTED"),
    "first_token_ms": ("LLM_REQUESTED", "LLM_FIRST_TOKEN"),
    "tool_ms": ("TOOL_STARTED", "TOOL_ENDED"),
    "tts_start_ms": ("RESPONSE_READY", "TTS_STARTED"),
    "first_audio_ms": ("TTS_STARTED", "TTS_FIRST_AUDIO"),
    "response_ms": ("USER_SPEECH_ENDED", "TTS_FIRST_AUDIO"),
}
# Events that must be followed by another of their turn.
PAIRS = [("STT_STARTED", "STT_COMPLETED"), ("LLM_REQUESTED", "LLM_FIRST_TOKEN"), ("RETRIEVAL_STARTED", "RETRIEVAL_COMPLETED"), ("TOOL_STARTED", "TOOL_ENDED"), ("TTS_STARTED", "TTS_FIRST_AUDIO"), ("INTERRUPTION_DETECTED", "TTS_CANCELLED")]


def _at(stage: str) -> Column:
    """When a turn's first event of a stage happened; a tool ends by completing or failing."""
    names = ["TOOL_COMPLETED", "TOOL_FAILED"] if stage == "TOOL_ENDED" else [stage]
    return F.min(F.when(F.col("stage").isin(names), F.col("at_ms")))


def stage_latencies(stages: DataFrame, turn: list[str]) -> DataFrame:
    """One row per turn: its latencies in milliseconds, null where an event is missing. One pass, partial
    aggregates before the shuffle."""
    needed = sorted({e for pair in LATENCIES.values() for e in pair})
    wide = stages.groupBy(*turn).agg(*[_at(e).alias(e) for e in needed])
    return wide.select(*turn, *[(F.col(b) - F.col(a)).alias(name) for name, (a, b) in LATENCIES.items()])


def latency_percentiles(latencies: DataFrame, by: list[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """P50, P90 and P95 of each latency (latency, p50, p90, p95, n). exact holds a group's distinct values;
    otherwise percentile_approx, whose memory is bounded by accuracy."""
    long = latencies.unpivot(by, list(LATENCIES), "latency", "ms").where("ms is not null")
    points = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))
    p = F.percentile("ms", points) if exact else F.percentile_approx("ms", points, accuracy)
    return long.groupBy(*by, "latency").agg(p.alias("p"), F.count("*").alias("n")).select(*by, "latency", *[F.round(F.col("p")[i].cast("double"), 3).alias(f"p{q}") for i, q in enumerate((50, 90, 95))], "n")


def gaps(stages: DataFrame, turn: list[str], metadata: list[str]) -> DataFrame:
    """Turns that aren't whole: started stages that never end, and metadata columns that are null in
    some event, both as sorted text."""
    has = lambda e: F.max(F.col("stage").isin(["TOOL_COMPLETED", "TOOL_FAILED"] if e == "TOOL_ENDED" else [e]))
    open_ = [F.when(has(a) & ~has(b), F.lit(a)) for a, b in PAIRS]
    null = [F.when(F.max(F.col(m).isNull()), F.lit(m)) for m in metadata]
    text = lambda cs: F.array_join(F.array_sort(F.array_compact(F.array(*cs))), ",")
    return stages.groupBy(*turn).agg(text(open_).alias("unfinished"), text(null).alias("missing_metadata")).where("unfinished <> '' or missing_metadata <> ''")


def voice_metrics(stages: DataFrame, turn: list[str]) -> DataFrame:
    """The six voice metrics, in one row: mean time to the final transcript and to first audio, mean
    cancellation latency, rates of false and of missed interruptions (detected but nobody spoke over the
    output; spoken over but not detected), and of turns that were completed."""
    has = lambda e: F.max(F.col("stage") == e)
    t = stages.groupBy(*turn).agg(
        (_at("STT_COMPLETED") - _at("USER_SPEECH_ENDED")).alias("transcript"),
        (_at("TTS_FIRST_AUDIO") - _at("USER_SPEECH_ENDED")).alias("audio"),
        (_at("TTS_CANCELLED") - _at("INTERRUPTION_DETECTED")).alias("cancel"),
        has("INTERRUPTION_DETECTED").alias("detected"),
        has("USER_SPOKE_OVER").alias("spoken"),
        has("TURN_COMPLETED").alias("done"),
    )
    mean = lambda c: F.round(F.avg(c), 6)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return t.agg(
        mean("transcript").alias("transcript_ms"), mean("audio").alias("first_audio_ms"), mean("cancel").alias("cancel_ms"),
        share(F.col("detected") & ~F.col("spoken")).alias("false_rate"), share(F.col("spoken") & ~F.col("detected")).alias("missed_rate"), share(F.col("done")).alias("completion_rate"), F.count("*").alias("turns"),
    )
