"""Trace and latency operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["user_id", "session_no"]


def deltas(trace: DataFrame) -> DataFrame:
    """Seconds since the session's previous event; null for its first."""
    w = Window.partitionBy(*SESSION).orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    t = trace.withColumn("previous_event", F.lag("event").over(w)).withColumn("_p", F.lag("ts").over(w))
    return t.withColumn("delta_s", F.round((us(F.col("ts")) - us(F.col("_p"))) / 1e6, 3)).drop("_p")


def timeline(trace: DataFrame) -> DataFrame:
    """Sequence number and seconds since the session's first event."""
    w = Window.partitionBy(*SESSION).orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    first = F.first("ts").over(w)
    return trace.withColumn("sequence", F.row_number().over(w)).withColumn("elapsed_s", F.round((us(F.col("ts")) - us(first)) / 1e6, 3))


def percentiles(df: DataFrame, by: list[str], value: str, digits: int = 3) -> DataFrame:
    """Exact P50, P90 and P95 with linear interpolation, and n. Rows without a value don't count."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(p.alias("_p"), F.count("*").alias("n")).select(*by, *[F.round(F.col("_p")[i], digits).alias(f"p{q}") for i, q in enumerate((50, 90, 95))], "n")


def next_event(trace: DataFrame, start: str, end: str) -> DataFrame:
    """Each start event with the seconds to the session's next end event (null if there is none)."""
    w = Window.partitionBy(*SESSION).orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    nxt = F.first(F.when(F.col("event") == end, F.col("ts")), True).over(w)
    return trace.withColumn("_next", nxt).where(F.col("event") == start).withColumn("latency_s", F.round((us(F.col("_next")) - us(F.col("ts"))) / 1e6, 3)).drop("_next")


def sessions(trace: DataFrame) -> DataFrame:
    """One row per session: bounds, counts and usage."""
    return trace.groupBy(*SESSION).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_events"), F.count_if(F.col("event") == "error").alias("errors"), F.sum("k").alias("tokens"), F.max("value").alias("top_value")
    )


def transitions(trace: DataFrame) -> DataFrame:
    """Each event's state and the state before it in its session."""
    w = Window.partitionBy(*SESSION).orderBy("ts", "event_id")
    return trace.withColumn("from_state", F.lag("event").over(w)).where("from_state is not null")


def latest_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Partial and final transcripts: the last value of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("revisions"))


def drilldown(trace: DataFrame) -> DataFrame:
    """Per session, its events in order as one string; a session's events are few and bounded by its limits."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event")))
    return trace.groupBy(*SESSION).agg(F.array_join(F.transform(listed, lambda s: s["event"]), ">").alias("path"))


def unanswered(trace: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions with a start event and no end event."""
    s = trace.where(F.col("event") == start).select(*SESSION).distinct()
    return s.join(trace.where(F.col("event") == end).select(*SESSION), SESSION, "left_anti")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], bin_ms: int) -> DataFrame:
    """Interval-overlap join: pairs of rows of equal keys whose intervals (start_ms, end_ms; the end
    excluded) share a moment. Columns of the left come as l_*, of the right as r_*, with overlap_ms.

    Intervals are dealt into time bins and joined on keys and bin, so that rows meet only where they are
    near in time, a long session is many bins, and the join stays a hash or sort-merge join on equal
    columns. Two intervals that share several bins meet in each; the pair counts in the bin of the later
    start alone, which both have. Bins should be about as long as most intervals: a longer interval is
    copied into each bin that it touches. Empty intervals, and those with a null key or bound, overlap nothing."""

    def dealt(df: DataFrame, side: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms))
        some = df.where(F.col("start_ms") < F.col("end_ms"))
        return some.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], F.explode(bins).alias(f"{side}_bin"))

    both = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in [*keys, "bin"]]
    later, sooner = F.greatest("l_start_ms", "r_start_ms"), F.least("l_end_ms", "r_end_ms")
    pairs = dealt(left, "l").join(dealt(right, "r"), [*both, later < sooner, F.floor(later / bin_ms) == F.col("l_bin")])
    return pairs.withColumn("overlap_ms", sooner - later).drop("l_bin", "r_bin")


def interrupted_outputs(played: DataFrame, spoken: DataFrame, bin_ms: int = 10_000) -> DataFrame:
    """Outputs that a user spoke over: turn_id, overlaps, spoken_ms (the sum of overlaps), heard_ms
    (played before the first of them). One output may meet several stretches of speech, of any turn of
    its session."""
    o = overlaps(played, spoken, SESSION, bin_ms)
    heard = F.min(F.greatest(F.lit(0), F.col("r_start_ms") - F.col("l_start_ms")))
    return o.groupBy(F.col("l_turn_id").alias("turn_id")).agg(F.count("*").alias("overlaps"), F.sum("overlap_ms").alias("spoken_ms"), heard.alias("heard_ms"))


#: Of KLL sketches with SKETCH_K: the quantile of p has a true rank within SKETCH_RANK_ERROR of p, in 99 % of cases.
SKETCH_K, SKETCH_RANK_ERROR = 1000, 0.005


def sketches(df: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """A quantile sketch per hour of ``at`` and group: by, hour, sketch, n. A sketch takes a few kilobytes
    however many rows it has seen, and rows are sketched before the shuffle. Such rows are stored, appended
    hour by hour, and merged for any longer time. Rows without a value don't count."""
    hour = F.date_trunc("hour", F.col(at).cast("timestamp")).cast("timestamp_ntz").alias("hour")
    return df.where(F.col(value).isNotNull()).groupBy(*by, hour).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"), F.count("*").alias("n"))


def merged_percentiles(stored: DataFrame, by: list[str], at: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """by, p50 and so on, n (of rows, from the sketches) and hours (sketches merged), from stored sketches."""
    merged = stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.count("*").alias("hours"))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(p * 100)}") for p in at]
    return merged.select(*by, *quantiles, F.kll_sketch_get_n_double("sketch").alias("n"), "hours")
