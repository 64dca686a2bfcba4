"""Grader, voice and handoff queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import traces as T
from ledgerlens.operators.graders import graded
from ledgerlens.plans.decision_queries import decided, decided_sql
from ledgerlens.plans.registry import query
from ledgerlens.sources.domain import trace, with_views
from ledgerlens.sources.tables import table


def letters_used(texts: list[str]) -> list[float]:
    """A deterministic stand-in for a semantic grader: the share of a-z that a text uses."""
    return [len({c for c in t.lower() if "a" <= c <= "z"}) / 26 for t in texts]


@query(
    "ev28_graders",
    """WITH a AS (SELECT conv_id, turn, length(text) >= 200 AS ok, len(list_distinct(regexp_extract_all(lower(text), '[a-z]'))) / 26.0::DOUBLE AS s FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN ok THEN 'semantic' ELSE 'deterministic' END AS grader_kind, ok AND s >= 0.7 AS passed FROM a""",
)
def ev28(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return graded(answers, "text", {"long_enough": F.length("text") >= 200}, letters_used, 0.7).select("conv_id", "turn", "grader_kind", "passed")


@query(
    "ev7_grounded",
    """WITH a AS (SELECT length(text) >= 200 AND len(list_distinct(regexp_extract_all(lower(text), '[a-z]'))) / 26.0::DOUBLE >= 0.7 AS p, turn FROM conversations WHERE role = 'assistant')
SELECT turn, round(avg(CASE WHEN p THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS n FROM a GROUP BY turn""",
)
def ev7(spark, d):
    return ev28(spark, d).groupBy("turn").agg(F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("n"))


@query(
    "ev16_voice",
    with_views(
        "trace",
        """, v AS (SELECT event, ts, lead(event) OVER w AS nxt, lag(event) OVER w AS prv, lead(ts) OVER w AS nxt_ts FROM trace WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id))
SELECT count(*) FILTER (event = 'click') AS interruptions, round(avg(CASE WHEN nxt = 'error' THEN 0e0 ELSE 1e0 END) FILTER (event = 'click'), 6) AS false_interruption_rate,
round(avg(CASE WHEN prv = 'click' THEN 0e0 ELSE 1e0 END) FILTER (event = 'error'), 6) AS missed_interruption_rate, round(avg((epoch_us(nxt_ts) - epoch_us(ts)) / 1e6) FILTER (event = 'click' AND nxt = 'error'), 3) AS cancel_s,
round(avg(CASE WHEN nxt IS NULL THEN 1e0 ELSE 0e0 END) FILTER (event = 'view'), 6) AS completion_rate FROM v""",
    ).replace("\n, v", ", v"),
)
def ev16(spark, d):
    """Clicks stand for detected interruptions, errors for cancelled output, views for output."""
    w = Window.partitionBy(*T.SESSION).orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    v = trace(spark, d).withColumns({"nxt": F.lead("event").over(w), "prv": F.lag("event").over(w), "nxt_ts": F.lead("ts").over(w)})
    share = lambda of, good: F.round(F.avg(F.when(F.col("event") == of, F.when(F.coalesce(good, F.lit(False)), 1.0).otherwise(0.0))), 6)
    none = lambda c: ~F.coalesce(c, F.lit(False))
    return v.agg(
        F.count_if(F.col("event") == "click").alias("interruptions"),
        share("click", none(F.col("nxt") == "error")).alias("false_interruption_rate"),
        share("error", none(F.col("prv") == "click")).alias("missed_interruption_rate"),
        F.round(F.avg(F.when((F.col("event") == "click") & (F.col("nxt") == "error"), (us(F.col("nxt_ts")) - us(F.col("ts"))) / 1e6)), 3).alias("cancel_s"),
        share("view", F.col("nxt").isNull()).alias("completion_rate"),
    )


@query(
    "io7_handoff_json",
    decided_sql("SELECT customer_id, '{\"calls\":' || count(*) || ',\"denied\":' || count(*) FILTER (outcome = 'denied') || ',\"waiting\":' || count(*) FILTER (outcome = 'confirm') || '}' AS handoff FROM outcomes GROUP BY customer_id"),
)
def io7(spark, d):
    g = decided(spark, d).groupBy("customer_id").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "denied").alias("denied"), F.count_if(F.col("outcome") == "confirm").alias("waiting"))
    return g.select("customer_id", F.to_json(F.struct("calls", "denied", "waiting")).alias("handoff"))


@query("io6_log_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events")
def io6(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("tokens"))
