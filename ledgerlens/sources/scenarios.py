"""Scenarios with expected tools, and what sessions of calls really did, derived from the given events.

Each customer with calls is one scenario. Its category follows from the customer's number; the category
says which tools are expected, which are prohibited and what the outcome should be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Number, category, expected tools, prohibited tools.
CATEGORIES = [
    (0, "informational", "get_account_balance", "create_dispute,freeze_card"),
    (1, "account_read", "get_account_balance,get_recent_transactions", "freeze_card"),
    (2, "protected_actions", "create_dispute,freeze_card", "export_ledger"),
    (3, "clarification", "get_recent_transactions", "create_dispute"),
    (4, "confirmation", "create_dispute,get_account_balance", "export_ledger"),
    (5, "escalation", "get_recent_transactions,get_account_balance", "freeze_card"),
    (6, "safety", "get_account_balance", "export_ledger,freeze_card"),
    (7, "realtime_voice", "get_account_balance,get_recent_transactions", "export_ledger"),
]

SCENARIO_SQL = """category AS (SELECT number, category, string_split(expected, ',') AS expected, string_split(prohibited, ',') AS prohibited FROM (VALUES {}) AS t(number, category, expected, prohibited)),
run AS (SELECT customer_id, list(DISTINCT tool) AS asked, coalesce(list(DISTINCT tool) FILTER (outcome = 'executed'), []) AS executed, CAST(sum(k) AS BIGINT) AS tokens FROM outcomes GROUP BY 1),
scenario AS (SELECT customer_id, category, expected, prohibited, asked, executed, tokens FROM run JOIN category ON customer_id % 8 = number)""".format(", ".join(f"({n}, '{c}', '{e}', '{p}')" for n, c, e, p in CATEGORIES))


def scenarios(spark: SparkSession, decided: DataFrame) -> DataFrame:
    """customer_id, category, expected, prohibited, asked, executed (arrays of tools), tokens."""
    cats = spark.createDataFrame(CATEGORIES, "number long, category string, expected string, prohibited string")
    cats = cats.select("number", "category", F.split("expected", ",").alias("expected"), F.split("prohibited", ",").alias("prohibited"))
    run = decided.groupBy("customer_id").agg(F.collect_set("tool").alias("asked"), F.collect_set(F.when(F.col("outcome") == "executed", F.col("tool"))).alias("executed"), F.sum("k").alias("tokens"))
    return run.join(F.broadcast(cats), F.col("customer_id") % 8 == F.col("number")).drop("number")
