"""The agent's domain as views of the given tables: DataFrames, and the same in SQL for the oracles.

accounts and cards come from customer (two accounts a customer), transactions from orders, merchants
from lineitem, turns from conversations, and the trace and the tool calls from events. A call's tool,
resource, confirmation and idempotency key follow from its event's type and number k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.sources.tables import table

SESSION_GAP_MIN = 30

# Stand-ins' vocabularies.
CARD_STATUS = {"AUTOMOBILE": "ACTIVE", "BUILDING": "FROZEN", "FURNITURE": "LOST", "HOUSEHOLD": "STOLEN", "MACHINERY": "CLOSED"}
TXN_STATUS = {"P": "PENDING", "F": "POSTED", "O": "REVERSED"}
TOOL_OF_EVENT = {"view": "get_account_balance", "click": "get_recent_transactions", "purchase": "create_dispute", "signup": "freeze_card", "error": "export_ledger"}

# The tool catalogue (name, level, requires_authentication, requires_confirmation, timeout_ms, idempotent, audited).
TOOLS = [
    ("search_policies", 1, False, False, 2000, True, False),
    ("escalate_to_human", 1, False, False, 2000, True, True),
    ("get_account_balance", 2, True, False, 1000, True, False),
    ("get_recent_transactions", 2, True, False, 1000, True, False),
    ("get_transaction_details", 2, True, False, 1000, True, False),
    ("get_card_status", 2, True, False, 1000, True, False),
    ("get_customer_profile", 2, True, False, 1000, True, False),
    ("list_customer_accounts", 2, True, False, 1000, True, False),
    ("list_customer_cards", 2, True, False, 1000, True, False),
    ("freeze_card", 3, True, True, 3000, True, True),
    ("create_dispute", 3, True, True, 3000, True, True),
]
TOOL_SCHEMA = "tool string, level int, requires_authentication boolean, requires_confirmation boolean, timeout_ms int, idempotent boolean, audited boolean"


def _cases(column, values: dict):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _sql_cases(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def tools(spark: SparkSession) -> DataFrame:
    """The catalogue; its size is fixed, so joins broadcast it."""
    return spark.createDataFrame(TOOLS, TOOL_SCHEMA)


def accounts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("account_id"),
        F.floor(F.col("c_custkey") / 2).cast("long").alias("customer_id"),
        F.when(F.col("c_custkey") % 2 == 0, "checking").otherwise("savings").alias("account_type"),
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("account_number"),
        F.col("c_acctbal").alias("current_balance"),
        F.col("c_nationkey").alias("nation_id"),
    )


def cards(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("card_id"),
        F.floor(F.col("c_custkey") / 2).cast("long").alias("customer_id"),
        F.col("c_custkey").alias("account_id"),
        F.lpad((F.col("c_custkey") * 7919 + 4000000000000000).cast("string"), 16, "0").alias("card_number"),
        _cases(F.col("c_mktsegment"), CARD_STATUS).alias("status"),
    )


def transactions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ts"),
        _cases(F.col("o_orderstatus"), TXN_STATUS).alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def merchants(spark: SparkSession, d: str) -> DataFrame:
    """The merchant of a transaction: its least supplier. Not every transaction has one."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("transaction_id")).agg(F.min("l_suppkey").alias("merchant_id"))


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Events with their session: a user's events, cut where SESSION_GAP_MIN minutes or more pass."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("prev_ts", F.lag("ts").over(by_user))
    new = F.when(F.col("prev_ts").isNull() | (F.col("ts") >= F.col("prev_ts") + F.expr(f"INTERVAL {SESSION_GAP_MIN} MINUTES")), 1).otherwise(0)
    e = e.withColumn("session_no", F.sum(new).over(by_user.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return e.select("event_id", "ts", "user_id", "session_no", F.col("event_type").alias("event"), "value", "k")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls: one per event. Every fifth user isn't authenticated; the resource belongs to
    another customer where k divides by 10; the request is confirmed where k is 50 or more."""
    return calls_of(table(spark, d, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """calls() of any events, a stream's too."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        F.col("event_id").alias("call_id"),
        "ts",
        F.col("user_id").alias("customer_id"),
        _cases(F.col("event_type"), TOOL_OF_EVENT).alias("tool"),
        F.when(F.col("k") % 10 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("resource_owner"),
        (F.col("k") % 7).alias("resource"),
        (F.col("user_id") % 5 != 0).alias("authenticated"),
        (F.col("k") >= 50).alias("confirmed"),
        (F.col("value") > 0.5).alias("arguments_valid"),
        "k",
        "value",
    )


SQL = {
    "account": "account AS (SELECT c_custkey AS account_id, CAST(floor(c_custkey / 2) AS BIGINT) AS customer_id, CASE WHEN c_custkey % 2 = 0 THEN 'checking' ELSE 'savings' END AS account_type, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS account_number, c_acctbal AS current_balance, c_nationkey AS nation_id FROM customer)",
    "card": f"card AS (SELECT c_custkey AS card_id, CAST(floor(c_custkey / 2) AS BIGINT) AS customer_id, c_custkey AS account_id, lpad(CAST(c_custkey * 7919 + 4000000000000000 AS VARCHAR), 16, '0') AS card_number, {_sql_cases('c_mktsegment', CARD_STATUS)} AS status FROM customer)",
    "txn": f"txn AS (SELECT o_orderkey AS transaction_id, o_custkey AS account_id, o_totalprice AS amount, o_orderdate AS ts, {_sql_cases('o_orderstatus', TXN_STATUS)} AS status, o_orderpriority AS priority FROM orders)",
    "merchant": "merchant AS (SELECT l_orderkey AS transaction_id, min(l_suppkey) AS merchant_id FROM lineitem GROUP BY l_orderkey)",
    "trace": f"ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events), trace AS (SELECT event_id, ts, user_id, CAST(sum(CASE WHEN prev_ts IS NULL OR ts >= prev_ts + INTERVAL {SESSION_GAP_MIN} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no, event_type AS event, value, k FROM ev)",
    "call": f"kev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), call AS (SELECT event_id AS call_id, ts, user_id AS customer_id, {_sql_cases('event_type', TOOL_OF_EVENT)} AS tool, CASE WHEN k % 10 = 0 THEN user_id + 1 ELSE user_id END AS resource_owner, k % 7 AS resource, user_id % 5 <> 0 AS authenticated, k >= 50 AS confirmed, value > 0.5 AS arguments_valid, k, value FROM kev)",
    "tool": "tool AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {lv}, {str(a).lower()}, {str(c).lower()}, {t}, {str(i).lower()}, {str(u).lower()})" for n, lv, a, c, t, i, u in TOOLS) + ") AS t(tool, level, requires_authentication, requires_confirmation, timeout_ms, idempotent, audited))",
}


def with_views(names: str, body: str) -> str:
    """SQL text: the named views (in order, by spaces) before a query."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + "\n" + body
