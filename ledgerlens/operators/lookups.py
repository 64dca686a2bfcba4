"""The tool layer: lookups scoped to a customer, and the patterns a support agent must tell apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import mask


def scoped(df: DataFrame, owned: DataFrame, key: str = "account_id") -> DataFrame:
    """Only rows whose key the customer owns. Knowing an object's id is never enough."""
    return df.join(owned.select(key).distinct(), key, "left_semi")


def owned_by(accounts: DataFrame, customers: Column) -> DataFrame:
    return accounts.where(customers)


def account_balance(accounts: DataFrame, customer: int, account: int) -> DataFrame:
    return accounts.where((F.col("customer_id") == customer) & (F.col("account_id") == account)).select("account_id", "account_type", "current_balance")


def recent_transactions(txns: DataFrame, n: int) -> DataFrame:
    """The n latest of each account; ties by id."""
    w = Window.partitionBy("account_id").orderBy(F.col("ts").desc(), "transaction_id")
    return txns.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def transaction_details(txns: DataFrame, accounts: DataFrame, cards: DataFrame, merchants: DataFrame) -> DataFrame:
    a = accounts.select("account_id", "customer_id", "account_type")
    c = cards.select("account_id", mask(F.col("card_number")).alias("masked_card"), F.col("status").alias("card_status"))
    return txns.join(a, "account_id").join(c, "account_id", "left").join(merchants, "transaction_id", "left")


def amount_search(txns: DataFrame, amount: float, tolerance: float, first_day: str, last_day: str) -> DataFrame:
    """Transactions near an amount in a span of days (both included)."""
    near = F.col("amount").between(amount - tolerance, amount + tolerance)
    return txns.where(near & (F.col("ts") >= F.lit(first_day).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")))


def ambiguous(candidates: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one candidate: the agent must ask."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("candidates")).where("candidates > 1")


def duplicate_charges(txns: DataFrame, days: int, tolerance: float) -> DataFrame:
    """Pairs of an account's charges with nearly one amount within days. Amounts are dealt into
    cells of the tolerance's width, so that only neighbours meet and no account's rows are paired."""
    cell = F.floor(F.col("amount") / tolerance).cast("long")
    x = txns.select("account_id", F.col("transaction_id").alias("first_id"), F.col("amount").alias("first_amount"), F.col("ts").alias("first_ts"), cell.alias("cell"))
    y = txns.select("account_id", F.col("transaction_id").alias("second_id"), F.col("amount").alias("second_amount"), F.col("ts").alias("second_ts"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    gap = F.abs(F.datediff("second_ts", "first_ts"))
    return x.join(y, ["account_id", "cell"]).where((F.col("first_id") < F.col("second_id")) & (F.abs(F.col("first_amount") - F.col("second_amount")) <= tolerance) & (gap <= days))


def repeated_merchants(txns: DataFrame, merchants: DataFrame) -> DataFrame:
    return txns.join(merchants, "transaction_id").groupBy("account_id", "merchant_id").agg(F.count("*").alias("visits"), F.round(F.sum("amount"), 2).alias("spent")).where("visits > 1")


def status_split(txns: DataFrame) -> DataFrame:
    """One row per account with its amounts by status."""
    of = lambda s: F.count_if(F.col("status") == s)
    return txns.groupBy("account_id").agg(of("PENDING").alias("pending"), of("POSTED").alias("posted"), of("REVERSED").alias("reversed"))


def near_threshold(txns: DataFrame, threshold: float, band: float) -> DataFrame:
    return txns.where((F.col("amount") >= threshold - band) & (F.col("amount") < threshold))


def multi_holders(df: DataFrame, owner: str, thing: str) -> DataFrame:
    return df.groupBy(owner).agg(F.count_distinct(thing).alias("held")).where("held > 1")


def stale(df: DataFrame, ts: str, today: str, days: int) -> DataFrame:
    """Rows older than days on today."""
    return df.withColumn("age_days", F.datediff(F.lit(today).cast("date"), F.col(ts))).where(F.col("age_days") > days)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df and failed, the names of the rules that a row breaks (a rule that is null is broken)."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed", F.array_join(F.array_compact(F.array(*checks)), ","))


def latest_state(initial: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """State by key after an append-only action log: the latest action's state, else the initial."""
    last = actions.groupBy(key).agg(F.max_by("new_status", F.struct("ts", "call_id")).alias("new_status"))
    return initial.join(last, key, "left").withColumn("status_now", F.coalesce("new_status", "status")).drop("new_status")


def open_disputes(transactions: DataFrame, existing: DataFrame) -> DataFrame:
    """One open dispute per transaction (transaction_id, customer_id, reason_code, ts) that has none yet:
    asking twice, or for a disputed transaction, opens no other."""
    fresh = transactions.join(existing.select("transaction_id"), "transaction_id", "left_anti").groupBy("transaction_id").agg(F.min_by(F.struct("customer_id", "reason_code"), "ts").alias("first"), F.min("ts").alias("created_at"))
    return fresh.select(F.concat(F.lit("DSP-"), "transaction_id").alias("dispute_id"), "first.customer_id", "transaction_id", "first.reason_code", F.lit("OPEN").alias("status"), "created_at")


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which some rule doesn't hold (null doesn't), with the names of those rules in their order."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken", F.array_join(found, ",")).where("broken <> ''")
