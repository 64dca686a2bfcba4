"""Permission, confirmation and action pipeline. No decision takes a column of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What to do by typed error.
RETRY = {"TransientDependencyError": "retry", "TimeoutError": "retry", "ValidationError": "ask_user", "AuthorizationError": "deny", "NotFoundError": "clarify", "ConflictError": "ask_user"}


def enrich(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with their tool's metadata; calls of unknown tools have nulls. The catalogue is broadcast."""
    return calls.join(F.broadcast(tools), "tool", "left")


def not_allowlisted(calls: DataFrame, tools: DataFrame) -> DataFrame:
    return calls.join(F.broadcast(tools.select("tool")), "tool", "left_anti")


def permit(level: Column, authenticated: Column, confirmed: Column) -> Column:
    """Level 1 always; 2 if authenticated; 3 if authenticated and confirmed; else not."""
    return F.coalesce(F.when(level == 1, F.lit(True)).when(level == 2, authenticated).when(level == 3, authenticated & confirmed), F.lit(False))


def decide(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Each call with outcome and, where it isn't executed, the first layer that failed."""
    failed = (
        F.when(F.col("level").isNull(), "allowlist")
        .when(F.col("requires_authentication") & ~F.col("authenticated"), "authentication")
        .when(F.col("requires_authentication") & (F.col("resource_owner") != F.col("customer_id")), "ownership")
        .when(~F.col("arguments_valid"), "arguments")
        .when(F.col("requires_confirmation") & ~F.col("confirmed"), "confirmation")
    )
    out = enrich(calls, tools).withColumn("failed_layer", failed)
    waits = F.col("failed_layer") == "confirmation"
    return out.withColumn("outcome", F.when(F.col("failed_layer").isNull(), "executed").when(waits, "confirm").otherwise("denied"))


def match_confirmations(events: DataFrame, key: str, is_request: Column, is_answer: Column) -> DataFrame:
    """Each answer with the open request it binds to, and turns since: the latest request before it in its
    session, unless another answer came in between, as an answer closes the request."""
    w = Window.partitionBy(key).orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    seq = F.row_number().over(Window.partitionBy(key).orderBy("ts", "call_id"))
    e = events.withColumn("turn", seq)
    marks = F.when(is_request, F.struct("call_id", "turn")).when(is_answer, F.struct(F.lit(None).cast("long").alias("call_id"), F.lit(None).cast("int").alias("turn")))
    e = e.withColumn("mark", F.last(marks, True).over(w)).withColumn("request_id", F.col("mark.call_id")).withColumn("request_turn", F.col("mark.turn"))
    return e.where(is_answer).withColumn("turns_since", F.col("turn") - F.col("request_turn"))


def expired(turns_since: Column, n: int = 3) -> Column:
    """No request, or one that is more than n turns old."""
    return turns_since.isNull() | (turns_since > n)


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent writes: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def retry_action(error: Column, attempt: Column, most: int = 2) -> Column:
    action = F.lit("escalate")
    for name, what in RETRY.items():
        action = F.when(error == name, F.when(F.lit(what == "retry") & (attempt > most), "escalate").otherwise(what)).otherwise(action)
    return action


def first_reason(rules: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """All reasons that hold, in order of priority, and the first."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))
    return F.array_join(found, ","), F.try_element_at(found, F.lit(1))


def audit(decided: DataFrame) -> DataFrame:
    """One record per audited customer, tool and resource: first requested, confirmed and executed."""
    return decided.where("audited").groupBy("customer_id", "tool", "resource").agg(
        F.min("ts").alias("requested_at"),
        F.min(F.when(F.col("confirmed"), F.col("ts"))).alias("confirmed_at"),
        F.min(F.when(F.col("outcome") == "executed", F.col("ts"))).alias("executed_at"),
        F.count("*").alias("requests"),
    )


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(amount).over(w))


def rate_limited(df: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Rows that come when more than most rows of their key, themselves included, lie in the last
    seconds. Ties in time count together."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > most)


def by_reason(of: dict[str, tuple[str, str]], at: int) -> Column:
    """The category (0) or priority (1) of the column reason."""
    out = F.lit(None).cast("string")
    for name, values in of.items():
        out = F.when(F.col("reason") == name, values[at]).otherwise(out)
    return out


def escalate(sessions: DataFrame, of: dict[str, tuple[str, str]], existing: DataFrame) -> DataFrame:
    """Support cases of sessions with a reason: sessions has user_id, session_no, n_events, end_ts, reason;
    of gives each reason's category and priority. Sessions whose case_id exists get no second case."""
    cases = sessions.where("reason is not null").select(
        F.concat(F.lit("CASE-"), "user_id", F.lit("-"), "session_no").alias("case_id"),
        F.col("user_id").alias("customer_id"),
        F.col("session_no").alias("session_id"),
        by_reason(of, 0).alias("category"),
        by_reason(of, 1).alias("priority"),
        F.lit("OPEN").alias("status"),
        F.concat(F.lit("Escalated after "), "n_events", F.lit(" events: "), "reason").alias("summary"),
        F.col("reason").alias("handoff_reason"),
        F.col("end_ts").alias("created_at"),
    )
    return cases.join(existing.select("case_id"), "case_id", "left_anti")


def over_limits(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows that exceed a limit, with the names of those they exceed, in the limits' order. Each limit is a
    column's greatest allowed value."""
    found = F.array_compact(F.array(*[F.when(F.col(n) > most, F.lit(n)) for n, most in limits.items()]))
    return df.withColumn("exceeded", F.array_join(found, ",")).where("exceeded <> ''")


def confirmation_chain(actions: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Each execution in a log of what was done, with its fault; null where it had a valid confirmation.

    actions: keys, ts, event_id, role (request, answer, execution), affirmed (of answers). An execution is
    valid if, of its keys' actions, the last before it is an affirmative answer, at most that many seconds old,
    and the one before that is the request. So a confirmation serves one execution. Nulls of affirmed refuse."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    a = actions.withColumn("_role", F.lag("role").over(w)).withColumn("_asked", F.lag("role", 2).over(w)).withColumn("_yes", F.lag("affirmed").over(w)).withColumn("_at", F.lag("ts").over(w))
    fault = (
        F.when(F.col("_role").isNull(), "unasked")
        .when(F.col("_role") == "execution", "reused")
        .when(F.col("_role") == "request", "unanswered")
        .when(~F.coalesce("_yes", F.lit(False)), "refused")
        .when(F.coalesce(F.col("_asked") != "request", F.lit(True)), "unasked")
        .when(us(F.col("ts")) - us(F.col("_at")) > seconds * 1_000_000, "expired")
    )
    return a.where("role = 'execution'").withColumn("fault", fault).select(*actions.columns, "fault")
