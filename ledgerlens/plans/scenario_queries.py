"""Scenario evaluation, escalation, limits and error routing over the calls that events stand for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import decisions as D
from ledgerlens.operators import faults as X
from ledgerlens.operators import metrics as M
from ledgerlens.operators import scenarios as S
from ledgerlens.operators import sweeps as W
from ledgerlens.operators import traces as T
from ledgerlens.plans.decision_queries import DECIDED, ERROR_OF_K, decided, decided_sql, session_sql
from ledgerlens.plans.registry import query
from ledgerlens.sources.domain import SQL, calls, tools, trace, with_views
from ledgerlens.sources.scenarios import SCENARIO_SQL, scenarios
from ledgerlens.sources.tables import table


def scenario_sql(body: str) -> str:
    return with_views("call tool", "").rstrip() + ", " + DECIDED + ", " + SCENARIO_SQL + "\n" + body


SUCCEEDED = "len(list_filter(expected, lambda t: NOT list_contains(executed, t))) = 0 AND NOT list_has_any(prohibited, executed)"


def share(condition: str) -> str:
    return f"round(avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END), 6)"


@query("ev1_scenario_success", scenario_sql(f"SELECT category, {share(SUCCEEDED)} AS rate, count(*) AS n FROM scenario GROUP BY ROLLUP (category)"))
def ev1_scenario(spark, d):
    return S.success(scenarios(spark, decided(spark, d)))


@query(
    "ev2_scenario_tool_selection",
    scenario_sql(f"SELECT category, round(avg(len(list_intersect(expected, asked)) / len(expected)), 6) AS selected, {share('list_sort(expected) = list_sort(asked)')} AS exact, count(*) AS n FROM scenario GROUP BY 1"),
)
def ev2_scenario(spark, d):
    return S.tool_selection(scenarios(spark, decided(spark, d)))


@query(
    "ev3_scenario_arguments",
    scenario_sql(
        f"""SELECT category, tool, {share('resource IS NOT DISTINCT FROM customer_id % 7')} AS rate, count(*) AS n
FROM (SELECT customer_id, category, unnest(expected) AS tool FROM scenario) JOIN (SELECT customer_id, tool, first(resource ORDER BY ts, call_id) AS resource FROM call GROUP BY 1, 2) USING (customer_id, tool) GROUP BY 1, 2"""
    ),
)
def ev3_scenario(spark, d):
    x = decided(spark, d)
    return S.argument_accuracy(scenarios(spark, x), x, F.col("customer_id") % 7)


@query("ev18_scenario_violations", scenario_sql("SELECT customer_id, category, array_to_string(list_sort(list_intersect(prohibited, executed)), ',') AS tools FROM scenario WHERE list_has_any(prohibited, executed)"))
def ev18_scenario(spark, d):
    return S.violations(scenarios(spark, decided(spark, d)))


# The eleven reasons by priority, and when each holds of a session (valid in both engines).
REASONS = [
    ("identity_verification_failure", "user_id % 5 = 0", "identity", "high"),
    ("explicit_user_request", "top_k >= 99", "request", "normal"),
    ("ambiguous_high_risk_action", "purchases >= 2", "action", "high"),
    ("repeated_backend_failure", "errors >= 2", "system", "normal"),
    ("unsupported_operation", "errors >= 1", "request", "low"),
    ("suspected_fraud", "top_value > 200", "fraud", "high"),
    ("policy_conflict", "purchases >= 1 AND signups >= 1", "policy", "normal"),
    ("low_confidence", "clicks >= 3", "dialogue", "low"),
    ("security_anomaly", "foreign_calls >= 1", "security", "high"),
    ("severe_frustration", "n_events > 4", "dialogue", "normal"),
    ("degraded_system_state", "tokens > 150", "system", "low"),
]
FEATURES = {
    "n_events": "count(*)",
    "errors": "sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END)",
    "purchases": "sum(CASE WHEN event = 'purchase' THEN 1 ELSE 0 END)",
    "signups": "sum(CASE WHEN event = 'signup' THEN 1 ELSE 0 END)",
    "clicks": "sum(CASE WHEN event = 'click' THEN 1 ELSE 0 END)",
    "foreign_calls": "sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END)",
    "tokens": "sum(k)",
    "top_k": "max(k)",
    "top_value": "max(value)",
    "start_ts": "min(ts)",
    "end_ts": "max(ts)",
}
_FEATURES = ", ".join(f"{e} AS {n}" for n, e in FEATURES.items())
_REASONED = f"""features AS (SELECT user_id, session_no, {_FEATURES} FROM trace GROUP BY 1, 2),
reasoned AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _, _ in REASONS)}], lambda x: x IS NOT NULL) AS reasons FROM features)"""
_CASES = lambda at: " ".join(f"WHEN '{r[0]}' THEN '{r[at]}'" for r in REASONS)


def features(spark, d):
    return trace(spark, d).groupBy("user_id", "session_no").agg(*[F.expr(e).alias(n) for n, e in FEATURES.items()])


def reasoned(spark, d):
    reasons, reason = D.first_reason([(name, F.expr(condition)) for name, condition, _, _ in REASONS])
    return features(spark, d).withColumn("reasons", reasons).withColumn("reason", reason)


def reasoned_sql(body: str) -> str:
    return f"WITH {SQL['trace']}, {_REASONED}\n{body}"


@query("pa11_eleven_reasons", reasoned_sql("SELECT user_id, session_no, array_to_string(reasons, ',') AS reasons, reasons[1] AS reason FROM reasoned"))
def pa11_eleven(spark, d):
    return reasoned(spark, d).select("user_id", "session_no", "reasons", "reason")


@query(
    "tl7_escalate_to_human",
    reasoned_sql(
        f"""SELECT concat('CASE-', user_id, '-', session_no) AS case_id, user_id AS customer_id, session_no AS session_id, CASE reasons[1] {_CASES(2)} END AS category, CASE reasons[1] {_CASES(3)} END AS priority, 'OPEN' AS status,
concat('Escalated after ', n_events, ' events: ', reasons[1]) AS summary, reasons[1] AS handoff_reason, end_ts AS created_at FROM reasoned WHERE len(reasons) > 0 AND NOT (session_no = 1 AND errors > 0)"""
    ),
)
def tl7(spark, d):
    """A support case for each session with a reason, once: sessions with a case already get none. Existing
    cases are those of customers' first sessions in which an error came up."""
    r = reasoned(spark, d)
    existing = r.where("session_no = 1 and errors > 0").select(F.concat(F.lit("CASE-"), "user_id", F.lit("-"), "session_no").alias("case_id"))
    return D.escalate(r, {name: (category, priority) for name, _, category, priority in REASONS}, existing)


@query(
    "pa12_twelve_field_handoff",
    reasoned_sql(
        f""", top AS (SELECT user_id, session_no, max_by(event_id, (value, event_id)) AS transaction_id, max(value) AS transaction_amount FROM trace WHERE event = 'purchase' GROUP BY 1, 2),
acts AS (SELECT user_id, session_no, list_sort(list(DISTINCT event) FILTER (value > 0.5)) AS done, list_sort(list(DISTINCT event)) AS asked, string_agg(event, '>' ORDER BY ts, event_id) AS path FROM trace GROUP BY 1, 2)
SELECT r.user_id AS customer_id, r.user_id % 5 <> 0 AS authenticated, CASE reasons[1] {_CASES(2)} END AS category, CASE reasons[1] {_CASES(3)} END AS priority, concat('Session ', r.session_no, ' of ', n_events, ' events') AS summary, transaction_id, round(transaction_amount, 2) AS transaction_amount,
CASE WHEN transaction_id IS NOT NULL THEN concat('merchant-', transaction_id % 97) END AS merchant, coalesce(array_to_string(done, ','), '') AS actions_completed, array_to_string(list_filter(asked, lambda a: NOT list_contains(coalesce(done, []), a)), ',') AS actions_not_completed, reasons[1] AS reason_for_handoff, path AS conversation_summary
FROM reasoned r LEFT JOIN top USING (user_id, session_no) LEFT JOIN acts USING (user_id, session_no) WHERE len(reasons) > 0"""
    ).replace("\n, top", ", top"),
)
def pa12_twelve(spark, d):
    return handoffs(spark, d)


def handoffs(spark, d):
    t = trace(spark, d)
    bought = F.when(F.col("event") == "purchase", F.struct("value", "event_id"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    acts = t.groupBy("user_id", "session_no").agg(
        F.max(bought).alias("top"), F.collect_set(F.when(F.col("value") > 0.5, F.col("event"))).alias("done"), F.collect_set("event").alias("asked"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event"))).alias("path")
    )
    of = {name: (category, priority) for name, _, category, priority in REASONS}
    r = reasoned(spark, d).where("reason is not null").join(acts, ["user_id", "session_no"], "left")
    return r.select(
        F.col("user_id").alias("customer_id"),
        (F.col("user_id") % 5 != 0).alias("authenticated"),
        D.by_reason(of, 0).alias("category"),
        D.by_reason(of, 1).alias("priority"),
        F.concat(F.lit("Session "), "session_no", F.lit(" of "), "n_events", F.lit(" events")).alias("summary"),
        F.col("top.event_id").alias("transaction_id"),
        F.round("top.value", 2).alias("transaction_amount"),
        F.when(F.col("top").isNotNull(), F.concat(F.lit("merchant-"), F.col("top.event_id") % 97)).alias("merchant"),
        text("done").alias("actions_completed"),
        text(F.array_except("asked", "done")).alias("actions_not_completed"),
        F.col("reason").alias("reason_for_handoff"),
        F.array_join(F.transform("path", lambda s: s["event"]), ">").alias("conversation_summary"),
    )


# The seven limits of the default profile.
LIMITS = {"duration_s": 3600, "turns": 3, "concurrent": 3, "llm_tokens": 150, "tool_retries": 1, "retrievals": 2, "inactivity_s": 1200}


@query(
    "pa15_seven_limits",
    with_views("trace", "").rstrip()
    + """, s AS (SELECT user_id, session_no, min(ts) AS start_ts, max(ts) AS end_ts FROM trace GROUP BY 1, 2), busy AS (SELECT event_id, sum(step) OVER (ORDER BY place, kind RANGE UNBOUNDED PRECEDING) AS concurrent FROM (SELECT NULL AS event_id, start_ts AS place, 0 AS kind, 1 AS step FROM s UNION ALL SELECT NULL, end_ts, 2, -1 FROM s UNION ALL SELECT event_id, ts, 1, 0 FROM trace)),
r AS (SELECT event_id, (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6 AS duration_s, count(*) OVER w AS turns, sum(k) OVER w AS llm_tokens, sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER w AS tool_retries, sum(CASE WHEN event = 'view' THEN 1 ELSE 0 END) OVER w AS retrievals,
  coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id))) / 1e6, 0) AS inactivity_s, concurrent FROM trace JOIN busy USING (event_id) WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT * FROM (SELECT event_id, array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN {n} > {most} THEN '{n}' END" for n, most in LIMITS.items())
    + """], lambda x: x IS NOT NULL), ',') AS exceeded FROM r) WHERE exceeded <> ''""",
)
def pa15_seven(spark, d):
    """Which of the seven limits an event exceeds. Concurrent sessions are those open at its moment."""
    t = trace(spark, d)
    w = Window.partitionBy(*T.SESSION).orderBy("ts", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    busy = W.open_at(T.sessions(t), t.select(F.col("event_id").alias("id"), F.col("ts").alias("at"))).select(F.col("id").alias("event_id"), F.col("open").alias("concurrent"))
    r = t.join(busy, "event_id").select(
        "event_id", "concurrent", ((us(F.col("ts")) - us(F.first("ts").over(so_far))) / 1e6).alias("duration_s"), F.count("*").over(so_far).alias("turns"), F.sum("k").over(so_far).alias("llm_tokens"),
        F.sum(F.when(F.col("event") == "error", 1).otherwise(0)).over(so_far).alias("tool_retries"), F.sum(F.when(F.col("event") == "view", 1).otherwise(0)).over(so_far).alias("retrievals"), F.coalesce((us(F.col("ts")) - us(F.lag("ts").over(w))) / 1e6, F.lit(0.0)).alias("inactivity_s"),
    )
    return D.over_limits(r, LIMITS).select("event_id", "exceeded")


# What a typed error leads to.
ROUTES = [("TransientDependencyError", "retry", "backoff"), ("TimeoutError", "retry", "backoff"), ("ValidationError", "ask_user", "dialogue"), ("AuthorizationError", "deny", "security_log"), ("NotFoundError", "clarify", "dialogue"), ("ConflictError", "ask_user", "reload_state")]


@query(
    "pa10_error_routes",
    with_views("call tool", "").rstrip() + ", " + DECIDED + f""", failed AS (SELECT call_id, tool, {ERROR_OF_K} AS error FROM outcomes WHERE outcome = 'denied'), route AS (SELECT * FROM (VALUES {', '.join(str(r) for r in ROUTES)}) AS t(error, action, handler))
SELECT call_id, tool, error, action, handler FROM failed LEFT JOIN route USING (error)""",
)
def pa10_routes(spark, d):
    """Each denied call's typed error, by a broadcast join with the route table."""
    failed = decided(spark, d).where("outcome = 'denied'").select("call_id", "tool", F.expr(ERROR_OF_K).alias("error"))
    return failed.join(F.broadcast(spark.createDataFrame(ROUTES, "error string, action string, handler string")), "error", "left").select("call_id", "tool", "error", "action", "handler")


FAULTS = [name for name, _, _ in X.FAULTS]
_FAULT = "CASE k % 9 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAULTS)) + " END"


@query("ev23_nine_faults", decided_sql(f"SELECT fault, {share('coalesce(after, false)')} AS recovered, count(*) AS n FROM (SELECT {_FAULT} AS fault, outcome, lead(outcome = 'executed') OVER (PARTITION BY customer_id ORDER BY ts, call_id) AS after FROM outcomes) WHERE outcome <> 'executed' GROUP BY 1"))
def ev23_nine(spark, d):
    """Calls that weren't executed stand for injected faults; one is recovered from if the customer's next call is executed."""
    x = decided(spark, d).withColumn("after", F.lead(F.col("outcome") == "executed").over(Window.partitionBy("customer_id").orderBy("ts", "call_id")))
    return M.rate(x.where("outcome <> 'executed'").withColumn("fault", F.expr(_FAULT)), F.col("after"), ["fault"], "recovered")


_ENDS = "CASE fault_no " + " ".join(f"WHEN {i} THEN '{ends}'" for i, (_, _, ends) in enumerate(X.FAULTS)) + " END"
_NAMES = "CASE fault_no " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAULTS)) + " END"


@query(
    "ev23_injected_faults",
    decided_sql(
        f""", reply AS (SELECT call_id, lead(ts) OVER w <= ts + INTERVAL 1 DAY AS answered, lead(confirmed) OVER w AS yes FROM call WINDOW w AS (PARTITION BY customer_id ORDER BY ts, call_id)), drawn AS (SELECT *, CAST('0x' || substr(md5(CAST(call_id AS VARCHAR)), 1, 8) AS BIGINT) AS n FROM outcomes),
f AS (SELECT call_id, outcome, requires_confirmation, confirmed, fault, ends, fails, coalesce(answered, false) AS answered, coalesce(answered AND yes, false) AS yes FROM (SELECT *, {_NAMES} AS fault, {_ENDS} AS ends FROM (SELECT *, n // 10 % 9 AS fault_no, 1 + n // 90 % 4 AS fails FROM drawn WHERE n % 10 < 3)) JOIN reply USING (call_id) WHERE fault <> 'stale_confirmation' OR (coalesce(requires_confirmation, false) AND confirmed)),
g AS (SELECT *, CASE WHEN ends = 'transient' THEN fails <= 2 WHEN ends = 'duplicate' THEN true WHEN fault = 'retrieval_empty' THEN answered WHEN fault = 'invalid_transaction_id' THEN answered OR outcome = 'denied' ELSE outcome <> 'executed' OR yes END AS ok FROM f)
SELECT fault, count(*) AS n, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS recovered, CAST(sum(CASE WHEN ends = 'transient' THEN least(fails + 1, 3) WHEN ends = 'dialogue' AND NOT answered THEN 1 ELSE 2 END) AS BIGINT) AS attempts,
count(*) FILTER (ends = 'transient' AND fails > 2) AS escalated, count(*) FILTER (ok AND outcome = 'executed') AS effects FROM g GROUP BY 1"""
    ).replace("\n, reply", ", reply"),
)
def ev23_injected(spark, d):
    """Faults injected into three tenths of the calls; a question is answered by the customer's next call within a day."""
    c = calls(spark, d)
    w = Window.partitionBy("customer_id").orderBy("ts", "call_id")
    replies = c.select("call_id", "ts", F.lead("ts").over(w).alias("_next"), F.lead("confirmed").over(w).alias("reply_confirms")).where("_next <= ts + INTERVAL 1 DAY").select("call_id", "reply_confirms")
    return X.recovery(X.attempts(X.inject(c, tools(spark)), replies, tools(spark)), decided(spark, d)).drop("doubled")


@query(
    "ev24_seven_cards",
    scenario_sql(
        f""", c AS (SELECT {share("outcome = 'executed'")} AS tool_accuracy, round(avg(value), 6) AS mean_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency, count(*) FILTER (outcome = 'executed' AND resource_owner <> customer_id) AS safety_violations, {share("tool = 'export_ledger'")} AS escalation_rate FROM outcomes)
SELECT {share(SUCCEEDED)} AS completion_rate, any_value(mean_latency) AS mean_latency, any_value(p95_latency) AS p95_latency, any_value(tool_accuracy) AS tool_accuracy, any_value(escalation_rate) AS escalation_rate, any_value(safety_violations) AS safety_violations, round(avg(tokens), 6) AS cost_per_session FROM scenario, c"""
    ).replace("\n, c AS", ", c AS"),
)
def ev24_seven(spark, d):
    """The seven dashboard cards: two one-row aggregates side by side."""
    x = decided(spark, d)
    mean = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    c = x.agg(
        mean(F.col("outcome") == "executed").alias("tool_accuracy"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95_latency"),
        F.count_if((F.col("outcome") == "executed") & (F.col("resource_owner") != F.col("customer_id"))).alias("safety_violations"), mean(F.col("tool") == "export_ledger").alias("escalation_rate"), F.lit(1).alias("one"),
    )
    s = scenarios(spark, x).agg(mean(S.succeeded()).alias("completion_rate"), F.round(F.avg("tokens"), 6).alias("cost_per_session"), F.lit(1).alias("one"))
    return s.join(c, "one").drop("one")


_MESSAGE = "concat(tool, ' of resource ', resource, ' of customer ', resource_owner, ' stopped at ', failed_layer)"


@query("ev26_signature_clusters", decided_sql(f"SELECT signature, count(*) AS n, count(DISTINCT customer_id) AS customers, min(call_id) AS example FROM (SELECT *, regexp_replace({_MESSAGE}, '[0-9]+', '#', 'g') AS signature FROM outcomes WHERE failed_layer IS NOT NULL) GROUP BY 1"))
def ev26_signatures(spark, d):
    """Failures by message with its numbers taken out."""
    x = decided(spark, d).where("failed_layer is not null").withColumn("signature", F.regexp_replace(F.expr(_MESSAGE), "[0-9]+", "#"))
    return x.groupBy("signature").agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("customers"), F.min("call_id").alias("example"))


@query("ev29_cheapest_model", with_views("trace", "").rstrip() + """, runs AS (SELECT event AS task, k % 3 AS model, round(avg(CASE WHEN value < 100 THEN 1e0 ELSE 0e0 END), 6) AS success, round(avg(k::DOUBLE), 6) AS cost FROM trace GROUP BY 1, 2)
SELECT task, count(*) AS models, first(model ORDER BY cost, model) FILTER (success >= 0.6) AS model, min(cost) FILTER (success >= 0.6) AS cost FROM runs GROUP BY 1""")
def ev29_cheapest(spark, d):
    """For each task the cheapest model that succeeds in at least 60 %."""
    ok = F.avg(F.when(F.col("value") < 100, 1.0).otherwise(0.0))
    runs = trace(spark, d).groupBy(F.col("event").alias("task"), (F.col("k") % 3).alias("model")).agg(F.round(ok, 6).alias("success"), F.round(F.avg(F.col("k").cast("double")), 6).alias("cost"))
    return S.cheapest(runs, ["task"], 0.6)


_MODELS = [("length_rule", "n_chars > 2000", "1", "n_chars / 1000e0"), ("language_rule", "lang <> 'en'", "0", "1e0"), ("digit_rule", "text LIKE '%0%'", "2", "n_chars / 500e0")]


@query(
    "ev21_model_comparison",
    "WITH m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {p} AS p, quality = 1 AS a, {c} AS cost, {l} AS ms FROM documents JOIN labels USING (doc_id)" for m, p, c, l in _MODELS) + """), g AS (SELECT model, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn, round(avg(ms), 6) AS mean_ms, CAST(sum(cost) AS BIGINT) AS cost FROM m GROUP BY model)
SELECT model, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6) AS accuracy, mean_ms, cost FROM g""",
)
def ev21_models(spark, d):
    """Three rules as classifiers of the quality label, with stand-ins for latency and cost; one pass."""
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text").join(table(spark, d, "labels"), "doc_id")
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(p).alias("p"), F.expr(c).cast("long").alias("cost"), F.expr(latency).alias("ms")) for m, p, c, latency in _MODELS]))
    r = x.select((F.col("quality") == 1).alias("a"), runs.alias("r")).select("a", "r.*")
    counts = M.confusion(r, F.col("p"), F.col("a"), ["model"])
    return counts.join(r.groupBy("model").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.sum("cost").alias("cost")), "model")


@query("lt8_tool_errors_retries", decided_sql("SELECT tool, count(*) AS n, count(*) FILTER (outcome = 'denied') AS errors, count(*) FILTER (again) AS retries, count(*) FILTER (again AND outcome = 'executed') AS recovered FROM (SELECT *, coalesce(lag(outcome = 'denied') OVER (PARTITION BY customer_id, tool ORDER BY ts, call_id), false) AS again FROM outcomes) GROUP BY 1"))
def lt8_retries(spark, d):
    """A call is a retry if the customer's call of the same tool before it was denied."""
    before = F.lag(F.col("outcome") == "denied").over(Window.partitionBy("customer_id", "tool").orderBy("ts", "call_id"))
    x = decided(spark, d).withColumn("again", F.coalesce(before, F.lit(False)))
    return x.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "denied").alias("errors"), F.count_if("again").alias("retries"), F.count_if(F.col("again") & (F.col("outcome") == "executed")).alias("recovered"))


# A session's state after an event, and the changes that are allowed (our policy; none is specified).
STATE = "CASE event WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'USER_SPEAKING' WHEN 'purchase' THEN 'WAITING_FOR_CONFIRMATION' WHEN 'signup' THEN 'LISTENING' ELSE 'INTERRUPTED' END"
ALLOWED = [("LISTENING", "USER_SPEAKING"), ("USER_SPEAKING", "PROCESSING"), ("PROCESSING", "WAITING_FOR_CONFIRMATION"), ("PROCESSING", "LISTENING"), ("PROCESSING", "INTERRUPTED"), ("WAITING_FOR_CONFIRMATION", "USER_SPEAKING"), ("WAITING_FOR_CONFIRMATION", "INTERRUPTED"), ("INTERRUPTED", "LISTENING"), ("INTERRUPTED", "USER_SPEAKING")]


@query(
    "lt11_invalid_transitions",
    with_views("trace", "").rstrip() + f""", st AS (SELECT event_id, {STATE} AS to_state, lag({STATE}) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS from_state FROM trace), ok AS (SELECT * FROM (VALUES {', '.join(str(a) for a in ALLOWED)}) AS t(from_state, to_state))
SELECT event_id, from_state, to_state FROM st WHERE from_state IS NOT NULL AND from_state <> to_state AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.from_state = st.from_state AND ok.to_state = st.to_state)""",
)
def lt11_invalid(spark, d):
    t = T.transitions(trace(spark, d).withColumn("event", F.expr(STATE))).select("event_id", "from_state", F.col("event").alias("to_state")).where("from_state <> to_state")
    allowed = spark.createDataFrame(ALLOWED, "from_state string, to_state string")
    return t.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti").select("event_id", "from_state", "to_state")


@query(
    "lt12_session_replay",
    with_views("trace", f"SELECT user_id, session_no, CAST(row_number() OVER w AS INTEGER) AS sequence, event_id, {STATE} AS state, CAST(sum(k) OVER w AS BIGINT) AS tokens, last_value(CASE WHEN event = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_request FROM trace WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
)
def lt12_replay(spark, d):
    """Every session's events in order, with the state, tokens and last request so far."""
    w = Window.partitionBy(*T.SESSION).orderBy("ts", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return trace(spark, d).select("user_id", "session_no", F.row_number().over(w).alias("sequence"), "event_id", F.expr(STATE).alias("state"), F.sum("k").over(so_far).alias("tokens"), F.last(F.when(F.col("event") == "purchase", F.col("event_id")), True).over(so_far).alias("last_request"))


@query("ev10_recovery_after_cancel", with_views("trace", "").rstrip() + f""", o AS (SELECT *, last_value(CASE WHEN event = 'purchase' THEN 'request' WHEN event IN ('click', 'error') THEN 'closed' END IGNORE NULLS) OVER b AS before, lead(event) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS nxt, lead(ts) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS nxt_ts FROM trace WINDOW b AS (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT coalesce(before = 'request', false) AS was_pending, count(*) AS interruptions, {share("nxt IN ('view', 'click', 'signup')")} AS recovered, round(avg((epoch_us(nxt_ts) - epoch_us(ts)) / 1e6), 3) AS mean_s FROM o WHERE event = 'error' GROUP BY 1""")
def ev10_recovery(spark, d):
    """Interruptions (errors), by whether a request was open and so cancelled. One is recovered from if the
    session goes on with anything but a new request or another interruption; mean_s is the time to it."""
    w = Window.partitionBy(*T.SESSION).orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    mark = F.when(F.col("event") == "purchase", "request").when(F.col("event").isin("click", "error"), "closed")
    t = trace(spark, d).withColumn("before", F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nxt", F.lead("event").over(w)).withColumn("wait", (us(F.lead("ts").over(w)) - us(F.col("ts"))) / 1e6)
    good = F.coalesce(F.col("nxt").isin("view", "click", "signup"), F.lit(False))
    return t.where("event = 'error'").groupBy(F.coalesce(F.col("before") == "request", F.lit(False)).alias("was_pending")).agg(F.count("*").alias("interruptions"), F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 6).alias("recovered"), F.round(F.avg("wait"), 3).alias("mean_s"))


@query(
    "tl6_dispute_transactions",
    with_views("txn account", "SELECT concat('DSP-', transaction_id) AS dispute_id, customer_id, transaction_id, CASE WHEN amount > 200000 THEN 'amount' ELSE 'unrecognized' END AS reason_code, 'OPEN' AS status, ts AS created_at FROM txn JOIN account USING (account_id) WHERE status = 'POSTED' AND amount > 100000 AND transaction_id % 10 <> 0"),
)
def tl6_transactions(spark, d):
    """Disputes of posted transactions over 100,000 by the account's owner; transactions disputed already
    (ids divisible by 10) get none, whatever is asked."""
    from ledgerlens.operators.lookups import open_disputes
    from ledgerlens.sources.domain import accounts, transactions

    t = transactions(spark, d).where("status = 'POSTED' and amount > 100000")
    existing = transactions(spark, d).where("transaction_id % 10 = 0").select("transaction_id")
    owned = t.join(accounts(spark, d).select("account_id", "customer_id"), "account_id")
    return open_disputes(owned.withColumn("reason_code", F.when(F.col("amount") > 200000, "amount").otherwise("unrecognized")), existing)


@query(
    "tl4_own_card_status",
    with_views("card call", "SELECT DISTINCT customer_id, card_id, status FROM card WHERE customer_id IN (SELECT customer_id FROM call WHERE authenticated)"),
)
def tl4_own(spark, d):
    """The cards of authenticated customers only: a card is found by its owner, never by its id alone."""
    from ledgerlens.operators.lookups import scoped
    from ledgerlens.sources.domain import cards

    return scoped(cards(spark, d), calls(spark, d).where("authenticated"), "customer_id").select("customer_id", "card_id", "status").distinct()


@query("tl23_rejects", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT (o_totalprice > 1000) THEN 'amount' END, CASE WHEN NOT (o_orderstatus IN ('F', 'O')) THEN 'status' END, CASE WHEN NOT (o_orderpriority IS NOT NULL AND o_orderpriority <> '5-LOW') THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders WHERE NOT (o_totalprice > 1000) OR NOT (o_orderstatus IN ('F', 'O')) OR NOT (o_orderpriority IS NOT NULL AND o_orderpriority <> '5-LOW')")
def tl23_rejects(spark, d):
    """Rows that break a rule, with the rules they break."""
    from ledgerlens.operators.lookups import rejects

    rules = {"amount": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "priority": F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "5-LOW")}
    return rejects(table(spark, d, "orders"), rules).select("o_orderkey", "broken")


# The demo profile.
DEMO = {"most_customer": 100, "calls_an_hour": 2, "tools": ["export_ledger"]}


@query(
    "pa20_demo_profile",
    decided_sql(
        f"""SELECT call_id, CASE WHEN customer_id >= {DEMO['most_customer']} THEN 'not_a_demo_customer' WHEN tool IN ('export_ledger') THEN 'tool_off' WHEN in_hour > {DEMO['calls_an_hour']} THEN 'rate' WHEN outcome <> 'executed' THEN failed_layer END AS refused_by
FROM (SELECT *, count(*) OVER (PARTITION BY customer_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_hour FROM outcomes)"""
    ),
)
def pa20_profile(spark, d):
    """Every call under the demo profile (one configuration row, broadcast), with the rule that refuses it."""
    profile = spark.createDataFrame([tuple(DEMO.values())], "most_customer long, calls_an_hour long, tools_off array<string>")
    w = Window.partitionBy("customer_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    x = decided(spark, d).withColumn("in_hour", F.count("*").over(w)).withColumn("profile", F.lit(1)).join(F.broadcast(profile.withColumn("profile", F.lit(1))), "profile")
    refused = F.when(F.col("customer_id") >= F.col("most_customer"), "not_a_demo_customer").when(F.array_contains("tools_off", F.col("tool")), "tool_off").when(F.col("in_hour") > F.col("calls_an_hour"), "rate").when(F.col("outcome") != "executed", F.col("failed_layer"))
    return x.select("call_id", refused.alias("refused_by"))


__all__ = ["calls", "handoffs", "session_sql"]
