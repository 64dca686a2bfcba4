"""Tool-layer queries over accounts, cards and transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.text import mask, redact
from ledgerlens.operators import lookups as L
from ledgerlens.plans.registry import query
from ledgerlens.sources.domain import accounts, calls, cards, merchants, transactions, with_views
from ledgerlens.sources.tables import table


@query("tl1_balance", with_views("account", "SELECT account_id, account_type, current_balance FROM account WHERE customer_id = 7 AND account_id = 14"))
def tl1(spark, d):
    return L.account_balance(accounts(spark, d), 7, 14)


@query(
    "tl2_recent_txns",
    with_views(
        "txn",
        """SELECT account_id, transaction_id, amount, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id) AS INTEGER) AS recency FROM txn) WHERE recency <= 5""",
    ),
)
def tl2(spark, d):
    return L.recent_transactions(transactions(spark, d), 5).select("account_id", "transaction_id", "amount", "recency")


@query(
    "tl3_txn_details",
    with_views(
        "account card txn merchant",
        """SELECT t.transaction_id, t.account_id, customer_id, amount, t.status, '****' || right(card_number, 4) AS masked_card, c.status AS card_status, merchant_id
FROM txn t JOIN account a USING (account_id) LEFT JOIN card c USING (account_id) LEFT JOIN merchant m USING (transaction_id)""",
    ).replace("customer_id, amount", "a.customer_id, amount"),
)
def tl3(spark, d):
    t = L.transaction_details(transactions(spark, d), accounts(spark, d), cards(spark, d), merchants(spark, d))
    return t.select("transaction_id", "account_id", "customer_id", "amount", "status", "masked_card", "card_status", "merchant_id")


@query("tl4_card_status", with_views("card", "SELECT card_id, customer_id, '****' || right(card_number, 4) AS masked_card, status FROM card"))
def tl4(spark, d):
    return cards(spark, d).select("card_id", "customer_id", mask(F.col("card_number")).alias("masked_card"), "status")


@query(
    "tl5_freeze_card",
    with_views(
        "card call",
        """, last AS (SELECT customer_id AS card_id, max(row(ts, call_id)) AS m FROM call WHERE tool = 'freeze_card' AND authenticated AND confirmed AND resource_owner = customer_id GROUP BY 1)
SELECT card_id, status, CASE WHEN m IS NULL THEN status WHEN status IN ('ACTIVE', 'FROZEN') THEN 'FROZEN' ELSE status END AS status_now FROM card LEFT JOIN last USING (card_id)""",
    ).replace("\n, last", ", last"),
)
def tl5(spark, d):
    """Freezes are appended actions; a card's state is that of its latest action. Cards that are
    lost, stolen or closed stay so."""
    c = calls(spark, d).where((F.col("tool") == "freeze_card") & F.col("authenticated") & F.col("confirmed") & (F.col("resource_owner") == F.col("customer_id")))
    actions = c.select(F.col("customer_id").alias("card_id"), "ts", "call_id", F.lit("FROZEN").alias("new_status"))
    now = L.latest_state(cards(spark, d).select("card_id", "status"), actions, "card_id")
    return now.withColumn("status_now", F.when(F.col("status").isin("ACTIVE", "FROZEN"), F.col("status_now")).otherwise(F.col("status")))


@query(
    "tl6_create_dispute",
    with_views(
        "txn account call",
        """, ask AS (SELECT customer_id, resource, min(row(ts, call_id)) AS m, count(*) AS requests FROM call WHERE tool = 'create_dispute' AND authenticated AND confirmed AND resource_owner = customer_id GROUP BY 1, 2)
SELECT customer_id, resource, struct_extract(m, 2) AS call_id, requests FROM ask""",
    ).replace("\n, ask", ", ask"),
)
def tl6(spark, d):
    """Repeated requests for one resource make one dispute: the first."""
    c = calls(spark, d).where((F.col("tool") == "create_dispute") & F.col("authenticated") & F.col("confirmed") & (F.col("resource_owner") == F.col("customer_id")))
    return c.groupBy("customer_id", "resource").agg(F.min_by("call_id", F.struct("ts", "call_id")).alias("call_id"), F.count("*").alias("requests"))


@query("tl8_profile", with_views("account", "SELECT customer_id, count(*) AS accounts, '****' || right(min(account_number), 4) AS first_account FROM account GROUP BY customer_id"))
def tl8(spark, d):
    return accounts(spark, d).groupBy("customer_id").agg(F.count("*").alias("accounts"), mask(F.min("account_number")).alias("first_account"))


@query("tl9_list_accounts", with_views("account", "SELECT account_id, account_type FROM account WHERE customer_id = 11"))
def tl9(spark, d):
    return accounts(spark, d).where("customer_id = 11").select("account_id", "account_type")


@query("tl10_list_cards", with_views("card", "SELECT card_id, status FROM card WHERE customer_id = 11"))
def tl10(spark, d):
    return cards(spark, d).where("customer_id = 11").select("card_id", "status")


@query("tl11_scoped", with_views("txn account", "SELECT transaction_id, account_id, amount FROM txn WHERE account_id IN (SELECT account_id FROM account WHERE customer_id % 10 = 3)"))
def tl11(spark, d):
    owned = L.owned_by(accounts(spark, d), F.col("customer_id") % 10 == 3)
    return L.scoped(transactions(spark, d), owned).select("transaction_id", "account_id", "amount")


@query("tl12_amount_search", with_views("txn", "SELECT transaction_id, account_id, amount FROM txn WHERE amount BETWEEN 199000 AND 201000 AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'"))
def tl12(spark, d):
    return L.amount_search(transactions(spark, d), 200000.0, 1000.0, "1996-01-01", "1998-12-31").select("transaction_id", "account_id", "amount")


@query("tl13_ambiguous", with_views("txn", "SELECT account_id, strftime(ts, '%Y-%m') AS month_start, count(*) AS candidates FROM txn GROUP BY 1, 2 HAVING count(*) > 1"))
def tl13(spark, d):
    t = transactions(spark, d).withColumn("month_start", F.date_format("ts", "yyyy-MM"))
    return L.ambiguous(t, "account_id", "month_start")


@query(
    "tl14_dup_charges",
    with_views(
        "txn",
        """SELECT a.account_id, a.transaction_id AS first_id, b.transaction_id AS second_id FROM txn a JOIN txn b ON a.account_id = b.account_id AND a.transaction_id < b.transaction_id
WHERE abs(a.amount - b.amount) <= 2500 AND abs(date_diff('day', a.ts, b.ts)) <= 90""",
    ),
)
def tl14(spark, d):
    return L.duplicate_charges(transactions(spark, d), 90, 2500.0).select("account_id", "first_id", "second_id")


@query(
    "tl15_repeat_merchants",
    with_views("txn merchant", "SELECT account_id, merchant_id, count(*) AS visits, round(sum(amount), 2) AS spent FROM txn JOIN merchant USING (transaction_id) GROUP BY 1, 2 HAVING count(*) > 1"),
)
def tl15(spark, d):
    return L.repeated_merchants(transactions(spark, d), merchants(spark, d))


@query(
    "tl16_status_split",
    with_views("txn", "SELECT account_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'POSTED') AS posted, count(*) FILTER (status = 'REVERSED') AS reversed FROM txn GROUP BY 1"),
)
def tl16(spark, d):
    return L.status_split(transactions(spark, d))


@query(
    "tl17_out_of_region",
    with_views(
        "account txn merchant",
        """SELECT t.transaction_id, a.account_id, n1.n_regionkey AS home_region, n2.n_regionkey AS merchant_region
FROM txn t JOIN account a USING (account_id) JOIN merchant m USING (transaction_id) JOIN supplier s ON m.merchant_id = s.s_suppkey
JOIN nation n1 ON a.nation_id = n1.n_nationkey JOIN nation n2 ON s.s_nationkey = n2.n_nationkey WHERE n1.n_regionkey <> n2.n_regionkey""",
    ),
)
def tl17(spark, d):
    nation = table(spark, d, "nation")
    home = nation.select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("home_region"))
    far = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("merchant_region"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("merchant_id"), "s_nationkey").join(far, "s_nationkey")
    t = transactions(spark, d).join(accounts(spark, d).join(home, "nation_id"), "account_id").join(merchants(spark, d), "transaction_id").join(sup, "merchant_id")
    return t.where("home_region <> merchant_region").select("transaction_id", "account_id", "home_region", "merchant_region")


@query("tl18_near_threshold", with_views("txn", "SELECT transaction_id, amount FROM txn WHERE amount >= 95000 AND amount < 100000"))
def tl18(spark, d):
    return L.near_threshold(transactions(spark, d), 100000.0, 5000.0).select("transaction_id", "amount")


@query("tl19_multi_holders", with_views("account", "SELECT customer_id, count(DISTINCT account_id) AS held FROM account GROUP BY 1 HAVING count(DISTINCT account_id) > 1"))
def tl19(spark, d):
    return L.multi_holders(accounts(spark, d), "customer_id", "account_id")


@query("tl20_stale", with_views("txn", "SELECT transaction_id, date_diff('day', ts::DATE, DATE '1999-01-01')::INTEGER AS age_days FROM txn WHERE status = 'PENDING' AND date_diff('day', ts::DATE, DATE '1999-01-01') > 365"))
def tl20(spark, d):
    return L.stale(transactions(spark, d).where("status = 'PENDING'"), "ts", "1999-01-01", 365).select("transaction_id", "age_days")


@query("tl21_mask", with_views("account card", "SELECT a.account_id, '****' || right(account_number, 4) AS masked_account, '****' || right(card_number, 4) AS masked_card FROM account a JOIN card c USING (account_id)"))
def tl21(spark, d):
    a, c = accounts(spark, d), cards(spark, d).select("account_id", "card_number")
    return a.join(c, "account_id").select("account_id", mask(F.col("account_number")).alias("masked_account"), mask(F.col("card_number")).alias("masked_card"))


@query(
    "tl22_redact",
    "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[email]', 'g'), '[0-9]{9,}', '[number]', 'g')) AS redacted_md5 FROM documents",
)
def tl22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(redact(F.col("text"))).alias("redacted_md5"))


@query(
    "tl23_validate",
    with_views(
        "txn",
        """SELECT transaction_id, array_to_string(list_filter([CASE WHEN NOT amount < 450000 THEN 'amount' END, CASE WHEN status NOT IN ('PENDING', 'POSTED') THEN 'status' END], lambda x: x IS NOT NULL), ',') AS failed FROM txn""",
    ),
)
def tl23(spark, d):
    rules = {"amount": F.col("amount") < 450000, "status": F.col("status").isin("PENDING", "POSTED")}
    return L.validate(transactions(spark, d), rules).select("transaction_id", "failed")
