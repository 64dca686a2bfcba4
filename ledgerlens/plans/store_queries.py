"""Stores and sinks written and read back, retrieval with metadata, and the provider surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import decisions as D
from ledgerlens.operators import providers as P
from ledgerlens.operators import retrieval as R
from ledgerlens.plans.decision_queries import decided, decided_sql
from ledgerlens.plans.registry import ORACLES, query
from ledgerlens.plans.retrieval_queries import BM25, LETTERS, _COUNTS, letter_model, questions
from ledgerlens.plans.scenario_queries import handoffs
from ledgerlens.sources import stores
from ledgerlens.sources.domain import accounts, tools, transactions, with_views
from ledgerlens.sources.scenarios import SCENARIO_SQL, scenarios
from ledgerlens.sources.scratch import new_folder
from ledgerlens.sources.tables import table
from ledgerlens.sources.voice import stage_sql, voice_stages


@query(
    "io2_policy_documents",
    "SELECT source, lang, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2",
)
def io2(spark, d):
    """Documents as policy files, one JSON line each in folders by category, and read as documents again."""
    path = new_folder(spark, "policies")
    table(spark, d, "documents").select("doc_id", "source", "lang", "text").write.partitionBy("lang").json(path)
    docs = stores.read_policy_json(spark, path, "doc_id long, source string, text string, lang string")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@query("io3_chunk_store", f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 200 + 1, 200)) AS chunk_md5, e[1] AS first_letter, len(e) AS dims FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i, [{_COUNTS.replace('text', 'substr(text, i * 200 + 1, 200)')}] AS e FROM documents WHERE lang = 'de')".replace("unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i, [", "i, [").replace("FROM documents WHERE lang = 'de')", "FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents WHERE lang = 'de'))"))
def io3(spark, d):
    """Chunks with vectors, written by category; a read of one category opens only its folder."""
    path = new_folder(spark, "chunks")
    chunks = R.embed(R.chunks(table(spark, d, "documents").select("doc_id", "lang", "text")), "chunk", letter_model)
    stores.write_chunks(chunks, path, "lang")
    back = spark.read.schema(chunks.schema).parquet(path).where("lang = 'de'")
    return back.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.element_at("embedding", 1).cast("double").alias("first_letter"), F.size("embedding").cast("long").alias("dims"))


@query("io5_trace_store", stage_sql("SELECT strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d') AS day, stage, count(*) AS n FROM stages GROUP BY 1, 2"))
def io5(spark, d):
    """Stage events appended by day, read back."""
    path = new_folder(spark, "trace")
    events = voice_stages(spark, d).withColumn("ts", F.timestamp_millis("at_ms"))
    stores.append_trace(events, path)
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage").agg(F.count("*").alias("n"))


@query("io7_handoff_files", ORACLES["pa12_twelve_field_handoff"])
def io7_files(spark, d):
    """Twelve-field handoffs as JSON lines, parsed again by their schema."""
    path, rows = new_folder(spark, "handoffs"), handoffs(spark, d)
    stores.write_handoffs(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("io8_audit_trail", ORACLES["pa14_audit"])
def io8(spark, d):
    """Audit records appended to their trail and read back."""
    path, records = new_folder(spark, "audit"), D.audit(decided(spark, d))
    stores.write_audit(records, path)
    return spark.read.schema(records.schema).parquet(path)


@query("io16_migration", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_currency, 2 AS schema_version FROM orders")
def io16(spark, d):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DecimalType(18, 2)), T.StructField("o_currency", T.StringType())])
    return stores.migrate(table(spark, d, "orders"), 2, schema).select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_currency", "schema_version")


@query(
    "rg4_chunk_metadata",
    "SELECT doc_id, source AS title, lang AS policy_category, CAST(i AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS chunks, CAST(doc_id % 5 + 1 AS INTEGER) AS version, md5(substr(text, i * 200 + 1, 200)) AS chunk_md5 FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents)",
)
def rg4_metadata(spark, d):
    """Each chunk with its document's metadata; the number of chunks follows from the length, without a shuffle."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("policy_category"), (F.col("doc_id") % 5 + 1).cast("int").alias("version"), F.ceil(F.length("text") / 200).cast("long").alias("chunks"), "text")
    return R.chunks(docs).select("doc_id", "title", "policy_category", "chunk_index", "chunks", "version", F.md5("chunk").alias("chunk_md5"))


@query("rg7_text_versions", "SELECT source, version, n_docs, changed, added, removed FROM (SELECT source, version, count(*) AS n_docs, count(*) FILTER (old IS NOT NULL AND new IS NOT NULL AND old <> new) AS changed, count(*) FILTER (old IS NULL) AS added, count(*) FILTER (new IS NULL) AS removed FROM (SELECT coalesce(a.source, b.source) AS source, coalesce(b.version, a.version + 1) AS version, a.h AS old, b.h AS new FROM (SELECT source, doc_id // 5 AS section, doc_id % 5 AS version, md5(text) AS h FROM documents WHERE doc_id % 5 < 4) a FULL JOIN (SELECT source, doc_id // 5 AS section, doc_id % 5 AS version, md5(text) AS h FROM documents WHERE doc_id % 5 > 0) b ON a.source = b.source AND a.section = b.section AND a.version + 1 = b.version) GROUP BY 1, 2)")
def rg7_versions(spark, d):
    """Documents as sections with versions: per source and version, sections changed, added and removed
    against the version before."""
    s = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 5).alias("section"), (F.col("doc_id") % 5).alias("version"), F.md5("text").alias("text_md5"))
    return R.compare_versions(s.where("version < 4"), s.where("version > 0"))


@query(
    "rg8_filtered_ranking",
    f"WITH {BM25.replace('FROM documents)', '''FROM documents WHERE lang = 'de')''')} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10",
)
def rg8_ranking(spark, d):
    """Filtered by metadata, then scored: statistics are those of the documents that the filter leaves."""
    return R.bm25(questions(spark, d), table(spark, d, "documents").where("lang = 'de'"), 10)


def _written(df, name):
    """df, written and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(
    "io4_scenario_files",
    decided_sql(
        f""", {SCENARIO_SQL}
SELECT concat('SC-', customer_id) AS id, CASE WHEN customer_id % 50 = 1 THEN NULL ELSE CAST(customer_id AS VARCHAR) END AS customer_id, CASE WHEN customer_id % 50 = 1 THEN NULL ELSE customer_id % 5 <> 0 END AS authenticated, CASE WHEN customer_id % 50 = 1 THEN NULL ELSE category END AS user_goal, CASE WHEN customer_id % 50 = 1 THEN NULL ELSE len(asked) END AS turns,
CASE WHEN customer_id % 50 = 1 THEN NULL ELSE array_to_string(expected, ',') END AS tools, CASE WHEN customer_id % 50 = 1 THEN NULL ELSE array_to_string(prohibited, ',') END AS prohibited_tools, customer_id % 50 = 1 AS broken FROM scenario"""
    ).replace("\n, category", ", category"),
)
def io4(spark, d):
    """Scenarios written as documents, those of even customers as YAML and the others as JSON lines, and read
    again; every fiftieth has an authenticated that is neither true nor false and comes back as an error.
    The scenarios are made once and the files read once, in tasks of at most SCENARIOS_PER_FILE documents."""
    s = _written(scenarios(spark, decided(spark, d)), "scenario-rows").withColumn("odd", F.col("customer_id") % 2 == 1).withColumn("auth", F.when(F.col("customer_id") % 50 == 1, F.to_json(F.array(F.lit("?")))).otherwise((F.col("customer_id") % 5 != 0).cast("string")))
    said = F.to_json(F.transform("asked", lambda t: F.struct(F.concat(F.lit("please "), t).alias("user"))))
    tools_, banned = F.to_json("expected"), F.to_json("prohibited")
    expected = F.concat(F.lit('{"tools": '), tools_, F.lit(', "prohibited_tools": '), banned, F.lit(', "final_outcome": "resolved", "must_not": []}'))
    as_json = F.concat(F.lit('{"id": "SC-'), "customer_id", F.lit('", "initial_state": {"customer_id": '), "customer_id", F.lit(', "authenticated": '), "auth", F.lit('}, "user_goal": "'), "category", F.lit('", "conversation": '), said, F.lit(', "expected": '), expected, F.lit("}"))
    as_yaml = F.concat(F.lit("---\nid: SC-"), "customer_id", F.lit("\ninitial_state:\n  customer_id: "), "customer_id", F.lit("\n  authenticated: "), "auth", F.lit("\nuser_goal: "), "category", F.lit("\nconversation: "), said, F.lit("\nexpected: "), expected)
    path = new_folder(spark, "scenarios")
    stores.write_scenarios(s.where("not odd").select(as_yaml.alias("value")), f"{path}/yaml")
    stores.write_scenarios(s.where("odd").select(as_json.alias("value")), f"{path}/json")
    back = _written(stores.read_scenarios(spark, f"{path}/yaml", "yaml").unionByName(stores.read_scenarios(spark, f"{path}/json", "json")), "scenarios-read")
    ids = back.where("id is not null").select("id")
    named = back.where("id is not null").select("id", "initial_state.customer_id", "initial_state.authenticated", "user_goal", F.size("conversation").cast("long").alias("turns"), F.array_join("expected.tools", ",").alias("tools"), F.array_join("expected.prohibited_tools", ",").alias("prohibited_tools"), F.lit(False).alias("broken"))
    lost = _written(s.select(F.concat(F.lit("SC-"), "customer_id").alias("id")).join(ids, "id", "left_anti"), "scenarios-lost")
    errors = back.where("error = 'initial_state.authenticated: not true or false'").count()
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in named.dtypes[1:-1]]
    return named.unionByName(lost.select("id", *nothing, (F.lit(errors) == lost.count()).alias("broken")))


class Echo:
    """A provider for tests and examples: the first word of a prompt and how many characters it has."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"{p.split(' ')[0]} {len(p)}" for p in prompts]

    def stream(self, prompt: str):
        yield from prompt.split(" ")


class Teller:
    """A deterministic provider with tools, for tests and examples. It asks for an account's balance, then
    for its transactions, and answers with both; it gives up at a refusal. ``export`` asks for a tool that
    isn't there, ``policy`` for policies again and again."""

    def generate_with_tools(self, transcripts: list[list[str]], tools: list[str]) -> list[P.Reply]:
        return [self._reply(*t) for t in transcripts]

    def _reply(self, prompt: str, *heard: str) -> P.Reply:
        what, _, account = prompt.partition(" ")
        if heard and heard[-1].startswith("refused"):
            return P.Reply(answer=f"cannot: {heard[-1].removeprefix('refused: ')}")
        if what == "policy":
            return P.Reply(tool="search_policies", argument=account)
        if not heard:
            return P.Reply(tool="export_ledger" if what == "export" else "get_account_balance", argument=account)
        if len(heard) == 1:
            return P.Reply(tool="get_recent_transactions", argument=account)
        return P.Reply(answer=f"{heard[0]} after {heard[1]}")


def tool_requests(spark, d):
    """A request of each account's holder. Some ask for another's account, for one that isn't there, for a
    tool that isn't there, or for policies for ever; every fifth isn't authenticated."""
    n = F.col("account_id")
    what = F.when(n % 17 == 0, "policy").when(n % 13 == 0, "export").otherwise("account")
    wanted = F.when(n % 11 == 0, -n - 1).when(n % 7 == 0, n + 2).otherwise(n)
    return accounts(spark, d).select(n.alias("request_id"), "customer_id", (n % 5 != 0).alias("authenticated"), F.lit(False).alias("confirmed"), F.concat_ws(" ", what, wanted.cast("string")).alias("prompt"))


def tool_lookups(spark, d):
    """What the tools say: a balance, and the number of an account's transactions."""
    own, txns = accounts(spark, d), transactions(spark, d)
    counted = txns.groupBy("account_id").agg(F.count("*").alias("n"))
    of = lambda calls, found: calls.join(found, F.col("argument") == F.col("account_id").cast("string"), "left")
    return {
        "get_account_balance": lambda calls: of(calls, own.select("account_id", "current_balance")).select("request_id", F.col("current_balance").cast("decimal(18,2)").cast("string").alias("result")),
        "get_recent_transactions": lambda calls: of(calls, counted).select("request_id", F.coalesce("n", F.lit(0)).cast("string").alias("result")),
    }


@query(
    "ud2_tool_loop",
    with_views(
        "account txn",
        """, r AS (SELECT account_id AS n, customer_id, account_id % 5 <> 0 AS authenticated, CASE WHEN account_id % 17 = 0 THEN 'policy' WHEN account_id % 13 = 0 THEN 'export' ELSE 'account' END AS what, CASE WHEN account_id % 11 = 0 THEN -account_id - 1 WHEN account_id % 7 = 0 THEN account_id + 2 ELSE account_id END AS wanted FROM account),
l AS (SELECT r.*, a.current_balance, (SELECT count(*) FROM txn WHERE txn.account_id = wanted) AS txns, CASE WHEN what = 'export' THEN 'allowlist' WHEN what = 'policy' THEN NULL WHEN NOT authenticated THEN 'authentication' WHEN a.customer_id <> r.customer_id THEN 'ownership' WHEN a.account_id IS NULL THEN 'arguments' END AS layer FROM r LEFT JOIN account a ON a.account_id = wanted)
SELECT n AS request_id, CASE WHEN what = 'policy' THEN 'round_limit' ELSE 'answered' END AS outcome, CASE WHEN what = 'policy' THEN NULL WHEN layer IS NOT NULL THEN concat('cannot: ', layer) ELSE concat(CAST(CAST(current_balance AS DECIMAL(18, 2)) AS VARCHAR), ' after ', txns) END AS answer,
CASE WHEN what = 'policy' THEN 4 WHEN layer IS NOT NULL THEN 2 ELSE 3 END AS rounds, CASE WHEN what = 'policy' THEN 4 WHEN layer IS NOT NULL THEN 1 ELSE 2 END AS calls, CASE WHEN layer IS NOT NULL THEN 1 ELSE 0 END AS denied,
CASE WHEN what = 'policy' THEN 'search_policies:executed,search_policies:executed,search_policies:executed,search_policies:executed' WHEN what = 'export' THEN 'export_ledger:denied' WHEN layer IS NOT NULL THEN 'get_account_balance:denied' ELSE 'get_account_balance:executed,get_recent_transactions:executed' END AS trail FROM l""",
    ).replace("\n, r AS", ", r AS"),
)
def ud2_loop(spark, d):
    """Every request through the tool loop, to its answer or to the limit of four rounds."""
    owners = accounts(spark, d).select(F.col("account_id").cast("string").alias("resource"), F.col("customer_id").alias("resource_owner"))
    return P.with_tools(tool_requests(spark, d), tools(spark), owners, tool_lookups(spark, d), Teller)


@query("ud2_stream", "SELECT conv_id * 1000 + turn AS turn_key, i - 1 AS part, string_split(text, ' ')[i] AS text, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, unnest(range(1, len(string_split(text, ' ')) + 2)) AS i FROM conversations WHERE role = 'user')")
def ud2_stream(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_key"), "text")
    return P.streamed(turns, "turn_key", "text", Echo)


@query("ud2_llm_answers", "SELECT conv_id, turn, concat(string_split(text, ' ')[1], ' ', length(text)) AS answer, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE role = 'user'")
def ud2(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    return P.answered(turns, "text", Echo).select("conv_id", "turn", "answer", "error")


@query("set_operations", "SELECT * FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_operations(spark, d):
    """Nations with customers or suppliers, less those with a supplier in debt."""
    nations = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    owing = table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey")
    return nations.intersect(table(spark, d, "nation").select("n_nationkey")).exceptAll(owing.distinct())


@query("top_customers", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_customers(spark, d):
    """A global sort with a limit: each task keeps 20 rows."""
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(20)


__all__ = ["LETTERS", "Window", "decided_sql"]
