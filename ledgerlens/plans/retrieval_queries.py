"""Retrieval queries: documents as policies, user turns as questions, embeddings as vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize
from ledgerlens.operators import metrics as M
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import vector_index as V
from ledgerlens.plans.registry import query
from ledgerlens.sources import stores
from ledgerlens.sources.scratch import new_folder
from ledgerlens.sources.tables import table

LETTERS = "abcdefgh"
K = 10


def letter_model(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for an embedding model: how often some letters occur."""
    return np.array([[t.lower().count(c) for c in LETTERS] for t in texts], np.float32).reshape(-1, len(LETTERS))


def questions(spark, d):
    """Every hundredth conversation's user turns; ids are negative, so that none is a document's."""
    c = table(spark, d, "conversations").where("role = 'user' and conv_id % 100 = 0")
    return c.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("query_id"), "text")


@query("rg1_normalize", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) AS normalized_md5 FROM documents")
def rg1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalize(F.col("text"))).alias("normalized_md5"))


@query("rg2_sections", "SELECT doc_id, count(*) AS sections, max(length(s)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE trim(s) <> '' GROUP BY doc_id")
def rg2(spark, d):
    return R.sections(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("sections"), F.max(F.length("body")).cast("long").alias("longest"))


@query(
    "rg3_chunk",
    "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 200 + 1, 200)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents)",
)
def rg3(spark, d):
    return R.chunks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query(
    "rg3_overlapping_chunks",
    "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 150 + 1, 200)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 50, 1) / 150.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)",
)
def rg3_overlap(spark, d):
    """Chunks of 200 characters, of which 50 are the end of the chunk before."""
    return R.chunks(table(spark, d, "documents").select("doc_id", "text"), overlap=50).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query("rg4_metadata", "SELECT lang AS policy_category, source AS title, CAST(sum(ceil(length(text) / 200.0)) AS BIGINT) AS chunks FROM documents GROUP BY 1, 2")
def rg4(spark, d):
    c = R.chunks(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    return c.groupBy(F.col("lang").alias("policy_category"), F.col("source").alias("title")).agg(F.count("*").alias("chunks"))


@query("rg6_current_version", "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def rg6(spark, d):
    """A source's current document is its longest; ties by id."""
    return R.current_version(table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars"), "source", F.struct("n_chars", -F.col("doc_id"))).select("source", "doc_id", "lang")


@query("rg7_version_diff", "SELECT doc_id, n > 1 AND lang IS DISTINCT FROM p AS changed FROM (SELECT doc_id, lang, lag(lang) OVER w AS p, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))")
def rg7(spark, d):
    return R.version_changes(table(spark, d, "documents"), "source", "doc_id", "lang").select("doc_id", "changed")


@query("rg8_filtered", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND source = 'src1'")
def rg8(spark, d):
    return table(spark, d, "documents").where("lang = 'de' and source = 'src1'").select("doc_id", "n_chars")


def vectors_sql(asked: str) -> str:
    """Scores of all vectors for those that ``asked`` takes as queries, and the K best of each."""
    return f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label = i.label AS hit, round(list_cosine_similarity(q.e, i.e), 6) AS score FROM v q JOIN v i ON {asked}q.vec_id <> i.vec_id),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s) WHERE rank <= {K})"""


VECTORS = vectors_sql("q.vec_id % 100 = 0 AND ")


def nearest(spark, d, asked: str = "vec_id % 100 = 0"):
    """Exact, through the index of all vectors, for the vectors that ``asked`` holds of."""
    e = table(spark, d, "embeddings")
    return V.search(V.build_index(e, "vec_id", "embedding"), e.where(asked), K)[0]


def recall_at_k(spark, d, probes: int) -> float:
    """Of the K nearest vectors, the share that a search of the nearest lists alone finds."""
    e = table(spark, d, "embeddings")
    index, asked = V.build_index(e, "vec_id", "embedding"), e.where("vec_id % 100 = 0")
    true, some = (V.search(index, asked, K, probes=probes, exact=x)[0].select("query_id", "item_id") for x in (True, False))
    return true.join(some, ["query_id", "item_id"]).count() / true.count()


@query("rg9_vector", f"WITH {VECTORS} SELECT query_id, item_id, score, rank FROM top")
def rg9(spark, d):
    return nearest(spark, d)


@query("ev6_relevance", f"WITH {VECTORS} SELECT query_id, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) AS n FROM top GROUP BY 1")
def ev6(spark, d):
    return M.rate(_hits(spark, d, nearest(spark, d)), F.col("hit"), ["query_id"])


def _hits(spark, d, ranked):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    q = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    i = labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    return ranked.join(q, "query_id").join(i, "item_id").withColumn("hit", F.col("query_label") == F.col("item_label"))


@query(
    "ev13_15_ranking",
    f"""WITH {vectors_sql("")}, rel AS (SELECT query_id, count(*) FILTER (hit) AS relevant FROM s GROUP BY 1), h AS (SELECT query_id, count(*) AS hits, min(rank) AS best FROM top WHERE hit GROUP BY 1)
SELECT round(avg(coalesce(hits, 0)::DOUBLE / relevant), 6) AS recall_at_k, round(avg(coalesce(1e0 / best, 0e0)), 6) AS mrr, round(avg(CASE WHEN best = 1 THEN 1e0 ELSE 0e0 END), 6) AS top1, count(*) AS queries FROM rel LEFT JOIN h USING (query_id) WHERE relevant > 0""",
)
def ev13(spark, d):
    """Every vector is a query; relevant to it are the others of its label."""
    e = table(spark, d, "embeddings")
    totals = e.select(F.col("vec_id").alias("query_id"), "label").join(e.groupBy("label").agg((F.count("*") - 1).alias("relevant")), "label")
    return M.ranking_metrics(_hits(spark, d, nearest(spark, d, "true")), totals, K)


#: Where only a query's first few labels are asked for, they lie among this many ids after its own.
SPAN = 40


def labelled_sql(within: str, most: str = "") -> str:
    """For every hundredth vector those after it of its label, ``within`` some ids and at ``most`` some of them: the first
    is expected, the others are acceptable."""
    return f"""near AS (SELECT q.vec_id AS query_id, list(i.vec_id ORDER BY i.vec_id){most} AS ids FROM embeddings q JOIN embeddings i ON q.vec_id % 100 = 0 AND q.label = i.label AND i.vec_id {within} GROUP BY 1),
lab AS (SELECT CAST(query_id AS VARCHAR) AS query, CAST(ids[1] AS VARCHAR) AS expected_document, CAST(NULL AS VARCHAR) AS expected_section, list_transform(ids[2:], lambda x: CAST(x AS VARCHAR)) AS acceptable_alternatives FROM near)"""


LABELLED = labelled_sql(f"BETWEEN q.vec_id + 1 AND q.vec_id + {SPAN}", "[:4]")


def _label_file(spark, ids):
    """ids: vec_id, ids (in order). Written as JSON lines and read back."""
    path, ids = new_folder(spark, "labels"), ids.select("vec_id", F.transform("ids", lambda x: x.cast("string")).alias("ids"))
    ids.select(F.col("vec_id").cast("string").alias("query"), F.col("ids")[0].alias("expected_document"), F.lit(None).cast("string").alias("expected_section"), F.slice("ids", 2, F.size("ids")).alias("acceptable_alternatives")).write.json(path)
    return stores.read_retrieval_labels(spark, path)


def retrieval_labels(spark, d):
    """Labels in a file: for every hundredth vector, the next one of its label is expected and the three after that
    are acceptable."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select("vec_id", "label", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + SPAN)).alias("item_id"))
    near = q.join(e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label")), "item_id").where("label = item_label")
    return _label_file(spark, near.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list("item_id")), 1, 4).alias("ids")))


def whole_labels(spark, d):
    """Labels in a file: for every hundredth vector, the next one of its label is expected and all after that are
    acceptable. A few labels are no few tasks: items are dealt over all cores and meet the queries there."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label")).repartition(spark.sparkContext.defaultParallelism)
    near = items.join(R.small(e.where("vec_id % 100 = 0")), (F.col("label") == F.col("item_label")) & (F.col("item_id") > F.col("vec_id")))
    return _label_file(spark, near.groupBy("vec_id").agg(F.array_sort(F.collect_list("item_id")).alias("ids")))


@query("io12_retrieval_labels", f"WITH {LABELLED} SELECT query, expected_document, expected_section, array_to_string(acceptable_alternatives, ',') AS alternatives FROM lab")
def io12(spark, d):
    return retrieval_labels(spark, d).select("query", "expected_document", "expected_section", F.array_join("acceptable_alternatives", ",").alias("alternatives"))


@query(
    "ev13_acceptable_alternatives",
    f"""WITH {VECTORS}, {labelled_sql("> q.vec_id")}, best AS (SELECT query, min(rank) FILTER (CAST(item_id AS VARCHAR) = expected_document) AS expected, min(rank) FILTER (CAST(item_id AS VARCHAR) = expected_document OR list_contains(acceptable_alternatives, CAST(item_id AS VARCHAR))) AS best,
  count(*) FILTER (CAST(item_id AS VARCHAR) = expected_document OR list_contains(acceptable_alternatives, CAST(item_id AS VARCHAR)))::DOUBLE / any_value(1 + len(acceptable_alternatives)) AS found FROM lab LEFT JOIN top ON query = CAST(query_id AS VARCHAR) GROUP BY query)
SELECT round(avg(CASE WHEN expected IS NULL THEN 0e0 ELSE 1e0 END), 6) AS expected_found, round(avg(CASE WHEN best IS NULL THEN 0e0 ELSE 1e0 END), 6) AS acceptable_found, round(avg(found), 6) AS recall_at_k, round(avg(coalesce(1e0 / best, 0e0)), 6) AS mrr, round(avg(CASE WHEN best = 1 THEN 1e0 ELSE 0e0 END), 6) AS top1, count(*) AS queries FROM best""",
)
def ev13_alternatives(spark, d):
    ranked = nearest(spark, d).select(F.col("query_id").cast("string").alias("query"), F.col("item_id").cast("string").alias("document"), "rank")
    return M.labelled_metrics(ranked, whole_labels(spark, d), K)


BM25 = r"""question AS (SELECT -1 - conv_id * 1000 - turn AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 100 = 0),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM question), bag AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM documents),
st AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(b)) AS mean_len FROM bag), post AS (SELECT token, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(b) AS len, unnest(b) AS token FROM bag) WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2, 3),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY 1), kw AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len)))), 6) AS score FROM qt JOIN post USING (token) JOIN dfs USING (token), st GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kw)"""


@query("rg10_bm25", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= {K}")
def rg10(spark, d):
    return R.bm25(questions(spark, d), table(spark, d, "documents"), K)


_COUNTS = ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE" for c in LETTERS)


@query(
    "rg11_hybrid",
    f"""WITH {BM25}, dv AS (SELECT doc_id, [{_COUNTS}] AS e FROM documents), qv AS (SELECT query_id, [{_COUNTS}] AS e FROM question),
vs AS (SELECT query_id, doc_id, CASE WHEN isnan(c) THEN 0 ELSE round(c, 6) END AS score FROM (SELECT query_id, doc_id, list_cosine_similarity(qv.e, dv.e) AS c FROM qv, dv)),
a AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS v FROM vs WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS w FROM kw WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, 0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0) AS score FROM a FULL JOIN b USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= {K}""",
)
def rg11(spark, d):
    """Keyword and vector scores of all documents, fused; no side is cut before."""
    q, docs = questions(spark, d), table(spark, d, "documents").select("doc_id", "text")
    qv = R.embed(q, "text", letter_model).select(F.col("query_id").alias("id"), "embedding")
    dv = R.embed(docs, "text", letter_model).select(F.col("doc_id").alias("id"), "embedding")
    return R.hybrid_whole(q, docs, qv, dv, K)


@query(
    "rg14_sufficient",
    f"""WITH {BM25} SELECT query_id, max(score) AS best, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))), ',') AS sources, CASE WHEN max(score) >= 20 THEN 'answer' ELSE 'cannot_verify' END AS verdict FROM ranked WHERE rank <= 3 GROUP BY 1""",
)
def rg14(spark, d):
    best = R.bm25(questions(spark, d), table(spark, d, "documents"), 3).withColumn("doc_id", F.col("doc_id").cast("string"))
    return R.sufficient(best, 20.0)


@query("io14_embedding_cache", "SELECT count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) AS embedded, count(*) AS documents FROM documents")
def io14(spark, d):
    """The cache holds even documents' texts; only distinct texts that it lacks are embedded."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = R.embed(docs.where("doc_id % 2 = 0").dropDuplicates(["text"]).withColumn("text_key", F.sha2("text", 256)), "text", letter_model).select("text_key", "embedding")
    found, fresh = R.cached_embed(docs, cache, "text", letter_model)
    rows = fresh.select(F.lit(1).alias("fresh")).unionByName(found.where("embedding is not null").select(F.lit(0).alias("fresh")))
    return rows.agg(F.count_if(F.col("fresh") == 1).alias("embedded"), F.count_if(F.col("fresh") == 0).alias("documents"))


@query(
    "io15_readiness",
    """SELECT 'customer' AS table_name, count(*) FILTER (c_custkey IS NULL OR c_acctbal IS NULL) = 0 AS ready, '' AS missing, count(*) AS n_rows, count(*) FILTER (c_custkey IS NULL) + count(*) FILTER (c_acctbal IS NULL) AS nulls FROM customer
UNION ALL SELECT 'events', count(*) FILTER (event_id IS NULL OR ts IS NULL) = 0, '', count(*), count(*) FILTER (event_id IS NULL) + count(*) FILTER (ts IS NULL) FROM events
UNION ALL SELECT 'orders', false, 'o_currency', count(*), count(*) FILTER (o_orderkey IS NULL) FROM orders""",
)
def io15(spark, d):
    from ledgerlens.sources.stores import readiness

    need = {"customer": ["c_custkey", "c_acctbal"], "events": ["event_id", "ts"], "orders": ["o_orderkey", "o_currency"]}
    return readiness({name: (table(spark, d, name), columns) for name, columns in need.items()})
