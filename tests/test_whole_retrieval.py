"""Retrieval metrics over every vector as a query, and searches for all items at once, against brute force."""

import duckdb
import numpy as np

from ledgerlens.operators import vector_index as V
from ledgerlens.plans.catalog import ORACLES, QUERIES


def embeddings(spark, path, n=150, apart=1):
    """Ids that are some numbers apart, few of them divisible by 100; few distinct directions, so that scores tie."""
    r = np.random.default_rng(3)
    rows = [(i * apart + (7 if apart == 1 else 0), (r.integers(-1, 2, 4) + [0.0, 0.0, 0.0, 2.0]).tolist(), int(r.integers(0, 4))) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return rows, con


def test_every_vector_is_a_query_of_the_ranking(spark, tmp_path, same_rows):
    rows, con = embeddings(spark, tmp_path)
    recall, found, top = [], [], []
    for q, x, label in rows:
        score = lambda y, x=x: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
        best = sorted((-score(y), i, of) for i, y, of in rows if i != q)[:10]
        hits = [rank for rank, (_, _, of) in enumerate(best, 1) if of == label]
        recall.append(len(hits) / (sum(of == label for _, _, of in rows) - 1))
        found.append(1 / hits[0] if hits else 0)
        top.append(bool(hits) and hits[0] == 1)
    got = QUERIES["ev13_15_ranking"](spark, str(tmp_path)).toPandas()
    assert got.queries[0] == len(rows)
    assert np.allclose(got[["recall_at_k", "mrr", "top1"]].to_numpy()[0], [np.mean(recall), np.mean(found), np.mean(top)], atol=1e-6)
    same_rows(got, con.sql(ORACLES["ev13_15_ranking"]).df())


def test_all_later_vectors_of_a_label_are_acceptable(spark, tmp_path, same_rows):
    """Ids are 50 apart, so no two are as near as the few labels of io12_retrieval_labels are looked for."""
    rows, con = embeddings(spark, tmp_path, apart=50)
    figures = []
    for q, x, label in rows:
        later = sorted(i for i, _, of in rows if of == label and i > q)
        if q % 100 == 0 and later:
            score = lambda y, x=x: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
            best = [i for _, i in sorted((-score(y), i) for i, y, _ in rows if i != q)[:10]]
            ranks = [rank for rank, i in enumerate(best, 1) if i in later]
            figures.append((later[0] in best, bool(ranks), len(ranks) / len(later), 1 / ranks[0] if ranks else 0, bool(ranks) and ranks[0] == 1))
    got = QUERIES["ev13_acceptable_alternatives"](spark, str(tmp_path)).toPandas()
    assert got.queries[0] == len(figures) > 70
    assert np.allclose(got[["expected_found", "acceptable_found", "recall_at_k", "mrr", "top1"]].to_numpy()[0], np.mean(figures, axis=0), atol=1e-6)
    same_rows(got, con.sql(ORACLES["ev13_acceptable_alternatives"]).df())


def test_all_items_as_queries_with_ties(spark, monkeypatch):
    """One vector is a third of the table; blocks of queries and items are small."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 300)
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    r = np.random.default_rng(4)
    m = r.normal(size=(900, 8))
    m[::3] = m[0]
    m[5] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    found, counts = V.search(V.build_index(df, "vec_id", "embedding"), df, 10)
    got = {}
    for row in sorted(found.collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(row.query_id, []).append(row.item_id)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 6)
    np.fill_diagonal(scores, -2)
    assert got == {i: np.lexsort((np.arange(900), -scores[i]))[:10].tolist() for i in range(900)}
    # what leaves the tasks: at most k rows a query of each task of both passes
    assert counts.count() <= 2 * 10 * 900 * spark.sparkContext.defaultParallelism
