"""Fusion over all documents against plain Python."""

import random

import numpy as np

from ledgerlens.operators import retrieval as R


def test_fusion_without_a_cut(spark):
    r = random.Random(3)
    docs = [(i, " ".join(["common"] * r.randint(1, 9) + ["other"] * r.randint(1, 20)) if i % 4 else "none") for i in range(300)]
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    q, d = spark.createDataFrame([(-1, "common")], "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    qv, dv = spark.createDataFrame([(-1, [1.0, 0.5, 0.0, 0.0])], "id long, embedding array<float>"), spark.createDataFrame(vectors, "id long, embedding array<float>")
    word = {x.doc_id: x.score for x in R.bm25(q, d).collect()}
    near = {x.item_id: x.score for x in R.vector_topk(qv, dv, 300, "id").collect()}
    scale = lambda s: {i: (x - min(s.values())) / (max(s.values()) - min(s.values())) for i, x in s.items()}
    w, v = scale(word), scale(near)
    want = sorted(((0.5 * v[i] + 0.5 * w.get(i, 0.0), -i) for i, _ in docs), reverse=True)[:10]
    got = R.hybrid_whole(q, d, qv, dv, 10).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [-i for _, i in want] and np.allclose([x.score for x in got], [s for s, _ in want], atol=1e-6)
    cut = R.hybrid(R.bm25(q, d, 20), R.vector_topk(qv, dv, 20, "id").withColumnRenamed("item_id", "doc_id"), 10).orderBy("rank").collect()
    assert [x.doc_id for x in cut] != [x.doc_id for x in got]


def test_few_vector_scores_are_made(spark):
    """Many questions and documents in clusters: the answers of brute force, by far fewer vector scores."""
    r = np.random.default_rng(8)
    centers = r.normal(size=(30, 12))
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["the", *r.choice(words, 12)])) for i in range(1500)] + [(2000, None), (2001, "the")]
    vectors = [(i, (centers[i % 30] + 0.3 * r.normal(size=12)).tolist()) for i in range(1500)] + [(2001, [0.0] * 12)]
    asked = [(-i, " ".join(["the", *r.choice(words, 3)]), (centers[i] + 0.3 * r.normal(size=12)).tolist()) for i in range(1, 25)]
    q, d = spark.createDataFrame([(i, t) for i, t, _ in asked], "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    qv, dv = spark.createDataFrame([(i, v) for i, _, v in asked], "id long, embedding array<double>"), spark.createDataFrame(vectors, "id long, embedding array<double>")
    word, near = {}, {}
    for x in R.bm25(q, d).collect():
        word.setdefault(x.query_id, {})[x.doc_id] = x.score
    for x in R.vector_topk(qv, dv, 3000, "id").collect():
        near.setdefault(x.query_id, {})[x.item_id] = x.score
    scale = lambda s: {i: (x - min(s.values())) / ((max(s.values()) - min(s.values())) or 1) for i, x in s.items()}
    found, looked = R.hybrid_bounded(q, d, qv, dv, 10)
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.doc_id)
    for i, _, _ in asked:
        w, v = scale(word[i]), scale(near[i])
        want = sorted((-round(0.5 * v.get(n, 0.0) + 0.5 * w.get(n, 0.0), 9), n) for n in {*w, *v})[:10]
        assert got[i] == [n for _, n in want]
    assert looked.count() < 0.2 * len(asked) * len(docs)
