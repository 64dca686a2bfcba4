"""Policy ingestion and retrieval: sections, chunks, keyword, vector and hybrid ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import normalize
from ledgerlens.operators import keyword_index as W
from ledgerlens.operators import vector_index as V
from ledgerlens.sources.scratch import new_folder

CHUNK_CHARS = 200
QUERY_BLOCK, SCORE_BLOCK = 16_384, 1024


def sections(docs: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """One row per section that isn't blank, numbered from 0 among all."""
    return docs.select("*", F.posexplode(F.split(text, separator)).alias("section", "body")).drop(text).where(F.trim("body") != "")


def chunks(docs: DataFrame, text: str = "text", size: int = CHUNK_CHARS, overlap: int = 0) -> DataFrame:
    """Fixed-size character chunks with chunk_index; an empty text has none."""
    step = size - overlap
    n = F.ceil(F.greatest(F.length(text) - overlap, F.lit(1)) / step).cast("int")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return docs.select("*", F.explode(starts).alias("chunk_index")).withColumn("chunk", F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size))).drop(text)


def current_version(df: DataFrame, key: str, best: Column) -> DataFrame:
    """Of each key the row with the greatest best, which tells rows apart. Aggregated before the shuffle, so
    a key with very many rows is no task's burden."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), best).alias("_row")).select(key, "_row.*")


def version_changes(df: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """key, version, and whether the value differs from that of the version before. Rows are cut by ranges
    of (key, version), so that a key with very many versions takes many tasks; each range's first row
    looks at the last row of the range before."""
    cut = df.select(key, version, value).repartitionByRange(F.col(key), F.col(version)).withColumn("_range", F.spark_partition_id())
    path = new_folder(df.sparkSession, "versions")
    cut.write.parquet(path)
    cut = df.sparkSession.read.schema(cut.schema).parquet(path)
    w = Window.partitionBy(key, "_range").orderBy(version)
    inside = cut.withColumn("_n", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w))
    ends = cut.groupBy(key, "_range").agg(F.struct(F.max_by(value, version).alias("value")).alias("last"))
    before = ends.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.lag("last").over(Window.partitionBy(key).orderBy("_range")).alias("_before"))
    both = inside.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    earlier, first = F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_before.value")), (F.col("_n") == 1) & F.col("_before").isNull()
    return both.select(key, version, (~F.col(value).eqNullSafe(earlier) & ~first).alias("changed"))


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per source and version: sections (source, section, version, text_md5) of that version or the one
    before it, and how many were changed, added and removed."""
    a = before.select("source", "section", (F.col("version") + 1).alias("version"), F.col("text_md5").alias("old"))
    b = after.select("source", "section", "version", F.col("text_md5").alias("new"))
    both = a.join(b, ["source", "section", "version"], "full_outer")
    return both.groupBy("source", "version").agg(F.count("*").alias("n_docs"), F.count_if(F.col("old") != F.col("new")).alias("changed"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """Vectors of an injected model, one Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(model(list(batch.fillna(""))), np.float32)))

    return df.withColumn(name, run(F.col(text)))


def cached_embed(df: DataFrame, cache: DataFrame, text: str, model: Callable[[list[str]], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """df with vectors, and the cache's new rows: each distinct text missing from it is embedded once."""
    keyed = df.withColumn("text_key", F.sha2(F.col(text), 256))
    misses = keyed.join(cache.select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.first(text).alias(text))
    fresh = embed(misses, text, model).select("text_key", "embedding")
    return keyed.join(cache.select("text_key", "embedding").unionByName(fresh), "text_key", "left"), fresh


def vector_topk(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k items of greatest cosine similarity (to 6 digits, ties by id) for each query: query_id,
    item_id, score, rank. A query isn't its own item. Queries are a written table in blocks of about
    QUERY_BLOCK; one block at a time is a matrix that is broadcast, and its results are written. A task
    keeps k rows per query and batch, so work grows with queries x items and nothing else does. Items
    with an empty or null vector are left out."""
    spark = items.sparkSession
    path, out = new_folder(spark, "vector-queries"), new_folder(spark, "vector-nearest")
    asked = queries.where(F.size(vector) > 0).select(key, vector)
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    asked.repartition(n).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(path)
    blocks = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("block", T.IntegerType())])).parquet(path)
    for i in range(n):
        block = blocks.where(F.col("block") == i).select(key, vector).orderBy(key).collect()
        names = np.array([r[0] for r in block], np.int64)
        matrix = np.array([r[1] for r in block], np.float64).reshape(len(block), -1)
        shared = spark.sparkContext.broadcast((names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            all_names, whole = shared.value
            for batch in batches:
                v = np.stack(batch[vector].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                own = batch[key].to_numpy()
                for at in range(0, len(all_names), SCORE_BLOCK):
                    names = all_names[at : at + SCORE_BLOCK]
                    s = np.round(v @ whole[at : at + SCORE_BLOCK].T, 6)
                    s[own[:, None] == names[None, :]] = -2.0
                    best = np.lexsort((np.broadcast_to(own[:, None], s.shape), -s), axis=0)[:k]
                    q = np.broadcast_to(names[None, :], best.shape)
                    out = pd.DataFrame({"query_id": q.ravel(), "item_id": own[best].ravel(), "score": np.take_along_axis(s, best, 0).ravel()})
                    yield out[out["score"] > -2.0]

        part = items.where(F.size(vector) > 0).select(key, vector).mapInPandas(score, "query_id long, item_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part.write.mode("append").parquet(out)
        shared.unpersist()
    return spark.read.schema(part.schema).parquet(out)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it is counted to have few (narrow) rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """queries: query_id, text; docs: doc_id, text. BM25 of documents that share a token with the
    query: query_id, doc_id, score (6 digits), rank by score, then id. With k only the k best leave the tasks
    that score them; without, all pairs do."""
    index = W.build_keyword_index(docs)
    scored = W.keyword_scores(index, W.asked_tokens(index, queries), k).where("not least").drop("least")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    scored = scored.withColumn("rank", F.row_number().over(w))
    return scored if k is None else scored.where(F.col("rank") <= k)


def min_max(df: DataFrame, by: str, score: str) -> DataFrame:
    """score on 0 to 1 within each query; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.coalesce((F.col(score) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))


def hybrid(keyword: DataFrame, vector: DataFrame, k: int, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """alpha * normalized vector score + beta * normalized keyword score; a document that one side
    lacks has 0 there. Both have query_id, doc_id, score."""
    a = min_max(vector.select("query_id", "doc_id", F.col("score").alias("v")), "query_id", "v")
    b = min_max(keyword.select("query_id", "doc_id", F.col("score").alias("w")), "query_id", "w")
    fused = a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.round(alpha * F.coalesce("v", F.lit(0.0)) + beta * F.coalesce("w", F.lit(0.0)), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_whole(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """hybrid() over all documents, as hybrid_bounded() finds it: query_id, doc_id, score, rank."""
    return hybrid_bounded(queries, docs, query_vectors, doc_vectors, k, alpha, beta)[0]


def hybrid_bounded(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int, alpha: float = 0.5, beta: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """hybrid() over all documents with a stopping bound: no side is cut before fusion, and few vector
    scores are made. Vectors have id, embedding. Also returns the pairs (query_id, doc_id) whose vector
    score was looked up.

    Keyword scores are made twice, in matrices of which few leave a task: once for each query's k best, least and
    most, and once for those that may still reach the answer. The vector index gives each query's k best and
    least vector scores exactly. Fusing the k best of both sides gives a k-th score that the answer
    reaches. From there on, a document counts only if its keyword score and the most that its vector score
    can be (by its angle in its list) may fuse to that. One without a keyword score can only be
    among the k best if it is among the k best vectors. Minima and maxima are those of all scores of
    the query; order is by the score to 9 digits, then id."""
    query_vectors = _kept(query_vectors, "hybrid-asked")
    index = V.build_index(_kept(doc_vectors, "hybrid-vectors"), "id", "embedding")  # a model's vectors aren't made again
    lists = len(index.centroids)
    both_ways = query_vectors.select(F.col("id").cast("long").alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("turned"), "embedding"), F.struct(F.lit(1).alias("turned"), F.transform("embedding", lambda x: -x).alias("embedding")))).alias("x"))
    numbered = _kept(both_ways.select("id", "x.*").withColumn("number", -1 - F.monotonically_increasing_id()), "hybrid-queries")
    near = V.search(index, numbered, k, "number")[0].join(small(numbered.select(F.col("number").alias("query_id"), "id", "turned")), "query_id")
    near = _kept(near.select(F.col("id").alias("query_id"), "turned", F.col("item_id").alias("doc_id"), "score", "rank"), "hybrid-near")
    best = near.where("turned = 0").select("query_id", "doc_id", F.col("score").alias("v"))
    span = near.groupBy("query_id").agg(F.max(F.when(F.col("turned") == 0, F.col("score"))).alias("high"), (-F.max(F.when(F.col("turned") == 1, F.col("score")))).alias("low"))

    postings = W.build_keyword_index(docs)
    asked = W.asked_tokens(postings, queries)
    words = W.keyword_scores(postings, asked, k)
    kept = words.groupBy("query_id").agg(F.min(F.when(F.col("least"), F.col("score"))).alias("least"), F.max("score").alias("most"))
    angles = V.angles_to_lists(index, query_vectors, "id", "embedding")
    about = small(_kept(angles.join(span, "query_id", "full_outer").join(kept, "query_id", "full_outer"), "hybrid-about"), 10_000)

    scaled = lambda x, low, high: F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    weigh = lambda scores: scores.join(about, "query_id").withColumn("w", scaled(F.col("score"), F.col("least"), F.col("most")))
    fused = lambda df: df.withColumn("fused", F.round(alpha * scaled(F.col("v"), F.col("low"), F.col("high")) + beta * F.coalesce("w", F.lit(0.0)), 9))

    def looked_up(pairs: DataFrame) -> DataFrame:
        """Pairs (query_id, q, doc_id, ...) with the vector score v; null for documents without a vector."""
        e = F.transform("vector", lambda x: x.cast("double"))
        norm = F.greatest(F.sqrt(F.aggregate(e, F.lit(0.0), lambda t, x: t + x * x)), F.lit(1e-300))
        v = F.round(F.aggregate(F.zip_with("q", F.transform(e, lambda x: x / norm), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x), 6)
        return pairs.join(index.rows.select(F.col("id").alias("doc_id"), "vector"), "doc_id", "left").withColumn("v", v).drop("vector")

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    top = weigh(words.where("not least").drop("least")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    first = fused(looked_up(top)).select("query_id", "doc_id", "fused")
    beside = weigh(W.lookup_scores(postings, asked, best.select("query_id", "doc_id")))
    vector_side = fused(best.join(beside.select("query_id", "doc_id", "w"), ["query_id", "doc_id"], "left").join(about.select("query_id", "low", "high"), "query_id")).select("query_id", "doc_id", "fused")
    seen = _kept(first.unionByName(vector_side).dropDuplicates(["query_id", "doc_id"]), "hybrid-first")
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "doc_id")
    enough = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("fused").alias("enough"))

    place = index.rows.select(F.col("id").alias("doc_id"), "list", "angle")
    bound = F.when(F.col("list") == lists, F.when(F.col("angles").isNotNull(), F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(V.best_cosine(F.element_at("angles", F.when(F.col("list") < lists, F.col("list") + 1)), F.col("angle"), F.col("angle")))
    reach = alpha * F.coalesce(scaled(F.least(bound + V.SLACK, F.col("high")), F.col("low"), F.col("high")), F.lit(1.0)) + beta * F.col("w") + 1e-9
    least_score = F.col("least") + (F.col("most") - F.col("least")) * ((F.col("enough") - alpha - 1e-9) / beta) - 1e-6
    floors = enough.join(kept, "query_id").where(F.col("enough") > alpha + 1e-9).select("query_id", least_score.alias("floor"))
    far = W.keyword_scores(postings, asked, floors=floors if beta > 0 else None).where("not least").drop("least")
    may = weigh(far).join(small(enough), "query_id", "left").where(F.col("enough").isNull() | (alpha + beta * F.col("w") + 1e-9 >= F.col("enough")))
    may = may.join(place, "doc_id", "left").where(F.col("enough").isNull() | F.col("list").isNull() | (reach >= F.col("enough")))
    more = _kept(fused(looked_up(may.join(small(seen.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_anti"))).select("query_id", "doc_id", "fused"), "hybrid-more")
    ranked = seen.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    looked = more.select("query_id", "doc_id").unionByName(first.select("query_id", "doc_id"))
    return ranked.select("query_id", "doc_id", F.round("fused", 6).alias("score"), "rank"), looked


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sufficient(ranked: DataFrame, least: float) -> DataFrame:
    """Per query: the best score, whether it is enough to answer, and the sources to cite."""
    listed = F.array_join(F.array_sort(F.collect_set(F.col("doc_id"))).cast("array<string>"), ",")
    return ranked.groupBy("query_id").agg(F.max("score").alias("best"), listed.alias("sources")).withColumn("verdict", F.when(F.col("best") >= least, "answer").otherwise("cannot_verify"))


__all__ = ["bm25", "cached_embed", "chunks", "current_version", "embed", "hybrid", "hybrid_bounded", "hybrid_whole", "min_max", "normalize", "sections", "sufficient", "vector_topk", "version_changes"]
