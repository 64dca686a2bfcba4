"""Evaluation metrics over decided calls, retrieved lists and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import ratio


def rate(df: DataFrame, good: Column, by: list[str] | None = None, name: str = "rate", digits: int = 6) -> DataFrame:
    """Share of rows for which good holds (null doesn't), and n."""
    hit = F.avg(F.when(F.coalesce(good, F.lit(False)), 1.0).otherwise(0.0))
    aggs = (F.round(hit, digits).alias(name), F.count("*").alias("n"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and accuracy (null where there is nothing to divide by)."""
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)
    tn = F.count_if(~predicted & ~actual)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(tp + tn, F.count("*")), 6).alias("accuracy"),
    )


def ranking_metrics(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """ranked: query_id, rank, hit; totals: query_id, relevant (how many there are). Recall@k, MRR
    and top-1 hit rate over the queries that have something relevant; unanswered ones are misses."""
    top = ranked.where((F.col("rank") <= k) & F.col("hit"))
    hits = top.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"))
    all_ = totals.where("relevant > 0").join(hits, "query_id", "left")
    return all_.agg(
        F.round(F.avg(ratio(F.coalesce("hits", F.lit(0)), F.col("relevant"))), 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("best") == 1, 1.0).otherwise(0.0)), 6).alias("top1"),
        F.count("*").alias("queries"),
    )


def labelled_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """ranked: query, document, rank; labels as ``read_retrieval_labels`` gives them, one a query. A document counts as a
    hit if it is the expected one or an acceptable alternative. Shares of queries whose expected document, and
    any acceptable one, is among the first k; recall@k (hits by all that are acceptable), MRR and top-1 by acceptable
    documents. Queries without results are misses; labels without any document don't count."""
    accepted = F.array_distinct(F.array_compact(F.concat(F.array("expected_document"), F.coalesce("acceptable_alternatives", F.array().cast("array<string>")))))
    top = ranked.where(F.col("rank") <= k).groupBy("query", "document").agg(F.min("rank").cast("int").alias("rank")).groupBy("query").agg(F.collect_list(F.struct("document", "rank")).alias("_top"))
    # few documents a query are looked up in what may be many acceptable ones, which stay one row
    hits = F.filter(F.coalesce("_top", F.array().cast("array<struct<document:string,rank:int>>")), lambda x: F.array_contains("_accepted", x["document"]))
    l = labels.withColumn("_accepted", accepted).where(F.size("_accepted") > 0).join(top, "query", "left").withColumn("_hits", hits)  # noqa: E741
    all_ = l.select(
        F.size("_accepted").alias("relevant"), F.size("_hits").alias("hits"), F.array_min(F.transform("_hits", lambda x: x["rank"])).alias("best"), F.exists("_hits", lambda x: x["document"] == F.col("expected_document")).alias("exact")
    )
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return all_.agg(
        share(F.col("exact")).alias("expected_found"), share(F.col("best").isNotNull()).alias("acceptable_found"), F.round(F.avg(ratio(F.col("hits"), F.col("relevant"))), 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), share(F.col("best") == 1).alias("top1"), F.count("*").alias("queries"),
    )


def gate(baseline: DataFrame, candidate: DataFrame, fail_below: float = -0.02, review_cost: float = 0.2) -> DataFrame:
    """metric, value of two runs, compared: FAIL if quality falls by more than 2 points (or any
    unauthorized action appears), REVIEW if cost grows by more than 20 %, else PASS."""
    b, c = baseline.select("metric", F.col("value").alias("baseline")), candidate.select("metric", F.col("value").alias("candidate"))
    j = b.join(c, "metric", "full_outer").withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6))
    grown = ratio(F.col("candidate") - F.col("baseline"), F.col("baseline")) > review_cost
    verdict = (
        F.when(F.col("delta").isNull(), "REVIEW")
        .when((F.col("metric") == "unauthorized_rate") & (F.col("candidate") > 0), "FAIL")
        .when(F.col("metric").startswith("cost") & grown, "REVIEW")
        .when(~F.col("metric").startswith("cost") & (F.col("metric") != "unauthorized_rate") & (F.col("delta") < fail_below), "FAIL")
        .otherwise("PASS")
    )
    return j.withColumn("verdict", verdict)


def sets_difference(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Expected things that are missing, and prohibited overlap, as sorted text."""
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return df.withColumn("missing", text(F.array_except(expected, actual))).withColumn("extra", text(F.array_except(actual, expected)))
