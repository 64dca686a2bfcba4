"""Scenario evaluation: what was expected against what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.metrics import rate


def succeeded() -> Column:
    """All expected tools executed and no prohibited one."""
    return (F.size(F.array_except("expected", "executed")) == 0) & ~F.arrays_overlap("prohibited", "executed")


def success(scenarios: DataFrame) -> DataFrame:
    """Task success by category, and over all (category null)."""
    ok = F.round(F.avg(F.when(succeeded(), 1.0).otherwise(0.0)), 6)
    return scenarios.rollup("category").agg(ok.alias("rate"), F.count("*").alias("n"))


def tool_selection(scenarios: DataFrame) -> DataFrame:
    """By category: mean share of expected tools that were asked for, and the share of scenarios that
    asked for exactly the expected ones."""
    share = F.size(F.array_intersect("expected", "asked")) / F.size("expected")
    exact = (F.size(F.array_except("expected", "asked")) == 0) & (F.size(F.array_except("asked", "expected")) == 0)
    return scenarios.groupBy("category").agg(F.round(F.avg(share), 6).alias("selected"), F.round(F.avg(F.when(exact, 1.0).otherwise(0.0)), 6).alias("exact"), F.count("*").alias("n"))


def argument_accuracy(scenarios: DataFrame, calls: DataFrame, expected_argument: Column) -> DataFrame:
    """By category and expected tool: of the scenarios that called it, how many gave the expected argument
    in their first call of it. Nulls equal nulls only."""
    first = calls.groupBy("customer_id", "tool").agg(F.min_by("resource", F.struct("ts", "call_id")).alias("resource"))
    wanted = scenarios.select("customer_id", "category", F.explode("expected").alias("tool"))
    return rate(wanted.join(first, ["customer_id", "tool"]), F.col("resource").eqNullSafe(expected_argument), ["category", "tool"])


def violations(scenarios: DataFrame) -> DataFrame:
    """Scenarios in which prohibited tools were executed, and which."""
    hit = F.array_join(F.array_sort(F.array_intersect("prohibited", "executed")), ",")
    return scenarios.where(F.arrays_overlap("prohibited", "executed")).select("customer_id", "category", hit.alias("tools"))


def cheapest(runs: DataFrame, by: list[str], least: float) -> DataFrame:
    """runs: by, model, success, cost. The cheapest model of each group whose success is at least least
    (ties by name); null where none is."""
    good = F.when(F.col("success") >= least, F.struct("cost", "model"))
    return runs.groupBy(*by).agg(F.min(good).alias("best"), F.count("*").alias("models")).select(*by, F.col("best.model").alias("model"), F.col("best.cost").alias("cost"), "models")
