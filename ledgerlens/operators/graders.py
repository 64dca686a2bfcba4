"""Deterministic rules first, then an injected semantic grader, kept apart by grader_kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graded(answers: DataFrame, text: str, rules: dict[str, Column], semantic: Callable[[list[str]], list[float]], least: float) -> DataFrame:
    """answers with grader_kind and passed. An answer that breaks a rule is failed by the rules and
    never reaches the semantic grader; others pass with a semantic score of least or more."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(semantic(list(batch.fillna(""))), dtype="float64")

    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(False))
    ruled = answers.withColumn("_ok", ok)
    failed = ruled.where(~F.col("_ok")).withColumns({"grader_kind": F.lit("deterministic"), "semantic_score": F.lit(None).cast("double"), "passed": F.lit(False)})
    scored = ruled.where("_ok").withColumns({"grader_kind": F.lit("semantic"), "semantic_score": score(F.col(text))})
    return failed.unionByName(scored.withColumn("passed", F.col("semantic_score") >= least)).drop("_ok")
