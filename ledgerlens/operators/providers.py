"""What a language model looks like to the engine: any object with generate(); none is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.decisions import decide
from ledgerlens.sources.scratch import new_folder


class Reply(NamedTuple):
    """What a model says: an answer, or a tool that it asks for with an argument."""

    answer: str | None = None
    tool: str | None = None
    argument: str | None = None


class LLMProvider(Protocol):
    """Answers of prompts, in order. Raises TimeoutError or ConnectionError where another try may help."""

    def generate(self, prompts: list[str]) -> list[str]: ...

    def generate_with_tools(self, transcripts: list[list[str]], tools: list[str]) -> list[Reply]:
        """A reply to each transcript: the prompt, then what each tool said."""

    def stream(self, prompt: str) -> Iterator[str]:
        """An answer in parts."""


def answered(df: DataFrame, prompt: str, make: Callable[[], LLMProvider], attempts: int = 3) -> DataFrame:
    """df with answer and error (text): prompts go in Arrow batches to a provider that each worker makes
    once. A batch that fails for a passing reason is sent again, attempts times at most; what then fails
    keeps its error and no answer. Null prompts are not sent and have neither."""

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            asked = batch.dropna()
            answers, error = [None] * len(asked), None
            for _ in range(attempts if len(asked) else 0):
                try:
                    answers, error = provider.generate(list(asked)), None
                    break
                except (TimeoutError, ConnectionError) as failed:
                    error = type(failed).__name__
            out = pd.DataFrame({"answer": pd.Series(answers, index=asked.index, dtype=object), "error": pd.Series(error, index=asked.index, dtype=object)})
            yield out.reindex(batch.index)

    return df.withColumn("_said", run(F.col(prompt))).withColumn("answer", F.col("_said.answer")).withColumn("error", F.col("_said.error")).drop("_said")


def streamed(df: DataFrame, key: str, prompt: str, make: Callable[[], LLMProvider]) -> DataFrame:
    """Partial answers: key, part (from 0) and text, and one last row a prompt with no text, whose part is
    the number of parts and whose error is what broke the stream off, if anything did. Rows leave as the
    provider gives them, a few hundred at a time. Null prompts have no rows."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, rows = make(), []
        for batch in batches:
            for name, text in zip(batch[key], batch[prompt], strict=True):
                n, error = 0, None
                try:
                    for part in provider.stream(text):
                        rows.append((name, n, part, None))
                        n += 1
                        if len(rows) >= 512:
                            yield pd.DataFrame(rows, columns=[key, "part", "text", "error"])
                            rows = []
                except (TimeoutError, ConnectionError) as failed:
                    error = type(failed).__name__
                rows.append((name, n, None, error))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "part", "text", "error"])

    return df.where(F.col(prompt).isNotNull()).select(key, prompt).mapInPandas(run, f"{key} {kind}, part long, text string, error string")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_tools(requests: DataFrame, tools: DataFrame, owners: DataFrame, lookups: dict[str, Callable[[DataFrame], DataFrame]], make: Callable[[], LLMProvider], rounds: int = 4) -> DataFrame:
    """The tool loop, as rounds of a fixpoint over all requests.

    requests: request_id, customer_id, authenticated, confirmed, prompt. owners: resource (string) and
    resource_owner. lookups give, for calls (request_id, customer_id, argument), a row request_id, result.
    In a round every open transcript gets one reply. Answers close a request. Tools that are asked for
    become calls, which ``decide()`` passes or refuses, as any other call: what a model or a tool says
    is no input of a decision. Executed calls are joined with their tool's lookup; what it found (or
    ``nothing``), or the layer that refused the call, is the transcript's next line. Rounds go on until
    no request is open, ``rounds`` at most; each is written, so lineage and memory don't grow with them.

    Returns request_id, outcome (answered, round_limit or failed, where the provider broke off), answer,
    rounds, calls, denied and trail (tool:outcome of each call, in order). Null prompts fail unasked."""
    names = [r["tool"] for r in tools.select("tool").orderBy("tool").collect()]  # the catalogue

    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            lines = [list(t) for t in batch]
            asked = [i for i, t in enumerate(lines) if t[0] is not None]
            said, error = [Reply()] * len(lines), None
            for _ in range(3 if asked else 0):
                try:
                    for i, r in zip(asked, provider.generate_with_tools([lines[i] for i in asked], names), strict=True):
                        said[i] = r
                    error = None
                    break
                except (TimeoutError, ConnectionError) as failed:
                    error = type(failed).__name__
            yield pd.DataFrame({"answer": [r.answer for r in said], "tool": [r.tool for r in said], "argument": [r.argument for r in said], "error": error}, dtype=object)

    ask = F.pandas_udf(reply, "answer string, tool string, argument string, error string")
    state = requests.select("request_id", "customer_id", "authenticated", "confirmed", F.array("prompt").alias("transcript"), F.array().cast("array<string>").alias("trail"), F.lit(0).alias("denied"))
    done = []
    for number in range(1, rounds + 1):
        said = _written(state.withColumn("r", ask("transcript")), f"tool-round-{number}")
        closed = F.col("r.tool").isNull()
        outcome = F.when(F.col("r.answer").isNotNull(), "answered").otherwise("failed")
        done.append(said.where(closed).select("request_id", outcome.alias("outcome"), "r.answer", F.lit(number).alias("rounds"), "trail", "denied"))
        wants = said.where(~closed).select("request_id", "customer_id", "authenticated", "confirmed", "transcript", "trail", "denied", "r.tool", "r.argument")
        if wants.isEmpty():
            break
        owned = wants.join(owners, F.col("argument") == F.col("resource"), "left").withColumn("arguments_valid", F.col("resource").isNotNull() | ~F.col("tool").isin(list(lookups)))
        calls = _written(decide(owned, tools).select(*wants.columns, "outcome", "failed_layer"), f"tool-calls-{number}")
        found = None
        for name, lookup in lookups.items():
            one = lookup(calls.where((F.col("tool") == name) & (F.col("outcome") == "executed")).select("request_id", "customer_id", "argument")).select("request_id", "result")
            found = one if found is None else found.unionByName(one)
        heard = calls.join(found, "request_id", "left") if found is not None else calls.withColumn("result", F.lit(None).cast("string"))
        line = F.when(F.col("outcome") == "executed", F.coalesce("result", F.lit("nothing"))).otherwise(F.concat(F.lit("refused: "), "failed_layer"))
        state = heard.select(
            "request_id", "customer_id", "authenticated", "confirmed",
            F.array_append("transcript", line).alias("transcript"),
            F.array_append("trail", F.concat("tool", F.lit(":"), "outcome")).alias("trail"),
            (F.col("denied") + (F.col("outcome") != "executed").cast("int")).alias("denied"),
        )
    else:
        done.append(state.select("request_id", F.lit("round_limit").alias("outcome"), F.lit(None).cast("string").alias("answer"), F.lit(rounds).alias("rounds"), "trail", "denied"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("request_id", "outcome", "answer", "rounds", F.size("trail").alias("calls"), "denied", F.array_join("trail", ",").alias("trail"))
