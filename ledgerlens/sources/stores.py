"""Sources and sinks: chunk store, logs, handoffs, audit trail, scenarios, audio, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.scenario_files import ScenarioFiles

LOG_SCHEMA = "trace_id string, session_id string, turn_id string, event string, ts timestamp, tool string, duration_ms long, success boolean"
LABEL_SCHEMA = "query string, expected_document string, expected_section string, acceptable_alternatives array<string>"
SCENARIOS_PER_FILE = 2000


def write_chunks(chunks: DataFrame, path: str, category: str = "policy_category") -> None:
    """Parquet by category, so that a retrieval filtered by category reads only its folder."""
    chunks.write.mode("append").partitionBy(category).parquet(path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_policy_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Policy documents as JSON lines, in folders by category or not. The schema is given, not inferred."""
    return spark.read.schema(schema).json(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Append only, by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_logs(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Structured logs with a fixed schema; lines that don't parse keep their text in _corrupt."""
    schema = T._parse_datatype_string(LOG_SCHEMA).add("_corrupt", T.StringType())
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_handoffs(handoffs: DataFrame, path: str) -> None:
    handoffs.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def write_audit(records: DataFrame, path: str) -> None:
    """Append only: records are never changed."""
    records.write.mode("append").parquet(path)


def write_scenarios(documents: DataFrame, path: str, per_file: int = SCENARIOS_PER_FILE) -> None:
    """Scenario documents (one column of text) in files of at most per_file, as a file is read by one task."""
    documents.write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def read_scenarios(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Scenario documents of a file or folder, YAML or JSON lines, each file in a task of its own: path,
    number, the scenario's fields, and error for documents that can't be read."""
    spark.dataSource.register(ScenarioFiles)
    reader = spark.read.format("scenarios")
    return (reader if kind is None else reader.option("format", kind)).load(path)


def read_retrieval_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).json(path)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Stored audio fixtures: path, bytes and content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), "content")


def readiness(expected: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: whether its columns are all there and hold no nulls, which are missing, its rows, and
    the nulls in the columns that are there."""
    out = None
    for name, (df, columns) in sorted(expected.items()):
        missing, there = [c for c in columns if c not in df.columns], [c for c in columns if c in df.columns]
        nulls = sum((F.count_if(F.col(c).isNull()) for c in there), F.lit(0).cast("long"))
        one = df.agg(F.count("*").alias("n_rows"), nulls.alias("nulls")).select(F.lit(name).alias("table_name"), (F.lit(not missing) & (F.col("nulls") == 0)).alias("ready"), F.lit(",".join(missing)).alias("missing"), "n_rows", "nulls")
        out = one if out is None else out.unionByName(one)
    return out


def migrate(df: DataFrame, version: int, schema: T.StructType) -> DataFrame:
    """df in the shape of a schema: columns by name, cast, missing ones null; with schema_version."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(version).alias("schema_version"))
