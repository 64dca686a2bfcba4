"""What the text operators share: written tables, small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import new_folder

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
#: The same as regular-expression text that is valid for a negated class.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, so that an executor
    lost later costs a reread and not a recomputation, and generated ids stay what they were."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def needed(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, taken by position of their exact names: extra columns never clash with
    what an operator adds. A column the input lacks comes as null of type string (bigint for ids)."""
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    pick = []
    for c in columns:
        if c in have:
            pick.append(F.col(f"c{have[c]}").alias(c))
        else:
            pick.append(F.lit(None).cast("bigint" if c.endswith("_id") else "string").alias(c))
    return flat.select(*pick)


def broadcast_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it is counted to have few rows. For narrow tables of ids."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lowest(df: DataFrame, place: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the lowest ``place``, a 64-bit hash of what tells rows apart. Rows above the value
    under which 2n rows are expected are left out first: else every task would send n rows of its own."""
    rows = df.count()
    if rows > 4 * n:
        df = df.where(F.col(place) < F.lit((2 * n << 64) // rows - (1 << 63)))
    return df.orderBy(place, *ties).limit(n)


def opened(uri: str):
    """A file system and a path in it, for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (doc_id; nulls match nulls). The texts are
    shuffled only where there are more ids than may be broadcast."""
    gone = broadcast_if_small(materialize(ids.select(F.col("doc_id").alias("_gone_id")).distinct(), "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]), "left_anti")


#: The column of row ids that a pipeline stage gives its rows.
ROW = "_row_id"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a row id, written once so that every later read has the same ids."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def by_row(rows: DataFrame) -> DataFrame:
    """What an operator reads of numbered rows: the row id in the place of doc_id, and the text."""
    return needed(rows, ROW, "text").select(F.col(ROW).alias("doc_id"), "text")


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered rows less those whose row id is in gone, with the columns they had before numbering.
    The texts are shuffled only where there are more ids than may be broadcast."""
    ids = broadcast_if_small(materialize(gone.select(ROW).distinct(), "gone"))
    return rows.join(ids, ROW, "left_anti").drop(ROW)


def all_but_first(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Row ids of all rows of a group but one, which is that of the smallest doc_id (nulls last,
    ties by row id). members has a row and its group, one of the group's row ids, for each row that
    isn't its group's namesake."""
    members = materialize(members.select(ROW, "group"), "group-members")
    every = members.unionByName(members.select(F.col("group").alias(ROW), "group").distinct())
    placed = materialize(rows.select(ROW, "doc_id").join(broadcast_if_small(materialize(every, "group-rows")), ROW), "groups")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return placed.select(ROW).join(first, ROW, "left_anti")
