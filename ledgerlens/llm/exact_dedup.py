"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of ``block_chars`` code points. The distinct blocks are
sorted and get integer names; then adjacent pairs of names are sorted and named, level by level,
until each document has one name. Two documents have the same (block count, name) exactly if
their normalised texts are identical.

At the block level the sort key is (64-bit fingerprint, rank of the content under it). A fingerprint
that occurs in one place needs no content beside it: blocks that differ in fingerprint differ. Only
blocks under fingerprints that occur again are compared by content; where these fingerprints are few
enough to broadcast, the others' contents don't leave their tasks. Contents are made distinct before
their shuffle. So two blocks with one fingerprint still get two names and names are free of collisions.

All other shuffles carry integers; hot names (one block in a third of all rows) are met by map-side partial
aggregation on the naming side and, as both sides of each join back are read from written tables,
by Spark's skew join on the other. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, broadcast_if_small, materialize, needed, text_or_empty
from ledgerlens.sources.tables import table

BLOCK_CHARS = 4096


def _blocks(text, block_chars: int):
    """The blocks of a text in order; an empty text has one empty block."""
    found = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def _named(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct keys with integer names in sort order: range partitions, each sorted; a name is the
    partition's number and the row's place in it."""
    ordered = keys.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def _contents(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """The distinct (print, block) under repeated fingerprints, of rows print, block."""
    few = broadcast_if_small(repeated)
    if few is not repeated:
        return blocks.join(few, "print", "left_semi").distinct()
    # Too many to broadcast: distinct first, so that a hot block travels once a task.
    return blocks.distinct().join(repeated, "print", "left_semi")


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns rid (one per row), doc_id, text_sha256, n_blocks, name. Rows have equal
    (n_blocks, name) exactly if their normalised texts are equal; null texts count as empty."""
    texts = needed(docs, "doc_id", "text").select("doc_id", F.regexp_replace(text_or_empty(F.col("text")), SPACE, " ").alias("norm"))
    cut = texts.select("doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), _blocks(F.col("norm"), block_chars).alias("blocks"))
    printed = cut.withColumn("prints", F.transform("blocks", lambda b: F.xxhash64(b))).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(printed.drop("blocks"), "dedup-rows")
    places = rows.select("rid", F.posexplode("prints").alias("pos", "print"))

    # Blocks whose fingerprint occurs again: rank the different contents under it.
    repeated = materialize(places.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "dedup-repeated")
    contents = _contents(cut.select(F.explode("blocks").alias("block")).select(F.xxhash64("block").alias("print"), "block"), repeated)
    per_print = contents.groupBy("print").agg(F.sort_array(F.collect_list("block")).alias("contents"))
    clashes = materialize(per_print.where(F.size("contents") > 1), "dedup-clashes")
    if clashes.isEmpty():
        leveled = places.withColumn("k", F.lit(0))
    else:
        # Seldom: rows are written anew with their blocks, so that a block and its place have one row id.
        whole = materialize(printed, "dedup-rows")
        rows = whole.drop("blocks")
        placed = whole.select("rid", F.posexplode(F.arrays_zip("prints", "blocks")).alias("pos", "b")).select("rid", "pos", F.col("b.prints").alias("print"), F.col("b.blocks").alias("block"))
        ranked = placed.join(clashes, "print", "left").withColumn("k", F.coalesce(F.array_position("contents", F.col("block")), F.lit(0)))
        leveled = materialize(ranked.select("rid", "pos", "print", "k"), "dedup-ranked")

    names = _named(leveled.select("print", "k"), ["print", "k"], "dedup-names")
    level = materialize(leveled.join(names, ["print", "k"]).select("rid", "pos", "name"), "dedup-level")

    # Name adjacent pairs until one name is left of each document.
    most = rows.agg(F.max(F.size("prints"))).first()[0] or 1
    done = []
    while most > 1:
        halves = level.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
            F.max("pos").alias("last"),
        )
        pairs = materialize(halves.select("rid", "pos", "a", F.coalesce("b", F.lit(-1)).alias("b"), "last"), "dedup-pairs")
        # A document with one block left has one pair (name, -1) at place 0 and keeps its name.
        done.append(pairs.where("last = 0").select("rid", F.col("a").alias("name")))
        pairs = pairs.where("last > 0 or pos > 0")
        names = _named(pairs.select("a", "b"), ["a", "b"], "dedup-names")
        level = materialize(pairs.join(names, ["a", "b"]).select("rid", "pos", "name"), "dedup-level")
        most = (most + 1) // 2
    last = level.select("rid", "name")
    for part in done:
        last = last.unionByName(part)
    return rows.select("rid", "doc_id", "text_sha256", F.size("prints").alias("n_blocks")).join(last, "rid")


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal to each other. A null doc_id is a row
    like others: it is never the smallest unless all of its group are null, and then keep_id is
    null and all of these rows stay. Rows that repeat a doc_id with the same text each count in
    group_size and share kept. An empty table gives no rows; further columns are ignored."""
    named = materialize(identities(docs, block_chars), "dedup-identities")
    groups = materialize(named.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
