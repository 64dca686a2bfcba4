"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources in order of code point (null last) have weights 5, 2, 1, repeating. Together they
share all words; a target stops at ``max_passes`` times its source's words and the excess is shared
anew by weight. That is least(cap, level * weight) for the one level at which all is shared.

Schedule: slot i gets the i-th van der Corput point (i's bits reversed), which is mapped through the
sources' cumulative numbers of wanted blocks. A source's slots are ranked in slot order, and its
r-th slot takes the r-th of its blocks, again from the first after the last one. Blocks cut a
source's documents, in shuffled (hashed) order, into equal numbers of words. So at any point of the
schedule each source has had its share within a few blocks.

No source is ranked or summed by one task: slots are ranked in ranges of ``CHUNK`` slots and
documents in hash buckets, with counts carried over ranges and buckets. One row per source, per
range or per bucket is all that a source's window holds. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import NOT_SPACE, SPACE, materialize, needed, text_or_empty
from ledgerlens.sources.tables import table

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 32
SEED = "mix-1"
CHUNK = 4096
SLOTS_A_TASK = 1_000_000
BITS = 52


def word_count(text):
    """Runs of characters other than ASCII white space, without making an array of them."""
    norm = F.trim(F.regexp_replace(text_or_empty(text), SPACE, " "))
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def _point(i):
    """i's low BITS bits in reverse order: the van der Corput point times 2**BITS."""
    x = i
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - BITS)


def stretches(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per distinct (doc_id, source, size) with its place in the source's shuffled stream of
    words: copies, start, length (size times copies), and the source's number from 0."""
    sized = needed(docs, "doc_id", "source", "text").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h")
    )
    units = sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")).withColumn("bucket", F.substring("h", 1, 3))
    units = materialize(units, "mix-units")
    sums = units.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    return placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "source", "size", "copies", (F.col("offset") + F.col("inside")).alias("start"), (F.col("size") * F.col("copies")).alias("length")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds number, target, n_blocks and lo, hi: the
    source's range of wanted blocks on the line of all of them. One row per source in all."""
    every = Window.partitionBy(F.lit(1))
    number = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("number", number).withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_passes)
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))
    shares = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))
    t = t.withColumn("level", left / shares).withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("hi", F.sum(wanted).over(every.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("number")), F.lit(0.0)))
    return t.select("source", "number", "source_size", "target", "n_blocks", "lo", "hi")


def schedule(spark: SparkSession, shares: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """The schedule: slot, number (the source's), pass, block. shares: what targets() gives."""
    total = shares.agg(F.max("hi")).first()[0] or 0.0
    n = int(-(-total // 1))
    if n >= 2**BITS:
        raise ValueError(f"{n} slots need more than {BITS} bits; take larger blocks")
    cells = CHUNK
    slots = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n // SLOTS_A_TASK + 1)).select(F.col("id").alias("slot"), (_point(F.col("id")) / F.lit(float(2**BITS)) * F.lit(total)).alias("at"))
    slots = slots.withColumn("cell", F.floor(F.col("at") / F.lit(total or 1.0) * cells).cast("long"))
    spans = shares.where("hi > lo").select(
        "number", "n_blocks", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / F.lit(total or 1.0) * cells).cast("long"), F.floor(F.col("hi") / F.lit(total or 1.0) * cells).cast("long"))).alias("cell"),
    )
    mapped = slots.join(spans, "cell").where("at >= lo and at < hi").select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), "number", "n_blocks")
    mapped = materialize(mapped, "mix-slots")
    counts = mapped.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("number", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("number", "chunk").orderBy("slot")
    ranked = mapped.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["number", "chunk"]).withColumn("r", F.col("r") + F.col("offset"))
    return ranked.where(F.col("r") < F.col("n_blocks") * max_passes).select(
        "slot", "number", F.floor(F.col("r") / F.col("n_blocks")).cast("int").alias("pass"), (F.col("r") % F.col("n_blocks")).alias("block")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes).

    Null texts have size 0 and nothing is taken of them; a null source is a source, the last one; a
    null doc_id is an id like others. Rows that agree in doc_id, source and size stand side by side
    in the stream and share what is taken of them, to within a word. An empty table gives no rows;
    further columns are ignored. Where the line of wanted blocks gives a source one block more than
    max_passes times all of its blocks, that block is left out."""
    spark = docs.sparkSession
    placed = materialize(stretches(docs, seed), "mix-stretches")
    shares = materialize(targets(placed.groupBy("source").agg(F.sum("length").alias("source_size")), weights, max_passes, block_words), "mix-targets")
    uses = schedule(spark, shares, max_passes).groupBy("number", "block").agg(F.count("*").alias("uses"))
    known = placed.join(F.broadcast(shares) if _small(shares) else shares, placed.source.eqNullSafe(shares.source)).drop(shares.source)
    pieces = (
        known.where("length > 0")
        .select("doc_id", "source", "size", "number", "start", "length", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("length") - 1) / block_words))).alias("block"))
        .withColumn("words", F.least(F.col("start") + F.col("length"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words))
    )
    taken = pieces.join(uses, ["number", "block"]).groupBy("number", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # A stretch of words is known by its source and start; stretches without words are known by none.
    nonempty = known.where("length > 0").join(taken, ["number", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    empty = known.where("length = 0").withColumn("taken", F.lit(0).cast("long"))
    rows = nonempty.unionByName(empty, allowMissingColumns=False).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    share = F.floor(F.col("taken") * F.col("copy") / F.col("copies")) - F.floor(F.col("taken") * (F.col("copy") - 1) / F.col("copies"))
    return rows.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))


def _small(shares: DataFrame, most: int = 100_000) -> bool:
    """Few enough sources to broadcast their table."""
    return shares.limit(most + 1).count() <= most


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}')) AS size, md5('{SEED}:' || doc_id) AS h FROM documents
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source
), s1 AS (
  SELECT *, [5.0, 2.0, 1.0][number % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * {MAX_PASSES} AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s1 WINDOW w AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, least(cap, max(level) OVER () * weight) AS target, ceil(source_size / {BLOCK_WORDS}.0)::BIGINT AS n_blocks FROM s2
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS wanted FROM s3
), s5 AS (
  SELECT *, sum(wanted) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS hi FROM s4
), s6 AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY number), 0) AS lo FROM s5
), slots AS (
  SELECT i AS slot, list_sum(list_transform(range(0, {BITS}), lambda b: ((i >> b) & 1)::DOUBLE * (1::BIGINT << ({BITS} - 1 - b))::DOUBLE)) / {2**BITS}::DOUBLE * t.total AS x
  FROM (SELECT max(hi) AS total FROM s6) t, unnest(range(0, ceil(t.total)::BIGINT)) AS r(i)
), ranked AS (
  SELECT number, n_blocks, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS r FROM slots JOIN s6 ON x >= lo AND x < hi
), uses AS (
  SELECT number, r % n_blocks AS block, count(*) AS uses FROM ranked WHERE r < n_blocks * {MAX_PASSES} GROUP BY 1, 2
), pieces AS (
  SELECT p.doc_id, number, b AS block, least(start + size, (b + 1) * {BLOCK_WORDS}) - greatest(start, b * {BLOCK_WORDS}) AS words
  FROM placed p JOIN s6 ON p.source IS NOT DISTINCT FROM s6.source, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS e(b)
  WHERE size > 0
), taken AS (
  SELECT doc_id, sum(words * uses) AS taken FROM pieces JOIN uses USING (number, block) GROUP BY doc_id
)
SELECT p.doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed p JOIN s6 ON p.source IS NOT DISTINCT FROM s6.source LEFT JOIN taken USING (doc_id)
"""
