"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if they share a seed, ``min_match`` words in a row.
Tiles are made of seeds, so the item words under shared seeds bound the coverage from above: pairs
whose bound is under the threshold are left out before any tiling, and without loss. For the same
reason an item's commonest seeds (in how many items each stands), as long as they cover too little of
it by themselves, can't make a finding alone: only the other seeds look for pairs, so that a phrase
of many items doesn't pair its documents with all of them.

For the pairs that are left the longest matches that don't overlap are marked again and again
(Karp-Rabin hashes of any length from running sums), wherever they stand in either text, so passages
count however they are reordered. A pair is a finding if tiles cover ``coverage`` of the item.

An item of fewer than ``min_match`` words has one seed, its whole sequence of words, and is tiled with
that length: a document that holds it anywhere is a finding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed, text_or_empty
from ledgerlens.llm.words import grams, mixed, word_hashes
from ledgerlens.sources.tables import table

MIN_MATCH = 5
COVERAGE = 0.5
#: Seeds of the benchmark up to which they are broadcast (8 bytes each) to leave out other seeds early.
MOST_BROADCAST = 1_000_000
_BASE = 0x9E3779B97F4A7C15


class _Runs:
    """Hashes of any run of words: sums of words times powers of an odd base, modulo 2**64."""

    def __init__(self, words: np.ndarray):
        self.marked = np.zeros(len(words), bool)
        up, down = (np.full(len(words) + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(up, dtype=np.uint64)[:-1])])

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of n words of which none is marked."""
        if len(self.marked) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, mixed((self.sums[at + n] - self.sums[at]) * self.down[at])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length), longest first, none overlapping another in either text;
    of equal lengths the first in the item, then in the document. item and doc are hashes of words,
    which stand for the words."""
    # Only words of shared seeds can be in tiles: the others go, but for one after each stretch, marked.
    hit = np.isin(grams(doc, min_match), grams(item, min_match))
    if not hit.any():
        return []
    edges = np.zeros(len(doc) + 2, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + min_match, -1)
    under = np.cumsum(edges)[: len(doc) + 1] > 0
    kept = np.flatnonzero(under | np.concatenate([[False], under[:-1]]))
    a, b, tiles = _Runs(item), _Runs(np.concatenate([doc, [np.uint64(0)]])[kept]), []
    b.marked[:] = ~under[kept]
    low, high = min_match, min(len(item), len(kept))
    while True:
        found = None
        while low <= high:  # the greatest length with a match; a match of n words holds matches of fewer
            n = (low + high + 1) // 2 if found is not None else low
            (s, x), (d, y) = a.free(n), b.free(n)
            shared = np.isin(x, y)
            if shared.any():
                found, low = (n, s[shared], x[shared], d, y), n
                if low == high:
                    break
            else:
                high = n - 1
        if found is None:
            return tiles
        n, s, x, d, y = found
        order = np.argsort(y, kind="stable")
        d, y = d[order], y[order]
        for start, left, right in zip(s.tolist(), np.searchsorted(y, x, "left").tolist(), np.searchsorted(y, x, "right").tolist(), strict=True):
            if a.marked[start : start + n].any():
                continue
            taken = np.concatenate([[0], np.cumsum(b.marked)])
            places = d[left:right]
            places = places[taken[places + n] == taken[places]]
            if len(places):
                a.marked[start : start + n] = b.marked[places[0] : places[0] + n] = True
                tiles.append((start, int(kept[places[0]]), n))
        low, high = min_match, n


def _sized(h: np.ndarray, n: int, min_match: int) -> np.ndarray:
    """Hashes of n words; those of fewer than min_match scrambled again by their length."""
    return h if n == min_match else mixed(h ^ np.uint64(n))


def _seeds(rows: DataFrame, keys: list[str], wanted: np.ndarray | None, min_match: int, lengths: list[int] | None) -> DataFrame:
    """keys, n_words, and the hashes of min_match words in a row; only of wanted ones, if given. Hashes
    of runs of these lengths too, or, without lengths, of the whole of a text of fewer words."""
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)
    names = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = None
        if shared is not None:
            sieve = np.zeros(1 << 24, bool)
            sieve[shared.value & np.uint64((1 << 24) - 1)] = True
        for batch in batches:
            n, out = [], []
            for text in batch.column("text"):
                words = word_hashes(text.as_py())
                sizes = (min_match, *lengths) if lengths is not None else (max(1, min(min_match, len(words))),)
                h = np.concatenate([_sized(grams(words, k), k, min_match) for k in sizes])
                if sieve is not None:
                    h = h[sieve[h & np.uint64((1 << 24) - 1)]]
                    h = np.unique(h[np.isin(h, shared.value)]) if len(h) else h
                n.append(len(words))
                out.append(h.view(np.int64))
            ends = np.cumsum([0, *map(len, out)])
            flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[*keys, "n_words", "seeds"])

    return rows.mapInArrow(seeds, f"{names}, n_words long, seeds array<long>")


def leaders(places: list[tuple[int, int]], least: float, min_match: int) -> list[bool]:
    """Of an item's seeds (position, how many items hold it) those that look for documents: all but
    the commonest that together cover fewer than ``least`` words."""
    out, covered = [True] * len(places), set()
    for i in sorted(range(len(places)), key=lambda i: (-places[i][1], places[i][0])):
        covered.update(range(places[i][0], places[i][0] + min_match))
        if len(covered) >= least:
            break
        out[i] = False
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """One row per document and benchmark item whose tiles cover at least coverage of the item:
    doc_id, item_id, item_words, tiled_words, coverage, n_tiles, longest_tile.

    Null texts are empty and match nothing, nor do items without words. Items of fewer than min_match words
    match where all of them stand in a row. Null ids are ids like others, and no id's value changes. Rows that repeat both id and text
    are one document; a doc_id with several texts has the rows of each. Empty tables give no rows;
    further columns are ignored."""
    texts = needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = needed(benchmark, "item_id", "text").select("item_id", text_or_empty(F.col("text")).alias("text")).distinct().withColumn("item_hash", F.xxhash64("text"))
    item_rows = materialize(_seeds(items, ["item_id", "item_hash"], None, min_match, None).withColumn("item", F.monotonically_increasing_id()), "tiling-items")
    places = item_rows.select("item", "n_words", F.posexplode("seeds").alias("pos", "seed"))
    common = places.groupBy("seed").agg(F.count_distinct("item").alias("held"))
    by_item = places.join(common, "seed").groupBy("item", "n_words").agg(F.sort_array(F.collect_list(F.struct("pos", "seed", "held"))).alias("places"))
    pick = F.udf(lambda ps, n: leaders([(p["pos"], p["held"]) for p in ps], n * coverage, min_match), "array<boolean>")
    picked = by_item.select("item", "n_words", F.explode(F.arrays_zip("places", pick("places", "n_words").alias("leads"))).alias("p"))
    item_seeds = materialize(picked.select("item", "n_words", F.col("p.places.pos").alias("pos"), F.col("p.places.seed").alias("seed"), F.col("p.leads").alias("leads")), "tiling-seeds")

    lengths = sorted(r["n_words"] for r in item_rows.where(F.col("n_words").between(1, min_match - 1)).select("n_words").distinct().collect())  # fewer than min_match rows
    few = item_seeds.select("seed").distinct().limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    wanted = np.array([r[0] for r in item_seeds.select("seed").distinct().collect()], np.int64).view(np.uint64) if few else None
    doc_rows = _seeds(texts.select("doc_id", "text_hash", "text"), ["doc_id", "text_hash"], wanted, min_match, lengths).where(F.size("seeds") > 0)
    doc_rows = materialize(doc_rows.select("doc_id", "text_hash", F.array_distinct("seeds").alias("seeds")).distinct().withColumn("doc", F.monotonically_increasing_id()), "tiling-documents")
    doc_seeds = doc_rows.select("doc", F.explode("seeds").alias("seed"))

    # Item words under shared seeds: each seed adds what lies before the next one, min_match at most.
    led = doc_seeds.join(item_seeds.where("leads").select("item", "seed").distinct(), "seed").select("doc", "item").distinct()
    hits = led.join(doc_seeds, "doc").join(item_seeds, ["item", "seed"]).groupBy("doc", "item", "n_words").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    gaps = F.zip_with(F.slice("at", 2, F.size("at") - 1), F.slice("at", 1, F.size("at") - 1), lambda b, a: F.least(b - a, F.lit(min_match)))
    bound = F.aggregate(gaps, F.lit(min_match), lambda acc, g: acc + g)
    near = hits.where(bound >= F.col("n_words") * coverage).select("doc", "item")
    pairs = near.join(doc_rows.select("doc", "doc_id", "text_hash"), "doc").join(item_rows.select("item", "item_id", "item_hash"), "item")
    pairs = materialize(pairs.select("doc_id", "text_hash", "item_id", "item_hash"), "tiling-pairs")

    small = pairs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    p, d, i = pairs.alias("p"), texts.alias("d"), items.alias("i")
    with_doc = d.join(F.broadcast(p) if small else p, F.col("d.text_hash").eqNullSafe(F.col("p.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")))
    both = with_doc.join(i, (F.col("p.item_hash") == F.col("i.item_hash")) & F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select(
        F.col("d.doc_id").alias("doc_id"), F.col("i.item_id").alias("item_id"), F.col("d.text").alias("doc"), F.col("i.text").alias("item")
    )
    kinds = dict(both.dtypes)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item in zip(batch.column("doc"), batch.column("item"), strict=True):
                words = word_hashes(item.as_py())
                tiles = greedy_tiles(words, word_hashes(doc.as_py()), max(1, min(min_match, len(words))))
                covered = sum(k for _, _, k in tiles)
                rows.append((len(words), covered, covered / max(1, len(words)), len(tiles), max([k for _, _, k in tiles], default=0)))
            found = [pa.array([r[j] for r in rows], pa.float64() if j == 2 else pa.int64()) for j in range(5)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), *found], names=["doc_id", "item_id", "item_words", "tiled_words", "coverage", "n_tiles", "longest_tile"])
            yield out.filter(pa.array([r[2] >= coverage for r in rows], pa.bool_()))

    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, item_words long, tiled_words long, coverage double, n_tiles long, longest_tile long"
    return both.mapInArrow(tile, schema).distinct()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
