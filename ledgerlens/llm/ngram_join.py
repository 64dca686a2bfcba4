"""N-gram Jaccard join with parity sketches.

A text's set holds its distinct shingles. Texts with the same set are one node. Two nodes link when
their sets' Jaccard similarity is at least ``percent``/100; then their symmetric difference has at
most d elements, where d follows from the two sizes.

XOR-hashing shingles into bits gives parity sketches: a bit differs only if an element of the
symmetric difference fell on it, so Hamming distance bounds that difference from below. For each band
of sizes the shingles are dealt into pieces, so many that d differences leave at least one with at most
one difference; a piece is dealt into three parts, of which one difference leaves two alike. So nodes
that link share the sketches of two parts of some piece (pigeonhole). A part's sketch is sparse and as
long as the hashes allow; it is held as the XOR of its shingles' hashes. Two parts' sketches are a join
key. Nodes near the lower end of a band also take part in the band below.

Parts that hold next to nothing are alike by chance, so two parts make a key only if they hold a least
number of shingles, the same for all sets of a band. A set has enough full pieces if more than half of
its largest difference (from its own size) have such a number in any two parts; then one of these has at
most one difference, and the pair shares a key whatever the other set holds. The few sets without
enough full pieces give their thin parts too, as keys of another kind, and so meet each other.

A key's nodes are not all paired with each other. In the first round each is paired only with the
key's center, that of its nodes which is in most keys; pairs are verified (Hamming bound on a sketch of
the whole set, then the sets) and links merge nodes into components. In the second round, nodes of one
key that are still in different components are compared by their sketches within the join, which gives
only pairs that the Hamming bound allows. Before that, a key with more than ``hot`` nodes left is dealt
again: its pairs must also share a key of another deal. Every pair that links shares a key, so it is in
one component after the first round or compared in the second: no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize, needed, text_or_empty
from ledgerlens.llm.components import components
from ledgerlens.llm.words import grams, mixed, spaced_hashes
from ledgerlens.sources.tables import table

SHINGLE, PERCENT = 4, 85
#: The parts of a piece that make its keys.
PARTS = ((0, 1), (0, 2), (1, 2))
#: Nodes of a key beyond which it is dealt again, and how often at most.
HOT, DEALS = 4096, 4
#: Bits of the sketches that are compared inside a join.
FOLD_BITS = 1024


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, the whole sequence is one."""
    h = spaced_hashes(text)
    if 0 < len(h) < shingle:
        return mixed(grams(h, len(h)) + np.uint64(len(h)))
    g = np.sort(grams(h, shingle))
    return g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of sets of a and b elements that link."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Bands of sizes, each 1.4 times as wide as the one before: the pieces of a band and the bands
    that a size takes part in."""

    def __init__(self, percent: int = PERCENT):
        if not 0 < percent <= 100:
            raise ValueError(f"percent is from 1 to 100, not {percent}")
        self.percent, self.lows, self.plans = percent, [1], {}

    def low(self, k: int) -> int:
        while len(self.lows) <= k:
            self.lows.append(max(self.lows[-1] + 1, -(-self.lows[-1] * 7 // 5)))
        return self.lows[k]

    def own(self, n: int) -> int:
        k = 0
        while self.low(k + 1) <= n:
            k += 1
        return k

    def worst(self, k: int) -> int:
        """The largest difference of a linking pair whose smaller set is of band k."""
        high = self.low(k + 1) - 1
        return most_different(high, high * 100 // self.percent, self.percent)

    def dealt(self, k: int) -> tuple[int, int]:
        """Pieces of a band, and the least number of shingles in two parts that make a key. Half the
        worst difference and one more would do if each piece held enough; some more make up for
        pieces that don't. Bands of small sets have no such least number."""
        if k not in self.plans:
            d, high = self.worst(k), self.low(k + 1) - 1
            enough = d // 2 + 1 if d else 0
            self.plans[k] = enough, 0
            for least in (2, 1) if d else ():
                pieces = enough
                while pieces <= enough * 1.2 + 1 and not _full(pieces, high, least) >= enough:
                    pieces += 1
                if pieces <= enough * 1.2 + 1:
                    self.plans[k] = pieces, least
                    break
        return self.plans[k]

    def of(self, n: int) -> list[int]:
        """All bands that may hold the smaller set of a linking pair with a set of n."""
        out = [self.own(n)]
        while out[0] and n * self.percent <= (self.low(out[0]) - 1) * 100:
            out.insert(0, out[0] - 1)
        return out

    def different(self, n: int, k: int) -> int:
        """The largest difference of a linking pair of band k that has a set of n."""
        return most_different(n, n * 100 // self.percent if k == self.own(n) else self.low(k + 1) - 1, self.percent)


def _full(pieces: int, n: int, least: int) -> float:
    """How many pieces of a set of n have at least ``least`` shingles in any two of their parts,
    less three standard deviations."""
    mean = n / (3 * pieces)
    none, one = math.exp(-mean), mean * math.exp(-mean)
    good = (1 - none) ** 3 + 3 * none * ((1 - none - one) ** 2 if least == 2 else (1 - none) ** 2)
    return pieces * good - 3 * math.sqrt(pieces * good * (1 - good))


def keys_of(s: np.ndarray, bands: Bands, deal: int = 0) -> np.ndarray:
    """The join keys of a set. Each deal deals its shingles to other pieces."""
    out = []
    for k in bands.of(len(s)):
        pieces, least = bands.dealt(k)
        if not pieces:
            continue
        turn = mixed(np.array([k + 1, k << 40, deal + 1], np.uint64)) | np.uint64(1)
        part = ((s * turn[0] * turn[2] >> np.uint64(32)) % np.uint64(3 * pieces)).astype(np.int64)
        sketch = np.zeros(3 * pieces, np.uint64)
        np.bitwise_xor.at(sketch, part, s)
        held = np.bincount(part, minlength=3 * pieces)
        sketch = mixed(sketch)
        place = np.arange(1, pieces + 1, dtype=np.uint64) * turn[1]
        thin = [held[x::3] + held[y::3] < least for x, y in PARTS]
        short = pieces - np.count_nonzero(thin[0] | thin[1] | thin[2]) < bands.different(len(s), k) // 2 + 1
        for omitted, (x, y) in enumerate(PARTS):
            keys = sketch[x::3] * np.uint64(0x9E3779B97F4A7C15) + sketch[y::3] + place + np.uint64(omitted)
            out.append(np.where(thin[omitted], mixed(keys), keys) if short else keys[~thin[omitted]])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch_of(s: np.ndarray) -> bytes:
    """Parity sketch of a whole set, of a power of two of bits, at least twice the set's size. A
    longer sketch folds onto a shorter one by XOR of its halves."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    flips = np.bincount(((s >> np.uint64(8)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def fold_of(s: np.ndarray) -> np.ndarray:
    """Parity sketch of FOLD_BITS bits, as 64-bit words."""
    flips = np.bincount(((s >> np.uint64(8)) % np.uint64(FOLD_BITS)).astype(np.int64), minlength=FOLD_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _node(s: np.ndarray, salt: int) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), salt) - (1 << 63)


def _sets(texts: DataFrame, salt: int, shingle: int) -> DataFrame:
    """doc_id, text_hash, n, node, node_key (128 bits, to see that no two sets share a node), sketch, fold."""
    kind = dict(texts.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, key, sketch, fold = [], [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                node.append(_node(s, salt) if len(s) else None)
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(sketch_of(s) if len(s) else None)
                fold.append(fold_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(fold, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "node", "node_key", "sketch", "fold"],
            )

    return texts.mapInArrow(read, f"doc_id {kind}, text_hash long, n long, node long, node_key binary, sketch binary, fold array<long>")


def _keys(texts: DataFrame, salt: int, shingle: int, percent: int, deal: int = 0) -> DataFrame:
    """node and its join keys, once per task at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            nodes, keys = [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), shingle)
                node = _node(s, salt) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                keys.append(keys_of(s, bands, deal).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["node", "keys"])

    return texts.select("text").mapInArrow(read, "node long, keys array<long>")


def _shared(sorted_keys: DataFrame) -> DataFrame:
    """Of rows key, node in order within partitions by key: those of keys with two nodes and more,
    each once. Holds one batch and the last key's first row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = held_node = last_node = None
        held_out = False  # whether the held key's first row is out already
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            if held_key is not None:  # go on from the row before this batch
                key, node = np.concatenate([[held_key], key]), np.concatenate([[held_node], node])
            first = np.concatenate([[True], key[1:] != key[:-1]])
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            if held_key is not None and len(key) > 1 and not first[1] and node[1] == last_node:
                new[1] = False
            run = np.cumsum(first) - 1
            least = node[np.flatnonzero(first)][run]
            other = new & ~first  # a node of a key that isn't its least
            if held_key is not None:
                other &= node != least
            several = np.bincount(run, weights=other, minlength=run[-1] + 1) > 0
            out = several[run] & (other | first)
            if held_key is not None and held_out:
                out[0] = False
            last_held_out = bool(several[-1]) or (run[-1] == 0 and held_out)
            held_key, held_node, last_node, held_out = key[-1], least[-1], node[-1], last_held_out
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], names=["key", "node"])

    return sorted_keys.mapInArrow(read, "key long, node long")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that sizes and sketches allow to link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").where((F.col("n_u") * percent <= F.col("n_v") * 100) & (F.col("n_v") * percent <= F.col("n_u") * 100))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            ok = [hamming(a, b) <= most_different(m, n, percent) for a, b, m, n in zip(cols["s_u"], cols["s_v"], cols["n_u"], cols["n_v"], strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return sized.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(near, "u long, v long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, salt: int, shingle: int, percent: int) -> DataFrame:
    """Of close pairs (u, v), a written table, those whose sets link. A node's text is found by its
    hash; a text of that hash but another set is left out when it is compared."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "text_hash"), "node")
    wanted = materialize(wanted, "join-wanted")
    chosen = materialize(texts.join(broadcast_if_small(wanted), "text_hash").select("node", "text").distinct(), "join-texts")
    both = pairs.join(chosen.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(chosen.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            ok = []
            for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                a = a.as_py()
                if a != last_text:
                    last_text, last_set = a, shingle_set(a, shingle)
                other = shingle_set(b.as_py(), shingle)
                inside = len(np.intersect1d(last_set, other, assume_unique=True))
                ok.append(100 * inside >= percent * (len(last_set) + len(other) - inside) and _node(last_set, salt) == u and _node(other, salt) == v)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return materialize(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "join-links")


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """A text of each node's hash; where several texts have that hash, all of them."""
    return texts.join(broadcast_if_small(materialize(nodes.select("text_hash").distinct(), "join-hashes")), "text_hash", "left_semi").distinct()


def _redealt(rows: DataFrame, nodes: DataFrame, texts: DataFrame, salt: int, shingle: int, percent: int, hot: int, deal: int) -> DataFrame | None:
    """Rows key, node, component with the keys of more than hot nodes dealt again: a pair of such a
    key that links shares one of another deal's keys too, so (key, other key) takes the key's place
    wherever that leaves fewer pairs. None where no key is hot."""
    crowded = materialize(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot), "join-crowded")
    if crowded.isEmpty():
        return None
    crowd = rows.join(broadcast_if_small(crowded), "key")
    members = nodes.join(broadcast_if_small(materialize(crowd.select("node").distinct(), "join-crowd")), "node", "left_semi").select("node", "text_hash")
    again = _keys(_texts_of(members, texts), salt, shingle, percent, deal).select("node", F.explode(F.array_distinct("keys")).alias("other")).distinct()
    finer = materialize(crowd.join(again, "node").select("key", "m", F.xxhash64("key", "other", F.lit(deal)).alias("finer"), "node", "component"), "join-finer")
    sizes = finer.groupBy("key", "m", "finer").agg(F.count("*").alias("k"), F.min("component").alias("a"), F.max("component").alias("b"))
    better = materialize(sizes.groupBy("key", "m").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("pairs")).where("pairs < double(m) * m").select("key"), "join-better")
    kept = rows.join(better, "key", "left_anti")
    open_finer = sizes.where("a <> b").select("finer")
    return materialize(kept.unionByName(finer.join(better, "key", "left_semi").join(open_finer, "finer", "left_semi").select(F.col("finer").alias("key"), "node", "component")), "join-redealt")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are linked with nothing: their component_id is their
    own doc_id. A null doc_id is never the smallest unless all of its component are null, and then
    component_id is null. Repeated rows are documents like others, and share a component. An empty
    table gives no rows; further columns are ignored. Sets hold 64-bit hashes of shingles."""
    texts = needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    for salt in range(9):
        rows = materialize(_sets(texts, salt, shingle), "join-sets")
        nodes = rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("fold").alias("fold"), F.min("text_hash").alias("text_hash"), F.min("node_key").alias("least"), F.max("node_key").alias("greatest"))
        nodes = materialize(nodes, "join-nodes")
        if nodes.where("least <> greatest").isEmpty():
            break  # no two sets share a node

    keys = _keys(texts, salt, shingle, percent).select("node", F.explode("keys").alias("key"))
    buckets = materialize(_shared(keys.repartition("key").sortWithinPartitions("key", "node").select("key", "node")), "join-buckets")

    # First round: each node of a key with the key's center, the node that is in most keys.
    keyed = materialize(buckets.join(buckets.groupBy("node").agg(F.count("*").alias("keys")), "node"), "join-keyed")
    centers = keyed.groupBy("key").agg(F.max(F.struct("keys", "node")).alias("most")).select("key", F.col("most.node").alias("center"))
    buckets = materialize(keyed.join(centers, "key").select("key", "center", "node"), "join-starred")
    stars = buckets.where("center <> node").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    links = _verified(materialize(_close(stars, nodes, percent), "join-close"), nodes, texts, salt, shingle, percent)
    merged = materialize(components(links), "join-components")

    # Second round: nodes of a key in different components.
    placed = buckets.where("center <> node").join(merged, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    left = materialize(placed.join(open_keys, "key", "left_semi"), "join-open")
    for deal in range(1, DEALS):
        redealt = _redealt(left, nodes, texts, salt, shingle, percent, hot, deal)
        if redealt is None:
            break
        left = redealt
    left = materialize(left.join(nodes.select("node", "n", "fold"), "node"), "join-folded")
    x = left.select("key", F.col("node").alias("u"), F.col("component").alias("c"), F.col("n").alias("n_u"), F.col("fold").alias("f_u"))
    y = left.select("key", F.col("node").alias("v"), F.col("component").alias("e"), F.col("n").alias("n_v"), F.col("fold").alias("f_v"))
    apart = F.aggregate(F.zip_with("f_u", "f_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, d: t + d)
    close = (
        (x["key"] == y["key"])
        & (F.col("c") < F.col("e"))
        & (F.col("n_u") * percent <= F.col("n_v") * 100)
        & (F.col("n_v") * percent <= F.col("n_u") * 100)
        & (apart * (100 + percent) <= (F.col("n_u") + F.col("n_v")) * (100 - percent))
    )
    across = x.join(y, close).select("u", "v").distinct()
    more = _verified(materialize(_close(across, nodes, percent), "join-close"), nodes, texts, salt, shingle, percent)
    if not more.isEmpty():
        label = lambda x: merged.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        lifted = more.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
        joined = materialize(components(lifted), "join-components")
        again = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
        known = merged.join(again, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        merged = materialize(known.unionByName(joined.join(merged, "node", "left_anti")), "join-components")

    member = materialize(rows.join(merged, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component")), "join-members")
    least = materialize(member.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "join-least")
    return member.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {SHINGLE - 1}), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * i >= {PERCENT} * (nx.c + ny.c - i)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS top FROM documents UNION SELECT e.y, r.top FROM r JOIN e ON r.doc_id = e.x
), m AS (
  SELECT doc_id, min(top) AS component_id FROM r GROUP BY 1
)
SELECT w.doc_id, coalesce(c, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
