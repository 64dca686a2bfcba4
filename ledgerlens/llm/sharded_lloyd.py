"""Lloyd's clustering with the dimensions dealt out: exact, over integers.

Vectors are cut into tiles: up to ``TILE_ROWS`` vectors by ``block`` components, each one row of a table
that is written once, in the order of blocks, so that a task has tiles of one block or of neighbouring
ones. A round has two steps.

* Assign. A task takes tiles and the slice of the centroids that has the same components, and makes
  exact partial squared distances. Partials of a group of vectors are added over its tiles and the
  nearest centroid is taken; of equally near ones, that with the smaller number.
* Update. Tiles meet the assignments of their vectors, sum their own components by centroid, and those
  sums are added over all tiles of a block; so each block gets its new slice of the centroids without
  any other block's components.

No task holds more than some tiles, one group's partials and slices of the centroids. Distances and
sums are integers, so order of addition never shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed
from ledgerlens.sources.tables import table

TILE_ROWS = 1024
BLOCK_DIMS = 16
#: Bytes of all partial distances of one group of vectors; many components or centroids make groups smaller.
GROUP_BYTES = 64 << 20
#: Centroids times components of one slice that a task holds; above it slices are joined without broadcast.
BROADCAST_NUMBERS = 1 << 22

_TILES = "tile long, block int, rows int, data binary"


def whole_components(vectors: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id and components floor(scale * x) of the vectors that have exactly dims components, none of
    them null or not finite."""
    v = needed(vectors, id_column, vector).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where((F.size("v") == dims) & ~odd).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> DataFrame:
    """cluster and components of the k vectors with the smallest SHA-256 of ``seed:id``, of equal ids
    the smaller components first. Vectors without an id are none of them."""
    first = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    rows = first.collect()  # k vectors
    return kept.sparkSession.createDataFrame([(i, r["v"]) for i, r in enumerate(rows)], "cluster int, v array<long>")


def _tiles(kept: DataFrame, dims: int, block: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """The written tiles, and the ids of each group of vectors (tile, place, id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tile = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), tile_rows):
                part = batch.slice(at, tile_rows)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                blocks = range(0, dims, block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tile] * len(blocks), pa.int64()),
                        pa.array(range(len(blocks)), pa.int32()),
                        pa.array([len(part)] * len(blocks), pa.int32()),
                        pa.array([np.ascontiguousarray(x[:, a : a + block], "<i8").tobytes() for a in blocks], pa.binary()),
                        pa.array([part.column("id").to_pylist()] + [None] * (len(blocks) - 1), pa.list_(pa.string())),
                    ],
                    names=["tile", "block", "rows", "data", "ids"],
                )
                tile += 1

    cut_up = kept.select(F.col("id").cast("string").alias("id"), "v").mapInArrow(cut, f"{_TILES}, ids array<string>")
    written = materialize(cut_up.repartitionByRange("block", "tile"), "lloyd-tiles")
    return written.select("tile", "block", "rows", "data"), written.where("block = 0").select("tile", F.posexplode("ids").alias("place", "id"))


def _slices(centroids: DataFrame, block: int) -> DataFrame:
    """Centroids as one row per block: its slice of every centroid, by number."""
    at = centroids.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy(F.floor(F.col("dim") / block).cast("int").alias("block"))
    numbers = F.transform(F.sort_array(F.collect_list(F.struct("cluster", "dim", "x"))), lambda s: s["x"])
    return at.agg(numbers.alias("slice"))


def _small(slices: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(slices) if numbers <= BROADCAST_NUMBERS else slices


def _assigned(tiles: DataFrame, slices: DataFrame, numbers: int, k: int) -> DataFrame:
    """tile, clusters and distances (binary, one 64-bit integer a vector)."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, rows, data, own in zip(*(batch.column(c) for c in ("tile", "rows", "data", "slice")), strict=True):
                x = np.frombuffer(data.as_py(), "<i8").reshape(rows.as_py(), -1)
                c = own.values.to_numpy().reshape(k, -1)
                part = np.empty((len(x), k), "<i8")
                for i in range(k):
                    d = x - c[i]
                    np.einsum("ij,ij->i", d, d, out=part[:, i])
                yield pa.RecordBatch.from_arrays([pa.array([tile.as_py()], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["tile", "part"])

    def nearest(group: pa.Table) -> pa.Table:
        total = 0
        for part in group.column("part"):
            total = total + np.frombuffer(part.as_py(), "<i8").reshape(-1, k)
        best = total.argmin(axis=1)  # the first of equally near ones
        out = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (best, total[np.arange(len(total)), best])]
        return pa.Table.from_arrays([group.column("tile").slice(0, 1), *out], names=["tile", "clusters", "distances"])

    parts = tiles.join(_small(slices, numbers), "block").select("tile", "rows", "data", "slice").mapInArrow(partials, "tile long, part binary")
    return parts.groupBy("tile").applyInArrow(nearest, "tile long, clusters binary, distances binary")


def _updated(tiles: DataFrame, assigned: DataFrame, centroids: DataFrame, block: int, k: int) -> DataFrame:
    """New centroids: floored means by component; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, data, clusters in zip(*(batch.column(c) for c in ("block", "data", "clusters")), strict=True):
                which = np.frombuffer(clusters.as_py(), "<i8")
                x = np.frombuffer(data.as_py(), "<i8").reshape(len(which), -1)
                total, n = held.setdefault(number.as_py(), (np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)))
                order = np.argsort(which, kind="stable")
                first = np.searchsorted(which[order], np.arange(k))
                count = np.bincount(which, minlength=k)
                some = np.flatnonzero(count)
                total[some] += np.add.reduceat(x[order], first[some], axis=0)
                n += count
        for number, (total, n) in held.items():
            some = np.flatnonzero(n)
            width = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(some, width), pa.int32()),
                    pa.array(np.tile(np.arange(width) + number * block, len(some)), pa.int32()),
                    pa.array(total[some].ravel(), pa.int64()),
                    pa.array(np.repeat(n[some], width), pa.int64()),
                ],
                names=["cluster", "dim", "total", "n"],
            )

    own = tiles.select("tile", "block", "data").join(assigned.select("tile", "clusters"), "tile").select("block", "data", "clusters").mapInArrow(sums, "cluster int, dim int, total long, n long")
    added = own.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.expr("(total - pmod(total, n)) div n").alias("x")
    new = added.select("cluster", "dim", mean).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("new"))
    return centroids.join(new, "cluster", "left").select("cluster", F.coalesce("new", "v").alias("v"))


def sharded_lloyd(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1", block: int = BLOCK_DIMS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per kept vector: its id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256.

    Vectors of another length, null vectors and those with a null, infinite or undefined component are
    left out. Null and repeated ids come back as they are, one row for each kept vector; a vector without
    an id is no first centroid. Fewer vectors with ids than k make fewer centroids; without any centroid
    (an empty table) there are no rows. Further columns are ignored. |scale * x| up to about 2**27
    keeps distances within 64 bits. Written tables: the tiles once, and each round's assignments and
    centroids, from which a lost executor's work is done again."""
    kept = whole_components(vectors, id_column, vector, dims, scale)
    kind = needed(vectors, id_column).schema[id_column].dataType
    centroids = materialize(first_centroids(kept, k, seed), "lloyd-centroids")
    k = centroids.count()
    tile_rows = max(1, min(tile_rows, GROUP_BYTES // (8 * max(k, 1) * -(-dims // block))))
    tiles, ids = _tiles(kept if k else kept.limit(0), dims, block, tile_rows)
    for _ in range(rounds if k else 0):
        assigned = materialize(_assigned(tiles, _slices(centroids, block), k * dims, k), "lloyd-assigned")
        centroids = materialize(_updated(tiles, assigned, centroids, block, k), "lloyd-centroids")
    assigned = materialize(_assigned(tiles, _slices(centroids, block), k * dims, k), "lloyd-assigned")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, clusters, distances in zip(*batch.columns, strict=True):
                which, far = (np.frombuffer(b.as_py(), "<i8") for b in (clusters, distances))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), tile.as_py()), pa.int64()), pa.array(np.arange(len(which)), pa.int32()), pa.array(which, pa.int32()), pa.array(far, pa.int64())], names=["tile", "place", "cluster", "distance"])

    found = assigned.select("tile", "clusters", "distances").mapInArrow(spread, "tile long, place int, cluster int, distance long")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    shown = centroids.select("cluster", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    notes = materialize(by_cluster.join(whole).join(shown, "cluster"), "lloyd-notes")
    out = found.join(ids, ["tile", "place"]).join(F.broadcast(notes), "cluster")  # k rows
    return out.select(F.col("id").cast(kind).alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd(table(spark, sf_dir, "embeddings"))


_NEAREST = """d{r} AS (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS far FROM v JOIN c{r} USING (dim) GROUP BY 1, 2),
a{r} AS (SELECT vec_id, CAST(arg_min(cluster, far * 16 + cluster) AS INTEGER) AS cluster, min(far) AS distance FROM d{r} GROUP BY 1)"""
_NEW = """c{n} AS (SELECT cluster, dim, CAST(coalesce(m, c) AS BIGINT) AS c FROM c{r} LEFT JOIN (SELECT cluster, dim, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY 1, 2)) USING (cluster, dim))"""
ORACLE_SQL = (
    """WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS dim, unnest(e) AS x FROM kept),
h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS cluster FROM kept QUALIFY cluster < 16),
c0 AS MATERIALIZED (SELECT cluster, dim, x AS c FROM v JOIN h USING (vec_id)),
"""
    + ",\n".join(f"{_NEAREST.format(r=r)},\n{_NEW.format(r=r, n=r + 1)}" for r in range(3))
    + ",\n"
    + _NEAREST.format(r=3)
    + """
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY 1) USING (cluster)"""
)
