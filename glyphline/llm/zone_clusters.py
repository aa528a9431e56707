"""Centroid clustering over zone maps: vectors in the order of a space-filling curve, blocks with boxes, exact distances.

Neighbours on a Hilbert curve lie close together, so a block of consecutive vectors has a small box. The distance
between a box and a centroid bounds the distance of every vector of the block from both sides; a centroid whose lower
bound exceeds another's upper bound cannot win in that block. What is left is compared exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint, ship_package

SCALE = 64
BLOCK = 512
CURVE_DIMS, CURVE_BITS = 8, 8
# distances stay within 64 bits below this magnitude of a component, for up to 64 components
LARGEST = 1 << 27
# the centroids travel with every task
MAX_CENTROID_CELLS = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points on the Hilbert curve of their dimensions; ``cells`` holds whole numbers under ``2 ** bits``.

    Skilling's published transform, from coordinates to the transposed index, on all points at once. The index must
    fit into 64 bits. Ordered as unsigned numbers.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(dims):
            up = (x[i] & q).astype(bool)
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip ^= np.where(x[-1] & q != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return key


def box_bounds(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) squared distance that a point of the box can have to each centroid."""
    under, over = low - centroids, centroids - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def candidates(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the block, ascending."""
    least, greatest = box_bounds(block.min(axis=0), block.max(axis=0), centroids)
    return np.flatnonzero(least <= greatest.min())


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, exactly; of equally near ones the smaller number."""
    some = candidates(block, centroids)
    c = centroids[some]
    reach = max(int(np.abs(block).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * reach * reach * block.shape[1] < 1 << 52:  # whole numbers that doubles hold exactly
        b, d = block.astype(np.float64), c.astype(np.float64)
        dist = ((b * b).sum(axis=1)[:, None] + (d * d).sum(axis=1)[None, :] - 2 * (b @ d.T)).astype(np.int64)
    else:
        dist = np.empty((len(block), len(c)), np.int64)
        for k in range(len(c)):
            gap = block - c[k]
            dist[:, k] = (gap * gap).sum(axis=1)
    best = dist.argmin(axis=1)
    return some[best], dist[np.arange(len(block)), best]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _on_curve(dims: int, axes: list[int], low: np.ndarray, high: np.ndarray):
    """Adds the curve place of each vector, from the cells of its ``axes`` between ``low`` and ``high``."""

    def run(batches):
        span = np.maximum(high - low, 1).astype(np.float64)
        for b in batches:
            q = _matrix(b.column(1), dims)[:, axes]
            cell = np.clip((q - low) / span * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.uint64)
            key = hilbert_keys(cell, CURVE_BITS) ^ np.uint64(1 << 63)  # signed numbers in the order of unsigned ones
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key.view(np.int64))], ["id", "q", "place"])

    return run


def _blocks(batches, dims: int):
    for b in batches:
        q = _matrix(b.column(-1), dims)
        for a in range(0, len(q), BLOCK):
            yield b, a, q[a : a + BLOCK]


def _summed(dims: int, centroids: np.ndarray):
    """(cluster, n, s): members and componentwise sums of a task's vectors, a row a cluster."""

    def run(batches):
        n = np.zeros(len(centroids), np.int64)
        s = np.zeros((len(centroids), dims), object)
        for _, _, block in _blocks(batches, dims):
            who, _ = nearest(block, centroids)
            for k in np.unique(who):
                own = block[who == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0).astype(object)
        some = np.flatnonzero(n)
        if len(some):
            text = pa.array([[str(v) for v in s[k]] for k in some], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), text], ["cluster", "n", "s"])

    return run


def _assigned(dims: int, centroids: np.ndarray):
    def run(batches):
        for b, a, block in _blocks(batches, dims):
            who, dist = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(block)), pa.array(who.astype(np.int32)), pa.array(dist)], ["id", "cluster", "distance"])

    return run


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = SCALE) -> DataFrame:
    """(id, q): vectors of exactly ``dims`` components, none null or non-finite, each component as ``floor(scale * x)``.

    Others are left out. A component of ``LARGEST`` or more in magnitude is an error: distances would leave 64 bits.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id).alias("id"), v.alias("v")).filter((F.size("v") == dims) & F.forall("v", finite))
    fits = F.forall("v", lambda x: F.abs(F.lit(float(scale)) * x) < LARGEST)
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("int"))
    return rows.select("id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a vector component times {scale} is not under {LARGEST}"))).alias("q"))


def in_curve_order(rows: DataFrame, dims: int) -> DataFrame:
    """(place, q, id) written in the order of the curve over the components of largest variance, range-partitioned.

    Ties of a place are dealt by a row number of the written table, so very many equal vectors spread.
    """
    stats = rows.agg(*[f(F.col("q")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max), ("c", F.stddev_pop))]).first()
    axes = sorted(sorted(range(dims), key=lambda i: (-(stats[f"c{i}"] or 0.0), i))[:CURVE_DIMS])
    low, high = (np.array([stats[f"{n}{i}"] or 0 for i in axes], np.int64) for n in "ab")
    kind = rows.schema["id"].dataType.simpleString()
    placed = checkpoint(rows.mapInArrow(_on_curve(dims, axes, low, high), f"id {kind}, q array<int>, place bigint"))
    # a file is read alike at every attempt, so the numbers are too
    dealt = placed.withColumn("nth", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange("place", F.xxhash64("nth"), "nth").sortWithinPartitions("place")
    return checkpoint(ordered.select("place", "id", "q"))


def first_centroids(rows: DataFrame, k: int, seed: Callable[[Column], Column]) -> np.ndarray:
    """The ``k`` vectors whose ``seed(id)`` is smallest, in that order; null ids last, ties by vector."""
    found = rows.select(seed(F.col("id")).alias("s"), "q").orderBy(F.col("s").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r.q for r in found], np.int64)


def by_id_hash(id: Column) -> Column:
    """The hash that orders seeds: SHA-256 of ``1:<id>``."""
    return F.sha2(F.concat(F.lit("1:"), id.cast("string")).cast("binary"), 256)


def cluster_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = SCALE,
    seed: Callable[[Column], Column] = by_id_hash,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that ``quantised`` keeps.

    Method: seeds by the smallest hashes, then ``rounds`` of assigning all vectors and replacing every centroid that has
    some by the floor of their mean, in whole numbers; then one last assignment. Vectors are written once in the order
    of a Hilbert curve; each block of them is compared with the centroids its box does not rule out. A round brings back
    ``k`` rows of sums. Equally near centroids: the smaller number. An empty cluster keeps its centroid.

    Fewer vectors than ``k``: as many clusters. Null ids: rows of their own that seed last. Repeated rows: each counts
    and gets its row. An empty table gives an empty result. Further columns are ignored.
    """
    spark = vectors.sparkSession
    if k * dims > MAX_CENTROID_CELLS:
        raise ValueError(f"{k} centroids of {dims} components are more than the tasks are given ({MAX_CENTROID_CELLS} numbers)")
    ship_package(spark)
    rows = quantised(vectors, id, vector, dims, scale)
    kind = rows.schema["id"].dataType
    named = f"{kind.simpleString()}, cluster int, distance bigint"
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.selectExpr(f"id AS `{id}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "q AS centroid").limit(0)
    ordered = in_curve_order(rows, dims).select("id", "q")
    for _ in range(rounds):
        part = ordered.select("q").mapInArrow(_summed(dims, centroids), "cluster int, n bigint, s array<string>")
        sums = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
        centroids = centroids.copy()
        for r in sums.collect():  # k rows at most
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    found = checkpoint(ordered.mapInArrow(_assigned(dims, centroids), "id " + named))
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = [(c, d, sum(inertia.values()), [int(v) for v in centroids[c]]) for c, d in inertia.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    # as many rows as centroids
    out = found.join(F.broadcast(told), "cluster")
    return out.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: str = "centroid") -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda v: v.cast("string")), ",").cast("binary"), 256)


def _sql(k: int, rounds: int, dims: int, scale: int) -> str:
    """The plain loop: every vector against every centroid."""
    parts = [f"""q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
 FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
 f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM q QUALIFY c < {k})""",
 "x AS MATERIALIZED (SELECT r, i, q[i] AS v FROM (SELECT r, q, unnest(range(1, len(q) + 1)) AS i FROM q))"]
    for n in range(rounds + 1):
        parts.append(f"""k{n} AS (SELECT c, i, q[i] AS v FROM (SELECT c, q, unnest(range(1, len(q) + 1)) AS i FROM c{n})),
d{n} AS (SELECT r, c, sum((x.v - k.v) * (x.v - k.v)) AS d FROM x JOIN k{n} AS k USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT c, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} JOIN x USING (r) GROUP BY c, i),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{n} AS o LEFT JOIN m{n} AS m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
 sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN q USING (r) JOIN c{rounds} USING (c)"""


SQL = _sql(16, 3, 64, SCALE)
