"""Near-duplicates by SimHash fingerprints: pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import checkpoint, ship_package
from .common import free_name, text_of

# 64 bits in seven blocks; two fingerprints at four or fewer differing bits agree in three
# blocks at least. A choice of three blocks (27 or 28 bits) is one table.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)
MATCH = 3
SEED = 42
# a bucket with more fingerprints is compared in tiles of this many by this many
TILE = 8192
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_SLICE = 1 << 17


def fingerprint_of(text: str, width: int = 4) -> int:
    """SimHash of one text: a bit is set if it is set in over half of the shingles' hashes."""
    tokens = text.encode("utf-8").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_digest
    if len(tokens) <= width:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(ends), _SLICE):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _SLICE], ends[at : at + _SLICE])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a signed long. No shuffle."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint_of(t.as_py(), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [id, "fp"])

    schema = T.StructType([docs.schema[id], T.StructField("fp", T.LongType())])
    return docs.select(id, text_of(text).alias("text")).mapInArrow(run, schema)


def _bucket_keys(fp: Column) -> Column:
    """One key per choice of blocks: the number of the choice over the chosen blocks' bits."""
    places, at = [], 0
    for width in BLOCKS:
        places.append((at, width))
        at += width
    keys = []
    for n, chosen in enumerate(combinations(places, MATCH)):
        key = F.lit(n).cast("long")
        for start, width in chosen:
            block = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(block)
        keys.append(key)
    return F.array(*keys)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Mask of the pairs (a, b) that join two parts not joined by the pairs before: at most n - 1."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep[i] = True
    return keep


def _links(left: np.ndarray, right: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at ``most`` or fewer differing bits that span what all such pairs connect.

    Within ``left``, or between ``left`` and ``right``. Compared in strips, so memory stays
    in proportion to the inputs and not to the pairs.
    """
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    n = len(left) + (0 if right is None else len(right))
    strip = max(1, (1 << 22) // max(1, len(other)))
    ga, gb = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(left), strip):
        near = np.bitwise_count(left[at : at + strip, None] ^ other[None, :]) <= most
        i, j = np.nonzero(near)
        i += at
        if right is None:
            i, j = i[i < j], j[i < j]
        ga, gb = np.concatenate([ga, i]), np.concatenate([gb, j + shift])
        if len(ga) > 4 * n + 1000:
            keep = _forest(ga, gb, n)
            ga, gb = ga[keep], gb[keep]
    keep = _forest(ga, gb, n)
    return ga[keep], gb[keep]


def _groups(batches):
    """Arrays of consecutive rows of one first column, from batches sorted by it: (key, [columns])."""
    rest = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        if len(cut) and len(cols[0]):
            yield [c[: cut[-1]] for c in cols], np.concatenate(([0], cut))
            rest = [c[cut[-1] :] for c in cols]
        else:
            rest = cols
    if rest is not None and len(rest[0]):
        yield rest, np.array([0, len(rest[0])])


def _solve_buckets(most: int):
    """Links within buckets, from rows (key, fp) sorted by key."""

    def run(batches):
        for (_, fp), edges in _groups(batches):
            bits = fp.view(np.uint64)
            size = np.diff(edges)
            out_a, out_b = [], []
            for step in range(1, 8):  # small buckets: row i against row i + step, all buckets at once
                many = (size > step) & (size <= 8)
                if not many.any():
                    break
                n = size[many] - step
                i = np.repeat(edges[:-1][many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= most]
                out_a.append(fp[near])
                out_b.append(fp[near + step])
            for g in np.flatnonzero(size > 8):
                part = slice(edges[g], edges[g + 1])
                i, j = _links(bits[part], None, most)
                out_a.append(fp[part][i])
                out_b.append(fp[part][j])
            a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return run


def _solve_tiles(most: int):
    """Links within one tile, from rows (tile, side, fp) sorted by tile. ``side`` 2: a tile of one part with itself."""

    def run(batches):
        for (_, side, fp), edges in _groups(batches):
            for x, y in zip(edges[:-1], edges[1:]):
                bits, s = fp[x:y].view(np.uint64), side[x:y]
                if (s == 2).all():
                    i, j = _links(bits, None, most)
                    a, b = bits[i], bits[j]
                else:
                    both = np.concatenate([bits[s == 0], bits[s == 1]])
                    i, j = _links(bits[s == 0], bits[s == 1], most)
                    a, b = both[i], both[j]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _spread(keys: DataFrame, solve, schema: str) -> DataFrame:
    """Bring the rows of each first column together, sorted, and run ``solve`` over them."""
    first = keys.columns[0]
    return keys.repartition(F.col(first)).sortWithinPartitions(first).mapInArrow(solve, schema)


def links(fps: DataFrame, most: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect whatever pairs at ``most`` bits connect.

    Every such pair meets in a bucket. A bucket's pairs are compared inside the task but only a spanning
    set leaves it, so rows stay in proportion to the fingerprints. Buckets are counted first; those over ``tile``
    never meet whole: they are cut into parts and every pair of parts is a task of its own.
    """
    if len(BLOCKS) - MATCH < most:
        raise ValueError(f"{len(BLOCKS)} blocks, {MATCH} of them equal, find at most {len(BLOCKS) - MATCH} differing bits")
    keyed = fps.select(F.explode(_bucket_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > tile)
    large = checkpoint(sizes.select("key", F.ceil(F.col("size") / tile).alias("parts")))
    if large.isEmpty():
        return _spread(keyed, _solve_buckets(most), "a bigint, b bigint")
    pairs = _spread(keyed.join(large, "key", "left_anti"), _solve_buckets(most), "a bigint, b bigint")
    hot = keyed.join(large, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    tiles = hot.select("key", "fp", "part", other).select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).cast("long").alias("side"),
        "fp",
    )
    return pairs.union(_spread(tiles, _solve_tiles(most), "a bigint, b bigint"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b): root is the smallest node it is connected with.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to the smallest node near it. Each step is one aggregation and one join,
    and the number of rounds grows with the logarithm of the longest path.
    """
    edges = checkpoint(pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        # larger neighbours go to the smallest neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        wide = both.join(near, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        wide = checkpoint(wide.filter(F.col("a") != F.col("b")).distinct())
        # smaller neighbours and the node itself go to the smallest one
        low = checkpoint(wide.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")))
        narrow = wide.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("x"), F.col("a").alias("y"))
        narrow = narrow.union(low.select(F.col("m").alias("x"), F.col("u").alias("y"))).filter(F.col("x") != F.col("y"))
        edges = checkpoint(narrow.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a")).distinct())


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case; shingles are ``width`` words,
    repeats included. Equal fingerprints are one node; nodes at ``most`` or fewer differing
    bits are linked through pigeonhole blocks and checked. ``component_id`` is the smallest id
    reachable over links.

    Null and empty texts have fingerprint zero, linked like any other. A short text is one
    shingle; one of any length is read whole, a slice of its shingles at a time. Rows of one id with several texts and
    repeated rows are rows of their own. Null ids are reported
    but name no component unless it has no other id. An empty table gives an empty result. Further columns are ignored.
    """
    rows = checkpoint(fingerprints(docs.select(id, text), id, text, width).withColumnRenamed(id, "id"))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("low")))
    tree = checkpoint(components(links(nodes.select("fp"), most)))
    named = tree.join(nodes, tree["node"] == nodes["fp"])
    low = checkpoint(named.groupBy("root").agg(F.min("low").alias("least")))
    linked = tree.join(low, "root").select(F.col("node").alias("fp"), "least")
    known = checkpoint(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")))
    return rows.join(known, "fp").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest id, then text hash. Columns stay as they are.

    Rows count as different if id or text differ, also where the id is null; of repeated rows one stays.
    """
    key, kept, turn = free_name(docs, "key"), free_name(docs, "kept_key"), free_name(docs, "turn")
    rows = docs.withColumn(key, F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.xxhash64(text).alias("hash")))
    found = near_duplicates(rows, key, text, **how)
    keep = checkpoint(found.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias(kept)).distinct())
    stay = rows.join(keep, F.col(key) == F.col(kept), "left_semi")
    once = W.partitionBy(key).orderBy(F.lit(0))
    return stay.withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1).drop(key, turn)
