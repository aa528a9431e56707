"""Splitting of oversized groups into ordered segments.

Most groups (a staff, a page, a user) are small, and a window partitioned by the group
is the plan to have. One group may however hold a large share of all rows. For those
groups only, rows are cut into contiguous segments of the group's order so that no task
gets more than about one fair share of the table.

Segments come from data, not from physical partitions: a row is a sample when the hash
of its key and order columns says so, and split points are every n-th sample. The split
points are a literal table in the plan, so a recomputed task always gives the same answer.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, functions as F

SEG = "__seg"
SAMPLES_PER_SEGMENT = 16


@dataclass(frozen=True)
class Limits:
    """When a group counts as oversized.

    A group is split when it holds more than ``min_rows`` rows and more than one
    ``shares``-th of the table, so at most ``shares`` groups are split and the split
    table has at most about ``2 * shares`` rows whatever the size of the data. Tables whose
    scanned size is under ``probe_bytes`` cannot hold such a group and are not probed.
    """

    min_rows: int = 1_000_000
    shares: int = 1000
    probe_bytes: int = 128 * 1024 * 1024
    component_rows: int = 20_000


_limits = Limits()


def limits() -> Limits:
    return _limits


@contextmanager
def use_limits(**changes):
    """Temporarily change the limits (tests force the split path this way)."""
    global _limits
    saved = _limits
    _limits = replace(saved, **changes)
    try:
        yield _limits
    finally:
        _limits = saved


def too_small_to_probe(df: DataFrame) -> bool:
    """True when the optimizer's size estimate of the plan is under ``probe_bytes``."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:
        # estimates multiply over joins and can pass what Python reads as a number
        return False
    return size < _limits.probe_bytes


def _parts(df: DataFrame, part_bytes: int) -> int:
    """How many parts of ``part_bytes`` the optimizer's estimate of ``df`` makes; 1 where it knows no size.

    Estimates multiply over joins, so that what the plan reads, four times over, bounds them.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if read >= 1 << 62:  # rows that are not read from a table
        return 1
    try:
        size = min(int(str(plan.stats().sizeInBytes())), 4 * read)
    except ValueError:
        size = 4 * read
    return max(1, min(-(-size // part_bytes), 1 << 16))


PART_ROWS = 1 << 18


def spread(df: DataFrame, keys: list[str], part_bytes: int = 2 << 20, part_rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to as many partitions as its size asks for, ``part_bytes`` of the optimizer's estimate each.

    A chain of scans on the same keys sorts what one exchange dealt a task, once for every order, and columns are added
    on the way; the session's number of partitions knows neither. A table of one such part is left as it is. The estimate
    comes from sizes of files, which say little of rows that compress well: with ``part_rows`` the rows are counted and a
    part holds no more of them on average. That is for columns of a written table, whose footers know the count.
    """
    parts = _parts(df, part_bytes)
    if part_rows is not None:
        parts = max(parts, -(-df.count() // part_rows))
    return df if parts <= 1 else df.repartition(parts, *keys)


def deal(df: DataFrame, keys: list[str], part_bytes: int = 2 << 20, needed: bool = True) -> DataFrame:
    """As ``spread``, but a table too small to give every core a part is dealt as the session says, or left as it is
    unless an exchange is ``needed``."""
    parts = _parts(df, part_bytes)
    if parts > df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(parts, *keys)
    return df.repartition(*keys) if needed else df


def same_keys(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) for l, r in zip(left, right)], F.lit(True))


@dataclass
class Split:
    """The literal table of segments of the oversized groups."""

    keys: list[str]
    order: list[str]
    ranges: DataFrame
    last: dict

    def tag(self, df: DataFrame) -> DataFrame:
        """Add ``__seg``: the segment number in oversized groups, null elsewhere."""
        here = F.struct(*[F.col(c) for c in self.order])
        r = self.ranges
        cond = (
            same_keys([F.col(k) for k in self.keys], [F.col(f"__r_{k}") for k in self.keys])
            & (F.col("__lo").isNull() | (here >= F.col("__lo")))
            & (F.col("__hi").isNull() | (here < F.col("__hi")))
        )
        drop = [f"__r_{k}" for k in self.keys] + ["__lo", "__hi"]
        # the ranges table has at most about 2 * shares rows by construction
        return df.join(F.broadcast(r), cond, "left").drop(*drop)


@dataclass
class Probe:
    """Which groups of ``keys`` are oversized; ``hot`` is empty when none is."""

    keys: list[str]
    hot: list
    cut: int


_probes: list[Probe] = []


def _known(keys: list[str]) -> Probe | None:
    for p in reversed(_probes):
        # groups by more columns are parts of groups by fewer
        if p.keys == keys or (not p.hot and set(p.keys) <= set(keys)):
            return p
    return None


def probe(df: DataFrame, keys: list[str]) -> Probe:
    """Count rows per group, unless the table is too small to hold an oversized one.

    Only the key columns are read, and counts combine before the shuffle.
    """
    lim = _limits
    if too_small_to_probe(df):
        return Probe(keys, [], 0)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, biggest = counts.agg(F.sum("__n"), F.max("__n")).first()
    cut = max(lim.min_rows, (total or 0) // lim.shares)
    if not total or biggest <= cut:
        return Probe(keys, [], cut)
    # at most `shares` rows: every one holds more than total / shares rows
    return Probe(keys, counts.filter(F.col("__n") > cut).drop("__n").collect(), cut)


@contextmanager
def probed(df: DataFrame, keys: list[str]):
    """Probe once; scans and folds on these groups inside the block do not probe again."""
    if _known(keys) is not None:
        yield
        return
    _probes.append(probe(df, keys))
    try:
        yield
    finally:
        _probes.pop()


def inside_operator() -> bool:
    """True inside an operator made of several scans."""
    return bool(_probes)


def probe_once(fn):
    """Decorator of operators ``fn(df, keys, ...)`` made of several scans."""

    @wraps(fn)
    def run(df, keys, *args, **kwargs):
        with probed(df, keys):
            return fn(df, keys, *args, **kwargs)

    return run


def find_split(df: DataFrame, keys: list[str], order: list[str]) -> Split | None:
    """Segments for the oversized groups of ``df``; None when there are none."""
    found = _known(keys) or probe(df, keys)
    hot_rows, cut = found.hot, found.cut
    if not hot_rows:
        return None
    spark = df.sparkSession
    key_schema = df.select(*keys).schema
    hot = spark.createDataFrame([tuple(r) for r in hot_rows], key_schema) if keys else None
    every = max(1, cut // SAMPLES_PER_SEGMENT)
    rows = df.select(*keys, F.struct(*order).alias("__o"))
    picked = rows.filter(F.pmod(F.xxhash64(*keys, "__o"), F.lit(every)) == 0)
    if keys:
        h = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys])
        picked = picked.join(
            F.broadcast(h),
            same_keys([F.col(k) for k in keys], [F.col(f"__h_{k}") for k in keys]),
            "left_semi",
        )
    # about SAMPLES_PER_SEGMENT * shares rows at most
    samples = picked.distinct().orderBy(*keys, "__o").collect()
    by_key: dict = {tuple(r): [] for r in hot_rows} if keys else {(): []}
    for r in samples:
        by_key.setdefault(tuple(r[k] for k in keys), []).append(r["__o"])
    table, last = [], {}
    for key, points in by_key.items():
        cuts = points[SAMPLES_PER_SEGMENT - 1 :: SAMPLES_PER_SEGMENT]
        edges = [None, *cuts, None]
        last[key] = len(edges) - 2
        for i in range(len(edges) - 1):
            table.append((*key, i, edges[i], edges[i + 1]))
    o_type = rows.schema["__o"].dataType
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField(f"__r_{k}", key_schema[k].dataType) for k in keys]
        + [T.StructField(SEG, T.IntegerType()), T.StructField("__lo", o_type), T.StructField("__hi", o_type)]
    )
    return Split(keys, order, spark.createDataFrame(table, schema), last)
