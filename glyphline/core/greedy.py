"""Greedy suppression: take rows best first, drop whatever conflicts with a taken row.

Rows that cannot conflict, directly or through others, are separated first: a gap of at
least the reach along x starts a new component. Components are small in practice and are
solved inside one streaming pass. Components above ``component_rows`` go in rounds: every row
that no better row is near is kept, what conflicts with it goes, and the rest goes round again. Nearness is
shared cells of a grid (with a level for each size of rows), so a round aggregates cells and makes no pairs of rows
but those of a kept row and what it may drop; a cell has one row at most that is kept in a round. Priorities without
a pattern need few rounds, however long the component. Where a round decides too little, as in a chain that gets worse
from end to end, the next one takes the best ``BLOCK`` rows of each component in order. Priorities are a
total order, so all ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import checkpoint, release, ship_package
from . import scan as S
from .skew import find_split, limits, same_keys, too_small_to_probe

BLOCK = 2_000


def components(df: DataFrame, keys, x: str, tie: str, reach, end: str | None = None) -> DataFrame:
    """Add ``__comp``. A row starts a component when its x is ``reach`` or more past all before it."""
    tail = end or x
    split = find_split(df, keys, [x, tie])
    df = S.scan(df, keys, [x, tie], split, __far=S.run_max(tail, inclusive=False))
    fresh = F.col("__far").isNull() | (F.col(x) - F.col("__far") >= F.lit(reach))
    df = df.withColumn("__new", fresh.cast("long")).drop("__far")
    return S.scan(df, keys, [x, tie], split, __comp=S.run_sum("__new")).drop("__new")


def greedy_pick(conflict: Callable) -> Callable:
    """Positions of the rows kept, for rows already in priority order."""

    def pick(*arrays):
        keep = np.ones(len(arrays[0]), dtype=bool)
        for i in range(len(keep) - 1):
            if keep[i]:
                keep[i + 1 :] &= ~conflict([a[i] for a in arrays], [a[i + 1 :] for a in arrays])
        return np.flatnonzero(keep)

    return pick


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before it; null equals null and NaN equals NaN."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    try:
        differ = pc.fill_null(pc.not_equal(now, before), False)
    except pa.ArrowNotImplementedError:
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values[1:], values)], dtype=bool)
    out = np.asarray(differ) | (np.asarray(pc.is_null(now)) != np.asarray(pc.is_null(before)))
    if pa.types.is_floating(column.type):
        out &= ~(np.asarray(pc.fill_null(pc.is_nan(now), False)) & np.asarray(pc.fill_null(pc.is_nan(before), False)))
    return out


def _solver(n_keys: int, n_num: int, pick: Callable, names: list[str]):
    """mapInArrow body over rows sorted by (keys, comp, priority).

    Columns: keys, comp, numeric columns for ``pick``, then the payload, which is handed on
    as it came. One component is held at a time; components are bounded by the caller.
    """

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None and rest.num_rows:
                t = pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            edge = np.ones(t.num_rows, dtype=bool)
            if t.num_rows > 1:
                edge[1:] = np.logical_or.reduce([_changes(t.column(i)) for i in range(n_keys + 1)])
            starts = np.flatnonzero(edge)
            # the last component may go on in the next batch
            cut = int(starts[-1])
            head, rest = t.slice(0, cut), t.slice(cut)
            if head.num_rows:
                yield from emit(head, starts[:-1])
        if rest is not None and rest.num_rows:
            yield from emit(rest, np.array([0]))

    def emit(t, starts):
        nums = [t.column(n_keys + 1 + i).to_numpy() for i in range(n_num)]
        ends = np.append(starts[1:], t.num_rows)
        rows = [np.array([a]) if b - a == 1 else a + pick(*[c[a:b] for c in nums]) for a, b in zip(starts, ends)]
        yield from t.take(pa.array(np.concatenate(rows))).rename_columns(names).to_batches()

    return run


def _solve_df(df: DataFrame, keys, priority: list[Column], nums: list[str], pick, payload: list[str]) -> DataFrame:
    ship_package(df.sparkSession)
    part = [*keys, "__comp"]
    cols = [*part, *[F.col(c).alias(f"__n{i}") for i, c in enumerate(nums)], *payload]
    laid = df.repartition(*part).sortWithinPartitions(*[F.col(c) for c in part], *priority)
    laid = laid.select(*cols)
    return laid.mapInArrow(_solver(len(keys), len(nums), pick, laid.columns), laid.schema).select(*part, *payload)


def component_map(df, keys, x, tie, reach, priority, nums, pick) -> DataFrame:
    """Rows at the positions ``pick`` returns for each component, in priority order.

    A component is a chain of rows with gaps under ``reach``: one crowded spot of a page.
    """
    tagged = components(df, keys, x, tie, reach)
    return _solve_df(tagged, keys, priority, nums, pick, [c for c in df.columns if c not in keys]).select(*df.columns)


def _cells(rows: DataFrame, box: tuple, levels: list[int], cols: list) -> DataFrame:
    """``cols`` of rows with the grid cells that their boxes touch: __lv, __cx, __cy, and __own on cells of a row's own level.

    ``box``: (low x, high x, low y, high y) as Columns. A row's level is the first whose cells are as large as it, so it
    touches two in each direction; in the cells of coarser levels it shows itself to larger rows.
    """
    lo_x, hi_x, lo_y, hi_y = box
    size = F.greatest(hi_x - lo_x, hi_y - lo_y)
    own = F.array_min(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: F.pow(F.lit(2.0), n) >= size))
    rows = rows.select(*cols, F.struct(lo_x.alias("x0"), hi_x.alias("x1"), lo_y.alias("y0"), hi_y.alias("y1")).alias("__b"), own.alias("__mine"))
    rows = rows.withColumn("__lv", F.explode(F.array(*[F.lit(n) for n in levels]))).filter(F.col("__lv") >= F.col("__mine"))
    side = F.pow(F.lit(2.0), F.col("__lv"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"__b.{a}") / side).cast("long"), F.floor(F.col(f"__b.{b}") / side).cast("long")))
    rows = rows.withColumn("__cx", span("x0", "x1")).withColumn("__cy", span("y0", "y1"))
    return rows.withColumn("__own", F.col("__lv") == F.col("__mine")).drop("__b", "__mine")


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _levels(rows: DataFrame, box: tuple) -> list[int]:
    """The levels of rows' sizes: as many as doublings lie between the smallest and the largest."""
    size = F.greatest(box[1] - box[0], box[3] - box[2])
    level = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1e-9)))), F.lit(-30)).cast("int")
    return sorted(r[0] for r in rows.select(level.alias("n")).distinct().collect() if r[0] is not None) or [0]


def _round(left: DataFrame, part, box, levels, nums, conflict_sql) -> tuple[DataFrame, DataFrame]:
    """(kept, rest) of one round over undecided rows with ``__p``, their place in the order of priority."""
    cell = [*part, "__lv", "__cx", "__cy"]
    seen = _cells(left, box, levels, [*part, "__p", *nums])
    least = lambda own: F.min(F.when(F.col("__own") == own, F.col("__p")))
    best = seen.groupBy(*cell).agg(least(True).alias("__mine"), least(False).alias("__less"))
    # only the best of a cell can be the best of all its cells
    few = best.filter(F.col("__mine").isNotNull()).select(F.col("__mine").alias("__q")).distinct()
    first = left.join(few, F.col("__p") == F.col("__q"), "left_semi")
    b = _renamed(best, "__b_")
    own = _cells(first, box, levels, [*part, "__p"])
    met = own.join(b, same_keys([F.col(c) for c in cell], [F.col(f"__b_{c}") for c in cell]))
    better = F.when(F.col("__own"), F.least("__b___mine", "__b___less")).otherwise(F.col("__b___mine"))
    won = met.groupBy("__p").agg(F.min(better).alias("__w")).filter(F.col("__w").isNull() | (F.col("__w") >= F.col("__p"))).select(F.col("__p").alias("__q"))
    kept = checkpoint(left.join(won, F.col("__p") == F.col("__q"), "left_semi"))
    w = _renamed(_cells(kept, box, levels, [*part, "__p", *nums]), "__w_")
    same = same_keys([F.col(c) for c in cell], [F.col(f"__w_{c}") for c in cell]) & (F.col("__own") | F.col("__w___own")) & (F.col("__p") != F.col("__w___p"))
    lost = seen.join(w, same & conflict_sql(lambda c: F.col(f"__w_{c}"), F.col)).select(F.col("__p").alias("__q"))
    gone = lost.unionByName(kept.select(F.col("__p").alias("__q"))).distinct()
    return kept, checkpoint(left.join(gone, F.col("__p") == F.col("__q"), "left_anti"))


def _block(left: DataFrame, keys, part, priority, nums, pick, payload, box, levels, conflict_sql) -> tuple[DataFrame, DataFrame]:
    """(kept, rest) after the best BLOCK rows of each component in order: for priorities that run along a component."""
    w = W.partitionBy(*part).orderBy("__p")
    top = left.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= BLOCK).drop("__rank")
    kept = checkpoint(_solve_df(top, keys, priority, nums, pick, [*payload, "__p"]))
    cell = [*part, "__lv", "__cx", "__cy"]
    seen = _cells(left, box, levels, [*part, "__p", *nums])
    v = _renamed(_cells(kept, box, levels, [*part, "__p", *nums]), "__w_")
    same = same_keys([F.col(c) for c in cell], [F.col(f"__w_{c}") for c in cell]) & (F.col("__own") | F.col("__w___own")) & (F.col("__p") != F.col("__w___p"))
    lost = seen.join(v, same & conflict_sql(lambda c: F.col(f"__w_{c}"), F.col)).select(F.col("__p").alias("__q"))
    gone = lost.unionByName(kept.select(F.col("__p").alias("__q"))).distinct()
    return kept, checkpoint(left.join(gone, F.col("__p") == F.col("__q"), "left_anti"))


def suppress(
    df: DataFrame,
    keys: list[str],
    x: str,
    tie: str,
    priority: list[Column],
    nums: list[str],
    conflict: Callable,
    conflict_sql: Callable[[Callable, Callable], Column],
    reach,
    box: tuple[Column, Column, Column, Column],
    end: str | None = None,
) -> DataFrame:
    """Rows that survive greedy suppression.

    ``conflict(one, many)`` works on numpy values of ``nums``; ``conflict_sql(a, b)`` is
    the same test between a survivor ``a`` and a candidate ``b`` as a Column, where each
    argument maps a column name to a Column. ``box`` (low x, high x, low y, high y) is each row's reach: rows in conflict
    have boxes that share a place.
    """
    names = df.columns
    payload = [c for c in names if c not in keys]
    tagged = components(df, keys, x, tie, reach, end)
    part = [*keys, "__comp"]
    pick = greedy_pick(conflict)
    if too_small_to_probe(df):
        return _solve_df(tagged, keys, priority, nums, pick, payload).select(*names)
    tagged = checkpoint(tagged)
    most = limits().component_rows
    sizes = tagged.groupBy(*part).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    if sizes.isEmpty():
        return _solve_df(tagged, keys, priority, nums, pick, payload).select(*names)
    big = sizes.select(*[F.col(c).alias(f"__b_{c}") for c in part])
    in_big = same_keys([F.col(c) for c in part], [F.col(f"__b_{c}") for c in part])
    done = _solve_df(tagged.join(big, in_big, "left_anti"), keys, priority, nums, pick, payload).select(*names)
    # one sort over all rows gives each its place; rounds then compare numbers
    left = checkpoint(tagged.join(big, in_big, "left_semi").orderBy(*priority).withColumn("__p", F.monotonically_increasing_id()))
    levels = _levels(left, box)
    n, slow = left.count(), False
    while n > most:
        if slow:
            kept, rest = _block(left, keys, part, priority, nums, pick, payload, box, levels, conflict_sql)
        else:
            kept, rest = _round(left, part, box, levels, nums, conflict_sql)
        done = done.unionByName(kept.select(*names))
        release(left)
        left, before, n = rest, n, rest.count()
        slow = not slow and before - n < before // 8
    return done.unionByName(_solve_df(left, keys, priority, nums, pick, payload).select(*names))
