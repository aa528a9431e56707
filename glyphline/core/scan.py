"""Ordered scans: running values, neighbours and totals inside a group.

Everything is a Spark window over ``(keys)`` ordered by ``order``. When a group is
oversized the window runs over ``(keys, segment)`` instead, each segment is reduced to
one summary row, the summaries are scanned, and the carried value is combined with the
value inside the segment. The two plans give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import checkpoint
from .skew import SEG, Split, find_split, inside_operator, same_keys


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column
    inclusive: bool = True
    back: bool = False
    k: int = 1


def _col(e) -> Column:
    return F.col(e) if isinstance(e, str) else e


def row_number() -> Spec:
    return Spec("sum", F.lit(1).cast("long"))


def run_sum(e, inclusive=True, back=False) -> Spec:
    return Spec("sum", _col(e), inclusive, back)


def run_max(e, inclusive=True, back=False) -> Spec:
    return Spec("max", _col(e), inclusive, back)


def run_min(e, inclusive=True, back=False) -> Spec:
    return Spec("min", _col(e), inclusive, back)


def last_value(e, inclusive=True) -> Spec:
    """Latest non-null value up to (or before) the row."""
    return Spec("last", _col(e), inclusive)


def next_value(e, inclusive=True) -> Spec:
    """First non-null value from (or after) the row on."""
    return Spec("last", _col(e), inclusive, True)


def first_value(e, inclusive=True) -> Spec:
    """Earliest non-null value up to (or before) the row."""
    return Spec("first", _col(e), inclusive)


def lag(e, k=1) -> Spec:
    return Spec("lag", _col(e), k=k)


def lead(e, k=1) -> Spec:
    return Spec("lag", _col(e), back=True, k=k)


def total(fn: str, e) -> Spec:
    """Whole-group ``sum`` / ``max`` / ``min`` / ``avg`` / ``count`` on every row."""
    return Spec("total_" + fn, _col(e))


def _order(order, back):
    return [F.col(c).desc() if back else F.col(c).asc() for c in order]


def _fn(kind: str, e: Column) -> Column:
    return {
        "sum": lambda: F.sum(e),
        "max": lambda: F.max(e),
        "min": lambda: F.min(e),
        "last": lambda: F.last(e, ignorenulls=True),
        "first": lambda: F.first(e, ignorenulls=True),
        "avg": lambda: F.avg(e),
        "count": lambda: F.count(e),
    }[kind]()


def _window_expr(s: Spec, part: list[str], order: list[str]) -> Column:
    if s.kind.startswith("total_"):
        return _fn(s.kind[6:], s.expr).over(W.partitionBy(*part))
    # a backward scan is a forward scan over the reversed order: a frame open to the
    # right would be re-aggregated for every row
    w = W.partitionBy(*part).orderBy(*_order(order, s.back))
    if s.kind == "lag":
        return F.lag(s.expr, s.k).over(w)
    return _fn(s.kind, s.expr).over(w.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1))


def scan(df: DataFrame, keys: list[str], order: list[str], split: Split | None | str = "auto", **specs: Spec) -> DataFrame:
    """Add one column per spec. ``order`` must be a total order inside a group."""
    if split == "auto":
        split = find_split(df, keys, order)
    if split is None:
        return df.select("*", *[_window_expr(s, keys, order).alias(n) for n, s in specs.items()])
    out = _split_scan(split.tag(df), keys, order, specs)
    # the next scan of a multi-scan operator samples its own order from this result:
    # without a cut every one of them would run all the scans before it again
    return checkpoint(out) if inside_operator() else out


def _split_scan(rows: DataFrame, keys, order, specs) -> DataFrame:
    part = [*keys, SEG]
    lags = {n: s for n, s in specs.items() if s.kind == "lag"}
    base = {n: s.expr for n, s in specs.items()}
    rows = rows.select("*", *[e.alias(f"__e_{n}") for n, e in base.items()])
    here = F.struct(*order)
    hot = rows.filter(F.col(SEG).isNotNull())

    def e(n):
        return F.col(f"__e_{n}")

    # one summary row per segment of an oversized group
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for n, s in specs.items():
        if s.kind in ("last", "first"):
            pick = F.max_by if (s.kind == "last") != s.back else F.min_by
            aggs.append(pick(e(n), F.when(e(n).isNotNull(), here)).alias(f"__s_{n}"))
        elif s.kind == "total_avg":
            aggs += [F.sum(e(n)).alias(f"__s_{n}"), F.count(e(n)).alias(f"__t_{n}")]
        elif s.kind != "lag":
            aggs.append(_fn(s.kind.removeprefix("total_"), e(n)).alias(f"__s_{n}"))
    summary = hot.groupBy(*part).agg(*aggs)
    for back in (False, True):
        side = {n: s for n, s in lags.items() if s.back == back}
        if not side:
            continue
        k = max(s.k for s in side.values())
        w = W.partitionBy(*part).orderBy(*_order(order, not back))
        edge = hot.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
        packed = F.struct((-F.col("__rn")).alias("__rn"), *[e(n).alias(f"__v_{n}") for n in side])
        tail = edge.groupBy(*part).agg(F.array_sort(F.collect_list(packed)).alias(f"__edge{int(back)}"))
        t = tail.select(*[F.col(c).alias(f"__x_{c}") for c in part], f"__edge{int(back)}")
        summary = summary.join(
            F.broadcast(t), same_keys([F.col(c) for c in part], [F.col(f"__x_{c}") for c in part]), "left"
        ).drop(*[f"__x_{c}" for c in part])

    carried = []
    whole = W.partitionBy(*keys)
    for n, s in specs.items():
        fwd = W.partitionBy(*keys).orderBy(F.col(SEG).desc() if s.back else F.col(SEG).asc())
        if s.kind == "lag":
            # k segments hold at least k rows; far rows first, the row at the edge last
            arr = F.flatten(F.collect_list(f"__edge{int(s.back)}").over(fwd.rowsBetween(-s.k, -1)))
            carried.append(arr.alias(f"__c_{n}"))
        elif s.kind == "total_avg":
            carried.append((F.sum(f"__s_{n}").over(whole) / F.sum(f"__t_{n}").over(whole)).alias(f"__c_{n}"))
        elif s.kind.startswith("total_"):
            fn = s.kind[6:]
            carried.append(_fn("sum" if fn == "count" else fn, F.col(f"__s_{n}")).over(whole).alias(f"__c_{n}"))
        else:
            w = fwd.rowsBetween(W.unboundedPreceding, -1)
            carried.append(_fn(s.kind, F.col(f"__s_{n}")).over(w).alias(f"__c_{n}"))
    carry = summary.select(*[F.col(c).alias(f"__x_{c}") for c in part], "__rows", *carried)

    local = {n: _window_expr(Spec(s.kind, e(n), s.inclusive, s.back, s.k), part, order).alias(f"__l_{n}") for n, s in specs.items()}
    cols = list(local.values())
    if lags:
        for back in {s.back for s in lags.values()}:
            cols.append(F.row_number().over(W.partitionBy(*part).orderBy(*_order(order, back))).alias(f"__p{int(back)}"))
    out = rows.select("*", *cols)
    # one row per segment of the oversized groups: bounded by the split table
    out = out.join(
        F.broadcast(carry), same_keys([F.col(c) for c in part], [F.col(f"__x_{c}") for c in part]), "left"
    )
    result = {}
    for n, s in specs.items():
        l, c = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if s.kind == "lag":
            p = F.col(f"__p{int(s.back)}")
            # the carried rows end at the segment's edge: count back from the end
            far = F.get(c, F.size(c) + p - s.k - 1)[f"__v_{n}"]
            result[n] = F.when(F.col(SEG).isNull() | (p > s.k), l).otherwise(far)
        elif s.kind.startswith("total_"):
            result[n] = F.when(F.col(SEG).isNull(), l).otherwise(c)
        elif s.kind == "sum":
            result[n] = F.when(l.isNull(), c).when(c.isNull(), l).otherwise(l + c)
        elif s.kind == "max":
            result[n] = F.greatest(l, c)
        elif s.kind == "min":
            result[n] = F.least(l, c)
        elif s.kind == "last":
            result[n] = F.coalesce(l, c)
        else:
            result[n] = F.coalesce(c, l)
    keep = [c for c in rows.columns if not c.startswith("__e_") and c != SEG]
    return out.select(*keep, *[v.alias(n) for n, v in result.items()])
