"""De-duplication: greedy suppression, left-to-right sweeps, pairwise and class rules, top-n."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import scan as S
from ..core.fold import Rule, fold
from ..core.skew import probe_once
from ..core.greedy import component_map, suppress
from . import aggregates as A
from . import joins as J

HOLLOW_KEEP = 0.95  # a filled detection this strong is never replaced


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nms_overlap(df, keys, x1, y1, x2, y2, score, row_id, limit=0.3, relative_to="other") -> DataFrame:
    """Greedy box suppression, pixel-inclusive: drop a box when its intersection with a kept
    one exceeds ``limit`` of its own area (``other``) or of the smaller area (``min``)."""
    boxes = [x1, y1, x2, y2]

    def conflict(a, b):
        w = np.maximum(0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]) + 1)
        h = np.maximum(0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]) + 1)
        area = (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
        if relative_to == "min":
            area = np.minimum(area, (a[2] - a[0] + 1) * (a[3] - a[1] + 1))
        return w * h / area > limit

    def sql(a, b):
        side = lambda lo, hi: F.greatest(F.lit(0), F.least(a(hi), b(hi)) - F.greatest(a(lo), b(lo)) + 1)
        size = lambda r: (r(x2) - r(x1) + 1) * (r(y2) - r(y1) + 1)
        area = size(b) if relative_to == "other" else F.least(size(a), size(b))
        return side(x1, x2) * side(y1, y2) / area > limit

    whole = (F.col(x1), F.col(x2) + 1, F.col(y1), F.col(y2) + 1)
    return suppress(df, keys, x1, row_id, [F.col(score).desc(), F.col(row_id).asc()], boxes, conflict, sql, 1.0, whole, end=x2)


def _near(rx: float, ry: float | None):
    def conflict(a, b):
        hit = np.abs(a[0] - b[0]) < rx
        return hit & (np.abs(a[1] - b[1]) < ry) if ry is not None else hit

    return conflict


def _centre(df, keys, x, y, priority, row_id, rx, ry) -> DataFrame:
    def sql(a, b):
        hit = F.abs(a(x) - b(x)) < rx
        return hit & (F.abs(a(y) - b(y)) < ry) if y is not None else hit

    nums = [x] if y is None else [x, y]
    # rows nearer than the reach have boxes of that size that overlap
    unit = lambda c, r: (F.col(c) / float(r) - 0.5, F.col(c) / float(r) + 0.5)
    box = (*unit(x, rx), *(unit(y, ry) if y is not None else (F.lit(0.0), F.lit(0.0))))
    return suppress(df, keys, x, row_id, [*priority, F.col(row_id).asc()], nums, _near(rx, ry if y is not None else None), sql, rx, box)


def nms_center(df, keys, x, y, score, row_id, radius) -> DataFrame:
    """Keep the best of rows nearer than ``radius`` in x and (unless ``y`` is None) in y."""
    return _centre(df, keys, x, y, [F.col(score).desc()], row_id, radius, radius)


def nms_tiered(df, keys, x, y, tier, score, row_id, radius) -> DataFrame:
    """Lower tier first, then score; the reach in y is four times that in x."""
    return _centre(df, keys, x, y, [F.col(tier).asc(), F.col(score).desc()], row_id, radius, radius * 4)


class _KeepBest(Rule):
    """State: the kept row still open to replacement (x, score, id)."""

    def __init__(self, gap: float):
        self.gap = gap

    def step(self, state, row):
        if state is None:
            return row, []
        if row[0] - state[0] > self.gap:
            return row, [self._out(state)]
        return (row if row[1] > state[1] else state), []

    @staticmethod
    def _out(r):
        return (r[2], r[0], r[1])

    def finish(self, state):
        return [] if state is None else [self._out(state)]


def sweep_keep_best(df, keys, x, score, row_id, gap) -> DataFrame:
    """Left to right against the last kept row: at most ``gap`` on, the better score stays."""
    d = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(score).cast("double").alias("score"), F.col(row_id).alias("rid"))
    return fold(d, keys, ["x", "rid"], ["x", "score", "rid"], _KeepBest(gap), f"{row_id} long, {x} double, {score} double")


class _KeepFirst(Rule):
    """State: x of the last kept row."""

    def __init__(self, gap: float, inclusive: bool):
        self.gap, self.inclusive = gap, inclusive

    def step(self, state, row):
        x, rid = row
        if state is None or x - state > self.gap or (self.inclusive and x - state == self.gap):
            return x, [(rid, x)]
        return state, []


def sweep_keep_first(df, keys, x, row_id, gap, inclusive=False) -> DataFrame:
    """Keep a row when it is more than ``gap`` (or exactly, if inclusive) past the last kept."""
    d = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(row_id).alias("rid"))
    return fold(d, keys, ["x", "rid"], ["x", "rid"], _KeepFirst(gap, inclusive), f"{row_id} long, {x} double")


class _Average(Rule):
    """State: (running position, rows merged into it)."""

    def __init__(self, gap: float, whole: bool):
        self.gap, self.whole = gap, whole

    def step(self, state, row):
        x = row[0]
        if state is None:
            return (x, 1), []
        if abs(x - state[0]) > self.gap:
            return (x, 1), [state]
        mean = (state[0] + x) / 2.0
        return (float(np.floor(mean)) if self.whole else mean, state[1] + 1), []

    def finish(self, state):
        return [] if state is None else [state]


def sweep_average(df, keys, x, row_id, gap, whole=False) -> DataFrame:
    """Merge a row within ``gap`` of the last position into it by averaging the two."""
    d = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(row_id).alias("rid"))
    return fold(d, keys, ["x", "rid"], ["x"], _Average(gap, whole), f"{x} double, n long")


class _PairDedupe(Rule):
    """State: rows whose reach is still open, as (x, y, score, id, kept)."""

    start = ()

    def __init__(self, reach, y_apart, same_score):
        self.reach, self.y_apart, self.same = reach, y_apart, same_score

    def _close(self, buf):
        first, rest = buf[0], list(buf[1:])
        alive = first[4]
        if alive:
            for i, r in enumerate(rest):
                if r[0] - first[0] > self.reach:
                    break
                if not r[4] or (abs(first[2] - r[2]) < self.same and abs(first[1] - r[1]) > self.y_apart):
                    continue
                if first[2] >= r[2]:
                    rest[i] = (*r[:4], False)
                else:
                    alive = False
                    break
        return tuple(rest), [(first[3],)] if alive else []

    def step(self, state, row):
        out = []
        while state and row[0] - state[0][0] > self.reach:
            state, got = self._close(state)
            out += got
        return state + ((*row, True),), out

    def finish(self, state):
        out = []
        while state:
            state, got = self._close(state)
            out += got
        return out


def pair_dedupe(df, keys, x, y, score, row_id, dy) -> DataFrame:
    """Of two rows within 1 dy in x the lower score goes (the later on ties), unless the
    scores are equal and the rows are more than half a dy apart in y. Returns kept ids."""
    d = df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (score, "score"))], F.col(row_id).alias("rid"))
    return fold(d, keys, ["x", "rid"], ["x", "y", "score", "rid"], _PairDedupe(dy, dy * 0.5, 0.01), f"{row_id} long")


def class_replace(regular: DataFrame, hollow: DataFrame, keys, x, y, score, row_id, dy) -> DataFrame:
    """Reconcile two detection classes and dedupe the result.

    Hollow rows, deduped at 1.3 dy and best first, look for the first regular row within
    1.5 dy: a strong one (0.95) suppresses the hollow row, a weaker one is replaced by it,
    and unmatched hollow rows are added. Only rows linked by gaps under 1.5 dy interact.
    """
    cols = [*keys, x, y, score, row_id]
    h = nms_center(hollow.select(*cols), keys, x, y, score, row_id, dy * 1.3)
    both = regular.select(*cols, F.lit(0).alias("side")).unionByName(h.select(*cols, F.lit(1).alias("side")))

    def solve(cx, cy, cs, side):
        """Input positions of the output rows; regular rows come first by id, then hollow ones by score.

        Every regular row is a place with the row that holds it now; each hollow row meets all places at once.
        """
        places = np.flatnonzero(side == 0)
        px, py, ps, added = cx[places], cy[places], cs[places], []
        for h in np.flatnonzero(side == 1):
            near = np.flatnonzero(np.maximum(np.abs(px - cx[h]), np.abs(py - cy[h])) < dy * 1.5)
            if not len(near):
                added.append(h)
            elif ps[near[0]] < HOLLOW_KEEP:
                at = near[0]
                places[at], px[at], py[at], ps[at] = h, cx[h], cy[h], cs[h]
        return np.concatenate([places, np.array(added, dtype=int)])

    merged = component_map(both, keys, x, row_id, dy * 1.5,
                           [F.col("side").asc(), F.when(F.col("side") == 1, -F.col(score)).asc(), F.col(row_id).asc()],
                           [x, y, score, "side"], solve)
    return nms_center(merged, keys, x, y, score, row_id, dy).drop("side")


def argmax_group(df, keys, value, order, cols: list[str]) -> DataFrame:
    """The row with the largest value per group, the first in order on ties."""
    best = F.min_by(F.struct(*cols), F.struct(-F.col(value), *order))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


@probe_once
def natural_break(df, keys, x, tie, dy, name="threshold") -> DataFrame:
    """Spacing threshold of groups of three or more: the middle of the largest jump between
    sorted gaps (8 dy when all gaps are equal), at least 5 dy."""
    g = S.scan(df, keys, [x, tie], __p=S.lag(x)).withColumn("gap", F.col(x) - F.col("__p")).filter(F.col("gap").isNotNull())
    j = S.scan(g, keys, ["gap", tie], __ng=S.lead("gap"))
    jump = F.col("__ng") - F.col("gap")
    mid = F.max_by(F.when(jump > 0, (F.col("gap") + F.col("__ng")) / 2), F.when(jump > 0, F.struct(jump, -F.col("gap"))))
    out = j.groupBy(*keys).agg(mid.alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    return out.select(*keys, F.greatest(F.lit(dy * 5.0), F.coalesce("m", F.lit(dy * 8.0))).alias(name))


def topn_per_group(df, keys, order: list[Column], n: int, name="rank") -> DataFrame:
    """First n rows per group; Spark drops the rest before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def narrow_segment_purge(rows, bounds, starts, keys, x, score, row_id, companion=None):
    """Drop boundaries that close a narrow segment without real notes, or else the lone
    hollow note of a wide one. Returns (rows kept, boundaries kept).

    ``starts``: keys, start (left edge of the first segment). A note is real when it is not
    at the hollow floor of 0.80; two or more hollow notes together count as real. The last
    boundary always stays; groups with fewer than two boundaries or no notes stay whole.
    """
    b = S.scan(bounds.select(*keys, x), keys, [x], __p=S.lag(x), __n=S.lead(x), __k=S.total("count", x))
    b = b.join(starts.select(*keys, F.col("start").alias("__st")), keys, "left")
    b = b.withColumn("left", F.coalesce("__p", "__st", F.lit(0)))
    gap = F.when(F.col("__p").isNotNull() | (F.col("left") > 0), F.col(x) - F.col("left"))
    b = b.withColumn("__gap", gap)
    b = A.with_median(b, keys, "__gap", x, upper=True, name="__m")
    inside = J.neighbours(rows, b.select(*keys, x, "left"), keys, x, x, row_id, ["left"])
    # the segment of a row is that of the first boundary after it; rows on an edge are in none
    seg = F.when(F.col(x) > F.col("__next.left"), F.col("__next.at"))
    inside = inside.withColumn("__seg", seg).drop("__prev", "__next")
    s = F.coalesce(_c(score), F.lit(1.0))
    load = inside.filter(F.col("__seg").isNotNull()).groupBy(*keys, "__seg").agg(
        F.count(F.lit(1)).alias("__all"), F.count_if(s != 0.80).alias("__real"))
    any_row = rows.select(*keys).distinct().withColumn("__any", F.lit(True))
    b = b.join(load.withColumnRenamed("__seg", x), [*keys, x], "left").join(any_row, keys, "left")
    empty = (F.coalesce("__real", F.lit(0)) == 0) & (F.coalesce("__all", F.lit(0)) < 2)
    open_seg = empty & F.col("__n").isNotNull() & (F.col("__k") >= 2) & F.coalesce("__any", F.lit(False))
    narrow = (F.col("__m") > 0) & (F.col(x) - F.col("left") < F.col("__m") * 0.5)
    b = b.withColumns({"__cut": F.coalesce(open_seg & narrow, F.lit(False)),
                       "__lone": F.coalesce(open_seg & ~narrow & (F.col("__all") == 1), F.lit(False))})
    verdict = b.filter(F.col("__cut") | F.col("__lone")).select(*keys, F.col(x).alias("__seg"), "__cut", "__lone")
    kept = inside.join(verdict, [*keys, "__seg"], "left")
    gone = F.col("__lone")
    if companion is not None:
        gone |= F.col("__cut") & _c(companion)
    kept = kept.filter(~F.coalesce(gone, F.lit(False))).select(*rows.columns)
    return kept, b.filter(~F.col("__cut")).select(*keys, x)
