"""Nearest, as-of, proximity, containment and range joins.

One-dimensional joins are ordered merges: both sides are unioned and scanned once per
group, so no pairs are made and an oversized group splits like any other scan. Joins in
two dimensions are equi joins on grid cells at least as wide as the reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import scan as S
from ..core.fold import Rule, fold

INF = float("inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def merge_scan(df: DataFrame, points: DataFrame, keys: list[str], x, at: str, tie: str, specs, cols: list[str]) -> DataFrame:
    """Scan rows and points together by position; points come first where positions are equal.

    ``specs`` maps names to scan specs over ``__pt``, the struct (at, *cols) on point rows.
    """
    names = df.columns
    left = df.withColumns({"__x": _c(x).cast("double"), "__s": F.lit(1), "__t": F.col(tie).cast("string")})
    point = F.struct(F.col(at).cast("double").alias("at"), *cols)
    right = points.select(
        *keys, F.col(at).cast("double").alias("__x"), F.lit(0).alias("__s"),
        F.to_json(point).alias("__t"), point.alias("__pt"))
    both = left.unionByName(right, allowMissingColumns=True)
    # rows order by position alone between points, so text ties are enough
    out = S.scan(both, keys, ["__x", "__s", "__t"], **specs)
    return out.filter(F.col("__s") == 1).select(*names, *specs)


def neighbours(df, points, keys, x, at, tie, cols=()) -> DataFrame:
    """Add ``__prev`` (last point at or before x) and ``__next`` (first point after x)."""
    return merge_scan(df, points, keys, x, at, tie,
                      {"__prev": S.last_value("__pt"), "__next": S.next_value("__pt")}, list(cols))


def nearest_assign(df, groups, keys, y, centre, idx, tie, max_dist=None) -> DataFrame:
    """Assign each row the group with the nearest centre, the lowest index on ties."""
    g = groups.groupBy(*keys, centre).agg(F.min(idx).alias(idx))
    out = neighbours(df, g, keys, y, centre, tie, [idx])
    dp, dn = _c(y) - F.col("__prev.at"), F.col("__next.at") - _c(y)
    left = F.col("__next").isNull() | (dp < dn) | ((dp == dn) & (F.col(f"__prev.{idx}") < F.col(f"__next.{idx}")))
    left = F.col("__prev").isNotNull() & left
    pick = F.when(left, F.col("__prev")).otherwise(F.col("__next"))
    out = out.withColumns({idx: pick[idx], "dist": F.when(left, dp).otherwise(dn)}).drop("__prev", "__next")
    return out.filter(F.col("dist") < max_dist) if max_dist is not None else out.filter(F.col("dist").isNotNull())


def range_nearest(df, pairs: DataFrame, keys, y, dy, row_id) -> DataFrame:
    """Assign rows to the nearer staff of a pair whose extended range holds them.

    ``pairs``: keys, pair_idx, t_top, t_bot, b_top, b_bot. A page has few pairs, so the
    join on the page key makes at most (rows x pairs of the page) candidates, which the
    partial aggregation collapses before the shuffle.
    """
    j = df.join(pairs, keys)
    yy, d = _c(y), _c(dy)
    treble = yy <= (F.col("t_bot") + F.col("b_top")) / 2.0
    centre = F.when(treble, (F.col("t_top") + F.col("t_bot")) / 2.0).otherwise((F.col("b_top") + F.col("b_bot")) / 2.0)
    j = j.filter((yy >= F.col("t_top") - d * 5) & (yy <= F.col("b_bot") + d * 5))
    best = F.min_by(F.struct("pair_idx", F.when(treble, "treble").otherwise("bass").alias("clef")),
                    F.struct(F.abs(yy - centre).alias("d"), F.col("pair_idx").alias("i")))
    return j.groupBy(*keys, row_id).agg(best.alias("b")).select(*keys, row_id, "b.*")


def box_anti(df, boxes: DataFrame, keys, x, y, margin) -> DataFrame:
    """Drop rows inside any box (x1, y1, x2, y2) grown by ``margin``.

    A box of any size is in four cells at most of a grid with cells at least as wide and high as it: cell sides are powers
    of four, for each direction by itself. Rows are looked up once for each pair of sides that some box has (their number
    grows with the logarithm of the sizes, and is counted first). Boxes that are empty or have a null drop nothing; a row
    with a null place stays.
    """
    grown = [(F.col(c) + s * F.lit(margin)).cast("double").alias(f"__{c}") for c, s in (("x1", -1), ("y1", -1), ("x2", 1), ("y2", 1))]
    b = boxes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *grown)
    b = b.filter((F.col("__x2") >= F.col("__x1")) & (F.col("__y2") >= F.col("__y1")))
    level = lambda lo, hi: F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1e-6))) / 2).cast("int")
    b = b.withColumns({"__lx": level("__x1", "__x2"), "__ly": level("__y1", "__y2")})
    sides = sorted(tuple(r) for r in b.select("__lx", "__ly").distinct().collect())
    for lx, ly in sides:
        wide, high = 4.0**lx, 4.0**ly
        span = lambda lo, hi, side: F.explode(F.sequence(F.floor(F.col(lo) / side).cast("long"), F.floor(F.col(hi) / side).cast("long")))
        cover = b.filter((F.col("__lx") == lx) & (F.col("__ly") == ly)).withColumn("__bx", span("__x1", "__x2", wide)).withColumn("__by", span("__y1", "__y2", high))
        rows = df.withColumns({"__cx": F.floor(_c(x) / wide).cast("long"), "__cy": F.floor(_c(y) / high).cast("long"), "__px": _c(x).cast("double"), "__py": _c(y).cast("double")})
        cond = (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by"))
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"__k_{k}"))
        inside = F.col("__px").between(F.col("__x1"), F.col("__x2")) & F.col("__py").between(F.col("__y1"), F.col("__y2"))
        df = rows.join(cover, cond & inside, "left_anti").drop("__cx", "__cy", "__px", "__py")
    return df


def proximity_anti(df, points, keys, x, at, tie, tol) -> DataFrame:
    """Drop rows with a point of their group strictly nearer than ``tol``."""
    out = neighbours(df, points, keys, x, at, tie)
    far = [F.col(c).isNull() | (F.abs(F.col(f"{c}.at") - _c(x)) >= tol) for c in ("__prev", "__next")]
    return out.filter(far[0] & far[1]).drop("__prev", "__next")


def before_first(df, bounds, keys, x, at) -> DataFrame:
    """Drop rows left of the first boundary of their group; groups without one stay whole."""
    first = bounds.groupBy(*keys).agg(F.min(at).alias("__first"))
    return df.join(first, keys, "left").filter(F.col("__first").isNull() | (F.col(x) >= F.col("__first"))).drop("__first")


def bracket_gap(df, points, keys, x, at, tie, min_gap) -> DataFrame:
    """Drop rows whose neighbours on both sides are closer together than ``min_gap``."""
    out = merge_scan(df, points, keys, x, at, tie, {"__prev": S.last_value("__pt"), "__next": S.next_value("__pt")}, [])
    gap = F.col("__next.at") - F.col("__prev.at")
    return out.filter(gap.isNull() | (gap >= min_gap)).drop("__prev", "__next")


def two_stage_assign(marks: DataFrame, notes: DataFrame, keys, dy: float, same_zone: Column | None = None) -> DataFrame:
    """Each mark takes its nearest valid note, each note keeps its best-scoring mark.

    ``marks``: keys, mark_id, mx, my, score. ``notes``: keys, note_id, nx, ny. A note is
    valid with -0.5 dy <= nx - mx <= 3.5 dy and |ny - my| <= 1.2 dy. Losers stay
    unassigned. Notes at one place are one note (the first, with its further columns), so a
    cell holds no more candidates than it has places. ``same_zone`` is a condition on further
    columns of both sides, such as the staves they lie on.
    """
    more = [c for c in notes.columns if c not in (*keys, "nx", "ny", "note_id")]
    n = notes.groupBy(*keys, "nx", "ny").agg(F.min_by(F.struct("note_id", *more), "note_id").alias("__n"))
    n = n.select(*keys, "nx", "ny", "__n.*")
    wide, tall = dy * 4.0, dy * 2.4
    n = n.withColumns({"__cx": F.floor((F.col("nx") + dy * 0.5) / wide), "__cy": F.floor(F.col("ny") / tall)})
    m = marks.withColumns({
        # the valid window spans at most two cells in each direction
        "__cx": F.explode(F.array_distinct(F.array(F.floor(F.col("mx") / wide), F.floor((F.col("mx") + wide) / wide))))})
    m = m.withColumn("__cy", F.explode(F.array_distinct(F.array(
        F.floor((F.col("my") - dy * 1.2) / tall), F.floor((F.col("my") + dy * 1.2) / tall)))))
    dx, dv = F.col("nx") - F.col("mx"), F.abs(F.col("ny") - F.col("my"))
    j = m.join(n, [*keys, "__cx", "__cy"]).filter((dx >= -dy * 0.5) & (dx <= dy * 3.5) & (dv <= dy * 1.2))
    if same_zone is not None:
        j = j.filter(same_zone)
    dist = F.sqrt(dx * dx + dv * dv)
    first = j.groupBy(*keys, "mark_id").agg(
        F.min_by(F.struct("note_id", "score"), F.struct(dist.alias("d"), F.col("note_id"))).alias("b"))
    return first.groupBy(*keys, F.col("b.note_id").alias("note_id")).agg(
        F.max_by(F.struct("mark_id", "b.score"), F.struct(F.col("b.score"), -F.col("mark_id"))).alias("w")
    ).select(*keys, "note_id", "w.mark_id", "w.score")


def snap_best(df, targets, keys, x, at, row_id, score, tol) -> DataFrame:
    """Snap rows to the nearest target within ``tol``; each target keeps the best score."""
    out = neighbours(df, targets, keys, x, at, row_id)
    dp, dn = _c(x) - F.col("__prev.at"), F.col("__next.at") - _c(x)
    left = F.col("__next").isNull() | (dp <= dn)
    target = F.when(F.col("__prev").isNotNull() & left, F.col("__prev.at")).otherwise(F.col("__next.at"))
    out = out.withColumn("target", target).filter(F.abs(F.col("target") - _c(x)) <= tol)
    return out.groupBy(*keys, "target").agg(
        F.max_by(F.struct(row_id, score), F.struct(F.col(score), -F.col(row_id))).alias("b")
    ).select(*keys, "target", "b.*")


class _GreedyPairs(Rule):
    """Lefts in order take the closest unused right nearer than ``tol``.

    State: (lefts waiting for later rights, unused rights still in reach).
    """

    def __init__(self, tol: float):
        self.tol, self.start = tol, ((), ())

    def _settle(self, lefts, rights, upto):
        out, lefts, rights = [], list(lefts), list(rights)
        while lefts and lefts[0][0] + self.tol <= upto:
            lx, lid = lefts.pop(0)
            best, dist = -1, self.tol
            for i, (rx, _) in enumerate(rights):
                if abs(lx - rx) < dist:
                    best, dist = i, abs(lx - rx)
            if best >= 0:
                rx, rid = rights.pop(best)
                out.append((lid, rid, (lx + rx) / 2.0))
            else:
                out.append((lid, None, lx))
        # rights no waiting or later left can reach
        floor = (lefts[0][0] if lefts else upto) - self.tol
        gone = [r for r in rights if r[0] <= floor]
        out += [(None, rid, rx) for rx, rid in gone]
        return (tuple(lefts), tuple(r for r in rights if r[0] > floor)), out

    def step(self, state, row):
        x, side, rid = row
        (lefts, rights), out = self._settle(*state, x)
        if side == 0:
            lefts += ((x, rid),)
        else:
            rights += ((x, rid),)
        return (lefts, rights), out

    def finish(self, state):
        return self._settle(*state, INF)[1]


def greedy_pair(left, right, keys, x, row_id, tol) -> DataFrame:
    """One-to-one pairs (left_id, right_id, x = mean); unmatched rows keep their own x.

    The state is the rows inside one tolerance window, never the group.
    """
    both = left.select(*keys, F.col(x).cast("double").alias("x"), F.lit(0).alias("side"), F.col(row_id).alias("rid")).unionByName(
        right.select(*keys, F.col(x).cast("double").alias("x"), F.lit(1).alias("side"), F.col(row_id).alias("rid")))
    return fold(both, keys, ["x", "side", "rid"], ["x", "side", "rid"], _GreedyPairs(tol), "left_id long, right_id long, x double")


def asof_backward(df, anchors, keys, x, at, value, tie, default, slack=0.0) -> DataFrame:
    """Add ``value`` of the last anchor at or before ``x + slack``; ``default`` when none."""
    out = merge_scan(df, anchors, keys, _c(x) + slack, at, tie, {"__prev": S.last_value("__pt")}, [value])
    return out.withColumn(value, F.coalesce(F.col(f"__prev.{value}"), F.lit(default))).drop("__prev")


def segment_by_boundary(df, bounds, keys, x, at, tie, name="measure_idx") -> DataFrame:
    """Number of boundaries at or before x; rows at negative x belong to no segment."""
    out = merge_scan(df, bounds, keys, x, at, tie, {name: S.run_sum(F.when(F.col("__s") == 0, 1).otherwise(0).cast("long"))}, [])
    return out.filter(_c(x) >= 0)


def midpoint_bind(markers, notes, keys, seg, mx, x, marker_id) -> DataFrame:
    """Bind markers to segments bounded by the midpoints between neighbouring note ranges."""
    r = notes.groupBy(*keys, seg).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    r = S.scan(r, keys, [seg], __pm=S.lag("__hi"), __nm=S.lead("__lo"))
    r = r.select(
        *keys, seg,
        F.coalesce((F.col("__pm") + F.col("__lo")) / 2.0, F.lit(-INF)).alias("lo"),
        F.coalesce((F.col("__hi") + F.col("__nm")) / 2.0, F.lit(INF)).alias("hi"))
    out = neighbours(markers, r, keys, mx, "lo", marker_id, [seg, "hi"])
    return out.filter(_c(mx) < F.col("__prev.hi")).withColumn(seg, F.col(f"__prev.{seg}")).drop("__prev", "__next")


def positional_zip(left, right, keys, pos, left_cols, right_cols) -> DataFrame:
    """Full outer join by position; the shorter side is padded with nulls."""
    l = left.select(*keys, pos, *left_cols)
    r = right.select(*keys, pos, *right_cols)
    return l.join(r, [*keys, pos], "full")


def section_left(truth, found, keys) -> DataFrame:
    """Every section of ``truth`` with a flag telling whether ``found`` has it."""
    f = found.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return truth.join(f, keys, "left").withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__hit")


def pair_count(df, keys, x, row_id, tol, x_name="n_pairs") -> DataFrame:
    """Pairs per group less than ``tol`` apart, counted from ranks without making pairs."""
    rows = df.select(*keys, F.col(x).cast("double").alias("__x"), F.lit(1).alias("__s"), F.col(row_id).alias("__t"))
    ends = rows.select(*keys, (F.col("__x") + tol).alias("__x"), F.lit(0).alias("__s"), "__t")
    r = S.scan(rows.unionByName(ends), keys, ["__x", "__s", "__t"], __r=S.run_sum(F.col("__s").cast("long")))
    # rows below the end of the reach minus rows up to the row itself
    signed = F.when(F.col("__s") == 0, F.col("__r")).otherwise(-F.col("__r"))
    return r.groupBy(*keys).agg(F.sum(signed).alias(x_name))


def stacked_pairs(df, keys, x, y, x_tol, y_low, y_high) -> DataFrame:
    """Pairs per group with |dx| < x_tol and y_low < |dy| < y_high (0 <= y_low).

    Rows are first counted per place; places of neighbouring cells are then paired.
    """
    p = df.groupBy(*keys, F.col(x).alias("ax"), F.col(y).alias("ay")).agg(F.count(F.lit(1)).alias("an"))
    p = p.withColumns({"cx": F.floor(F.col("ax") / x_tol), "cy": F.floor(F.col("ay") / y_high)})
    q = p.select(*keys, "cx", "cy", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("an").alias("bn"))
    # b lies above a, at most one cell up and one cell to either side
    up = p.withColumn("cx", F.explode(F.array(*[F.col("cx") + d for d in (-1, 0, 1)])))
    up = up.withColumn("cy", F.explode(F.array(F.col("cy"), F.col("cy") + 1)))
    dv = F.col("by") - F.col("ay")
    j = up.join(q, [*keys, "cx", "cy"]).filter((F.abs(F.col("bx") - F.col("ax")) < x_tol) & (dv > y_low) & (dv < y_high))
    return j.groupBy(*keys).agg(F.sum(F.col("an") * F.col("bn")).alias("n_pairs"))


def lone_rows(df, keys, x, y, x_tol, y_tol, row_id) -> DataFrame:
    """Rows without a partner at |dx| < x_tol and |dy| > y_tol.

    The highest and lowest y per place column are enough to decide, so only those join.
    """
    cols = df.groupBy(*keys, F.col(x).alias("__px")).agg(F.max(y).alias("__hi"), F.min(y).alias("__lo"))
    cols = cols.withColumn("__c", F.explode(F.array(*[F.floor(F.col("__px") / x_tol) + d for d in (-1, 0, 1)])))
    rows = df.withColumn("__c", F.floor(F.col(x) / x_tol))
    cond = [rows[k] == cols[k] for k in keys] + [
        rows["__c"] == cols["__c"], F.abs(rows[x] - cols["__px"]) < x_tol,
        (cols["__hi"] - rows[y] > y_tol) | (rows[y] - cols["__lo"] > y_tol)]
    return rows.join(cols, cond, "left_anti").drop("__c")


def lookup_first(df, value: str, table: list[tuple], default, name: str) -> DataFrame:
    """Label of the first table row (centre, tolerance, label) near the value."""
    from ..functions.scalar import first_within

    return df.withColumn(name, first_within(value, table, default))


def overlap_sum(boxes: DataFrame, runs: DataFrame, keys, box_id, name="overlap") -> DataFrame:
    """Sum over runs [r0, r1) of their overlap with the box's [b0, b1); 0 when none.

    What lies left of a place is a running sum over run ends: each start before it adds the distance to it, each end takes it
    off again. A box needs that at its two ends, so runs and boxes meet in one scan and no run is paired with a box.
    """
    end = lambda at, s: F.struct(_c(at).cast("double").alias("x"), F.lit(s).alias("s"))
    ends = runs.filter(F.col("r1") > F.col("r0")).select(*keys, F.explode(F.array(end("r0", 1), end("r1", -1))).alias("e"), F.lit(0).alias("__by"))
    asks = boxes.filter(F.col("b1") > F.col("b0")).select(
        *keys, F.explode(F.array(F.struct(end("b0", 0).alias("e"), F.lit(-1).alias("by")), F.struct(end("b1", 0).alias("e"), F.lit(1).alias("by")))).alias("q"), box_id)
    asks = asks.select(*keys, F.col("q.e").alias("e"), F.col("q.by").alias("__by"), box_id)
    both = ends.unionByName(asks, allowMissingColumns=True).select(*keys, box_id, "__by", F.col("e.x").alias("__x"), F.col("e.s").alias("__s"))
    both = both.withColumn("__t", F.xxhash64(box_id))
    order = ["__x", "__by", "__s", "__t"]
    seen = S.scan(both, keys, order, __open=S.run_sum("__s"), __at=S.run_sum(F.col("__s") * F.col("__x")))
    left = F.col("__open") * F.col("__x") - F.col("__at")
    found = seen.filter(F.col("__by") != 0).groupBy(*keys, box_id).agg(F.sum(F.col("__by") * left).alias(name))
    return boxes.join(found, [*keys, box_id], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


class _Propagate(Rule):
    """Copy longer minority-voice notes into later units that start before they end.

    A unit is [id, x, start, notes]; a note is (pitch, duration, stem). Units are settled
    in order once every unit they can reach, and whatever is near those, has arrived.
    State: (units settled but still near, units waiting).
    """

    def __init__(self, dy: float):
        self.near, self.start = dy * 1.5, ((), ())

    @staticmethod
    def _sustained(notes):
        """(minority stem, [(note, capped duration)]) of a two-voice unit."""
        stems = [n[2] for n in notes]
        ups, downs = stems.count("up"), stems.count("down")
        if len(notes) < 2 or not ups or not downs:
            return None, []
        minor = "up" if ups <= downs else "down"
        base = min(n[1] for n in notes if n[2] != minor)
        return minor, [(n, min(n[1], 2 * base)) for n in notes if n[2] == minor and n[1] > base]

    def _settle(self, done, wait, final):
        out, done, wait = [], list(done), [list(u) for u in wait]
        while wait:
            u = wait[0]
            minor, held = self._sustained(u[3])
            if held and not final:
                reach = u[2] + max(d for _, d in held)
                targets = [v for v in wait[1:] if v[2] < reach]
                last = wait[-1]
                if last[2] < reach or (targets and last[1] - targets[-1][1] < self.near):
                    break
            everyone = done + wait
            for note, dur in held:
                for v in wait[1:]:
                    if v[2] >= u[2] + dur:
                        break
                    if any(w is not u and abs(w[1] - v[1]) < self.near and self._has(w[3], minor) for w in everyone):
                        break
                    if all(n[0] != note[0] for n in v[3]):
                        v[3] = v[3] + ((note[0], min(n[1] for n in v[3]), note[2]),)
            done.append(wait.pop(0))
            floor = wait[0][1] - self.near if wait else (INF if final else -INF)
            while done and done[0][1] <= floor:
                v = done.pop(0)
                out.append((v[0], v[1], v[2], list(v[3])))
        if final:
            out += [(v[0], v[1], v[2], list(v[3])) for v in done]
            done = []
        return tuple(tuple(v) for v in done), tuple(tuple(v) for v in wait), out

    @staticmethod
    def _has(notes, minor):
        stems = [n[2] for n in notes]
        return minor in stems or (None in stems and len(notes) >= 2)

    def step(self, state, row):
        done, wait = state
        uid, x, start, notes = row
        notes = tuple((n["pitch"], float(n["dur"]), n["stem"]) for n in notes)
        done, wait, out = self._settle(done, wait + ((uid, x, start, notes),), False)
        return (done, wait), [self._row(o) for o in out]

    @staticmethod
    def _row(o):
        return (o[0], o[1], o[2], [{"pitch": p, "dur": d, "stem": s} for p, d, s in o[3]])

    def finish(self, state):
        return [self._row(o) for o in self._settle(*state, True)[2]]


def overlap_propagate(units: DataFrame, keys, dy: float) -> DataFrame:
    """Two-voice alignment. ``units``: keys, unit_id, x, notes ARRAY<STRUCT<pitch,dur,stem>>."""
    shortest = F.coalesce(F.array_min(F.transform("notes", lambda n: n["dur"])), F.lit(0.25))
    timed = S.scan(units, keys, ["x", "unit_id"], start=S.run_sum(shortest, inclusive=False))
    timed = timed.withColumn("start", F.coalesce("start", F.lit(0.0)))
    return fold(timed, keys, ["x", "unit_id"], ["unit_id", "x", "start", "notes"], _Propagate(dy),
                "unit_id long, x double, start double, notes array<struct<pitch:string,dur:double,stem:string>>")
