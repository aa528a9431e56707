"""Sequence operators: clusters, runs, windows, carries and rewrites in order inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import scan as S
from ..core.fold import Rule, fold
from ..core.skew import find_split, probe_once
from . import aggregates as A
from . import joins as J


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@probe_once
def gap_cluster(df, keys, x, tie, tol, name="cluster") -> DataFrame:
    """Number clusters from 1; a gap of ``tol`` or more starts a new one."""
    split = find_split(df, keys, [x, tie])
    d = S.scan(df, keys, [x, tie], split, __p=S.lag(x))
    d = d.withColumn("__new", F.when(F.col(x) - F.col("__p") < tol, 0).otherwise(1).cast("long"))
    return S.scan(d, keys, [x, tie], split, **{name: S.run_sum("__new")}).drop("__p", "__new")


def cluster_centres(df, keys, x, tie, tol) -> DataFrame:
    """One row per cluster: its integer mean and size."""
    c = gap_cluster(df, keys, x, tie, tol)
    return c.groupBy(*keys, "cluster").agg(F.floor(F.avg(x)).alias("centre"), F.count(F.lit(1)).alias("n"))


def threshold_runs(df, keys, pos, flag: Column, min_width=1, max_width=None, max_gap=0) -> DataFrame:
    """Runs [start, end) of consecutive integer positions where ``flag`` holds.

    Runs at most ``max_gap`` apart are merged before widths are checked.
    """
    d = df.filter(flag)
    runs = gap_cluster(d, keys, pos, pos, 2 + max_gap, "__run") if max_gap else None
    if runs is None:
        runs = S.scan(d, keys, [pos], __n=S.row_number()).withColumn("__run", F.col(pos) - F.col("__n"))
    out = runs.groupBy(*keys, "__run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))
    out = out.drop("__run").withColumn("width", F.col("end") - F.col("start")).filter(F.col("width") >= min_width)
    return out.filter(F.col("width") <= max_width) if max_width is not None else out


@probe_once
def median_split(df, keys, x, tie, factor=3.0, name="run") -> DataFrame:
    """Split into runs at gaps above ``factor`` times the group's median gap."""
    split = find_split(df, keys, [x, tie])
    d = S.scan(df, keys, [x, tie], split, __p=S.lag(x)).withColumn("__gap", F.col(x) - F.col("__p"))
    d = A.with_median(d, keys, "__gap", tie, upper=False, name="__med")
    d = d.withColumn("__new", F.coalesce(F.col("__gap") > F.col("__med") * factor, F.lit(False)).cast("long"))
    return S.scan(d, keys, [x, tie], split, **{name: S.run_sum("__new")}).drop("__p", "__gap", "__med", "__new")


def best_window5(df, keys, x, limit=0.8) -> DataFrame:
    """The five consecutive rows with the most even gaps, one window per group, first on ties."""
    d = S.scan(df.select(*keys, F.col(x).alias("x1")), keys, ["x1"], **{f"x{i}": S.lead("x1", i - 1) for i in range(2, 6)})
    d = d.filter(F.col("x5").isNotNull())
    gaps = [F.col(f"x{i + 1}") - F.col(f"x{i}") for i in range(1, 5)]
    mean = (gaps[0] + gaps[1] + gaps[2] + gaps[3]) / 4.0
    d = d.filter(mean > 0).withColumn("spread", (F.greatest(*gaps) - F.least(*gaps)) / mean).filter(F.col("spread") < limit)
    best = F.min_by(F.struct("x1", "x2", "x3", "x4", "x5", "spread"), F.struct("spread", "x1"))
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


@probe_once
def gap_with_boundary(df, keys, x, tie, boundary, last="known", name="gap") -> DataFrame:
    """Gap to the next row. The last row uses the gap to ``boundary``; without one it takes
    the gap before it (``last='known'``) or 0 (``'zero'``). With ``'near_median'`` the
    boundary counts only within 0.3 to 3 times the upper median of two or more gaps."""
    split = find_split(df, keys, [x, tie])
    d = S.scan(df, keys, [x, tie], split, __nx=S.lead(x), __px=S.lag(x))
    step = F.col("__nx") - F.col(x)
    known = F.coalesce(F.col(x) - F.col("__px"), F.lit(0.0))
    to_edge = F.when(_c(boundary) > F.col(x), _c(boundary) - F.col(x))
    if last == "known":
        end = F.coalesce(to_edge, known)
    elif last == "zero":
        end = F.coalesce(to_edge, F.lit(0.0))
    else:
        d = A.with_median(d.withColumn("__g", step), keys, "__g", tie, upper=True, name="__m")
        d = S.scan(d, keys, [x, tie], split, __k=S.total("count", "__g")).drop("__g")
        ok = (F.col("__k") >= 2) & (F.col("__m") > 0) & to_edge.between(F.col("__m") * 0.3, F.col("__m") * 3.0)
        end = F.when(F.coalesce(ok, F.lit(False)), to_edge).otherwise(known)
    out = d.withColumn(name, F.coalesce(step, end))
    return out.drop("__nx", "__px", *(["__m", "__k"] if last == "near_median" else []))


@probe_once
def fixpoint_promote(df, keys, x, tie, beams="beams", flag="flag", duration="duration") -> DataFrame:
    """Promote unbeamed rows between beamed ones to one beam, to the fixpoint.

    A row qualifies when it is interior, its two gaps are even (ratio under 1.3), and a
    beamed row lies within three rows on each side. Promoting needs beamed rows on both
    sides, so a stretch without beams of six rows or more never starts; in stretches of
    up to five, the second pass already finds all that any later pass would.
    """
    split = find_split(df, keys, [x, tie])
    order = [x, tie]
    d = S.scan(df, keys, order, split, __px=S.lag(x), __nx=S.lead(x))
    left, right = F.abs(F.col(x) - F.col("__px")), F.abs(F.col("__nx") - F.col(x))
    even = (left > 0) & (right > 0) & (F.greatest(left, right) / F.least(left, right) < 1.3)
    d = d.withColumn("__fit", F.coalesce(even & (F.col(beams) == 0) & ~F.col(flag), F.lit(False))).drop("__px", "__nx")
    d = d.withColumn("__b", F.col(beams) >= 1)
    for _ in range(2):
        near = {f"__{side}{i}": f("__b", i) for side, f in (("l", S.lag), ("r", S.lead)) for i in (1, 2, 3)}
        d = S.scan(d, keys, order, split, **near)
        any_of = lambda s: F.coalesce(F.greatest(*[F.col(f"__{s}{i}") for i in (1, 2, 3)]), F.lit(False))
        d = d.withColumn("__b", F.col("__b") | (F.col("__fit") & any_of("l") & any_of("r"))).drop(*near)
    up = F.col("__b") & (F.col(beams) < 1)
    return d.withColumns({
        duration: F.when(up, 0.5).otherwise(F.col(duration)), beams: F.when(up, 1).otherwise(F.col(beams)), "promoted": up,
    }).drop("__fit", "__b")


def pattern_rewrite(df, keys, x, tie, dy, beams="beams", dot="dot", duration="duration") -> DataFrame:
    """Dotted pair, extended pair, false-dot suppression: the first rule that fits wins.

    Rules look only at unchanged neighbours, so one pass of neighbour lookups does it.
    """
    specs = {"__x1": S.lead(x, 1), "__x2": S.lead(x, 2), "__b1": S.lead(beams, 1), "__b2": S.lead(beams, 2), "__bp": S.lag(beams)}
    specs |= {f"__d{i}": S.lead(duration, i) for i in range(1, 8)}
    d = S.scan(df, keys, [x, tie], **specs)
    b, b1, b2, bp = F.col(beams), F.col("__b1"), F.col("__b2"), F.col("__bp")
    gap1, gap2 = F.abs(F.col("__x1") - F.col(x)), F.abs(F.col("__x2") - F.col("__x1"))
    pair = (b >= 1) & (b1 >= 2) & (gap1 < _c(dy) * 5)
    wide = (b >= 1) & (b1 == 1) & (gap2 > 0) & (gap1 / gap2 > 1.5) & (bp != b)
    same = (b == b1) & (b >= 1)
    fwd, bwd = F.coalesce(b2 == b, F.lit(False)), F.coalesce(bp == b, F.lit(False))
    long_ahead = F.coalesce(F.greatest(*[F.col(f"__d{i}") for i in range(1, 8)]) > 1.0, F.lit(False))
    drop = same & fwd & (bwd | long_ahead)
    yes = lambda c: F.coalesce(c, F.lit(False))
    rule = (
        F.when(~F.col(dot) | F.col("__x1").isNull(), "none").when(yes(pair), "pair").when(yes(wide), "extended")
        .when(yes(drop), "undot").otherwise("none"))
    d = d.withColumn("rule", rule)
    return d.withColumns({
        duration: F.when(F.col("rule").isin("pair", "extended"), 0.75).when(F.col("rule") == "undot", F.col(duration) / 1.5).otherwise(F.col(duration)),
        dot: F.col(dot) & (F.col("rule") != "undot"),
    }).drop(*specs)


@probe_once
def spacing_filter(df, keys, x, tie, score, ratio=0.6, weak=0.7) -> DataFrame:
    """Drop interior rows that sit too close on both sides and score well below both neighbours."""
    d = S.scan(df, keys, [x, tie], __px=S.lag(x), __nx=S.lead(x), __ps=S.lag(score), __ns=S.lead(score))
    d = d.withColumn("__g", F.col("__nx") - F.col(x))
    d = A.with_median(d, keys, "__g", tie, upper=True, name="__m")
    lg, rg, m = F.col(x) - F.col("__px"), F.col("__g"), F.col("__m")
    bad = (
        (lg < m * ratio) & (rg < m * ratio) & (F.abs(lg + rg - m) < F.abs(lg - m))
        & (F.col(score) < F.least("__ps", "__ns") * weak) & F.col("__px").isNotNull() & F.col("__nx").isNotNull())
    return d.filter(~F.coalesce(bad, F.lit(False))).drop("__px", "__nx", "__ps", "__ns", "__g", "__m")


def running_start(df, keys, order, duration, name="start") -> DataFrame:
    """Start time: the sum of the durations before the row."""
    out = S.scan(df, keys, order, **{name: S.run_sum(_c(duration), inclusive=False)})
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def carry_last(df, keys, order, value, default, name) -> DataFrame:
    """Latest non-null value so far."""
    out = S.scan(df, keys, order, **{name: S.last_value(value)})
    return out.withColumn(name, F.coalesce(name, F.lit(default)))


def carry_first(df, keys, order, value, ok: Column, name) -> DataFrame:
    """Override for a page: the first value any earlier good page gave, null before that."""
    return S.scan(df, keys, order, **{name: S.first_value(F.when(ok, _c(value)), inclusive=False)})


def renumber_global(df, keys, order, name="line_no") -> DataFrame:
    return S.scan(df, keys, order, **{name: S.row_number()})


@probe_once
def gap_expiring_fill(df, keys, x, tie, sign, key_sign, reach, name="shown") -> DataFrame:
    """Carry an explicit sign on along its key while each step stays within ``reach``.

    ``n`` is a natural: it shows nothing and cancels both the carried sign and the key
    signature while in reach. Rows without a live sign show ``key_sign`` (nullable).
    """
    order = [x, tie]
    split = find_split(df, keys, order)
    explicit = F.col(sign).isNotNull() & (F.col(sign) != "")
    d = S.scan(df, keys, order, split, __grp=S.run_sum(explicit.cast("long")), __last=S.last_value(F.when(explicit, F.col(sign))), __px=S.lag(x))
    step = F.when(~explicit, F.abs(F.col(x) - F.col("__px")))
    d = S.scan(d.withColumn("__step", step), [*keys, "__grp"], order, __far=S.run_max("__step"))
    live = (F.col("__grp") > 0) & (F.coalesce(F.col("__far"), F.lit(0.0)) <= _c(reach))
    natural = F.col("__last") == "n"
    shown = F.when(live, F.when(natural, "").otherwise(F.col("__last"))).otherwise(F.coalesce(_c(key_sign), F.lit("")))
    return d.withColumn(name, shown).drop("__grp", "__last", "__px", "__step", "__far")


def trim_empty(df, keys, order, nonempty: Column, leading=True, trailing=True) -> DataFrame:
    """Drop empty groups before the first and after the last non-empty one."""
    d = S.scan(df, keys, order, __a=S.run_max(nonempty.cast("int")), __b=S.run_max(nonempty.cast("int"), back=True))
    ok = F.lit(True)
    if leading:
        ok &= F.col("__a") == 1
    if trailing:
        ok &= F.col("__b") == 1
    return d.filter(ok).drop("__a", "__b")


class _TailDedupe(Rule):
    """State: kept events (x, members) within reach of the current one."""

    start = ()

    def __init__(self, dy: float):
        self.dy = dy

    def step(self, state, row):
        rid, x, ys = row
        ys = tuple(ys)
        near = tuple(e for e in state if x - e[0] <= self.dy * 5)
        for _, old in near:
            if len(old) == len(ys) and all(abs(a - b) <= self.dy * 0.25 for a, b in zip(ys, old)):
                return near, []
        return near + ((x, ys),), [(rid,)]


@probe_once
def tail_merge(df, keys, seg, last_seg, x, row_id, dy, is_rest: Column, ys: str) -> DataFrame:
    """Move events after the last boundary into the segment before it.

    Rests there are dropped, and so is a note with a look-alike in that segment or among
    the notes already moved: as many members, each within 0.25 dy of its counterpart, at
    most 5 dy away. ``ys`` is an array of member positions, ``last_seg`` the number of the
    trailing segment. A group without boundaries has no closed segment and yields nothing.
    """
    d = df.withColumn("__ys", F.array_sort(ys))
    body = d.filter(F.col(seg) < F.col(last_seg))
    tail = d.filter((F.col(seg) == F.col(last_seg)) & (F.col(last_seg) > 0) & ~is_rest)
    reach = dy * 5
    old = d.filter((F.col(seg) == F.col(last_seg) - 1) & ~is_rest)
    # one candidate per place and shape is enough for an existence test
    old = old.select(*keys, F.col(x).alias("__ox"), F.col("__ys").alias("__oys")).distinct()
    old = old.withColumn("__c", F.explode(F.array(*[F.floor(F.col("__ox") / reach) + i for i in (-1, 0, 1)])))
    t = tail.withColumn("__c", F.floor(F.col(x) / reach))
    alike = (F.size("__ys") == F.size("__oys")) & F.forall(
        F.zip_with("__ys", "__oys", lambda a, b: F.coalesce(F.abs(a - b) <= dy * 0.25, F.lit(False))), lambda v: v)
    cond = [t[k].eqNullSafe(old[k]) for k in keys] + [t["__c"] == old["__c"], F.abs(t[x] - old["__ox"]) <= reach, alike]
    fresh = t.join(old, cond, "left_anti").drop("__c")
    kept = fold(fresh, keys, [x, row_id], [row_id, x, "__ys"], _TailDedupe(dy), f"{row_id} long")
    kept = kept.select(*[F.col(c).alias(f"__k_{c}") for c in [*keys, row_id]])
    mine = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*keys, row_id]]
    moved = fresh.join(kept, mine, "left_semi").withColumn(seg, F.col(seg) - 1)
    return body.unionByName(moved).drop("__ys")


def wide_gap_split(bounds, candidates, ref, keys, x, cand_x, cand_id, floor) -> DataFrame:
    """Best extra boundary for gaps above 1.8 times the reference median of the group.

    ``ref``: keys, median. A candidate must leave both parts between 0.5 and 2 medians.
    """
    r = ref.select(*keys, F.col("median").alias("__m"))
    b = bounds.join(r, keys).filter(F.col("__m") >= floor)
    c = J.neighbours(candidates, b, keys, cand_x, x, cand_id, ["__m"])
    lg, rg, m = F.col(cand_x) - F.col("__prev.at"), F.col("__next.at") - F.col(cand_x), F.col("__prev.__m")
    ok = (lg + rg > m * 1.8) & (lg > m * 0.5) & (lg < m * 2.0) & (rg > m * 0.5) & (rg < m * 2.0)
    c = c.filter(ok).withColumns({"left_x": F.col("__prev.at"), "fit": F.abs(lg - m) + F.abs(rg - m)})
    return c.groupBy(*keys, "left_x").agg(F.min_by(F.struct(cand_id, cand_x), F.struct("fit", cand_x, cand_id)).alias("b")).select(*keys, "left_x", "b.*")


class _Pack(Rule):
    """State: (line number, used width)."""

    start = (0, None)

    def __init__(self, limit: float, sep: float):
        self.limit, self.sep = limit, sep

    def step(self, state, row):
        line, used = state
        rid, width = row
        if used is None:
            line, used = (line or 1), width
        elif used + self.sep + width > self.limit:
            line, used = line + 1, width
        else:
            used += self.sep + width
        return (line, used), [(rid, line)]

    def parts(self, state):
        # where a line breaks depends on the width used, not on the line's number
        line, used = state
        return (0, state) if used is None else (line, (0, used))

    def after(self, added, end):
        return added + end[0], end[1]


def line_pack(df, keys, order, row_id, width, limit, sep) -> DataFrame:
    """Greedy line number of each part: a part that would overflow starts a new line."""
    return fold(df, keys, order, [row_id, width], _Pack(limit, sep), f"{row_id} long, line long")
