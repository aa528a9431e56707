"""Grouping of detections into chords, staves and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import scan as S
from ..core.fold import Rule, fold
from ..core.skew import probe_once, same_keys

INF = float("inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class _SeedCluster(Rule):
    """State: open groups as (seed row, member ys); a row is (x, stem_x, stem, y, id)."""

    start = ()

    def __init__(self, dy: float, single_staff: bool):
        self.stem_reach, self.x_reach, self.y_reach = dy * 0.5, dy * 0.9, dy * 4.0
        self.single = single_staff

    def step(self, state, row):
        x, stem_x, stem, y, rid = row
        groups, kept = list(state), []
        for i, (seed, ys) in enumerate(groups):
            if self.single and stem is not None and seed[2] is not None and stem != seed[2]:
                kept.append(groups[i])
                continue
            close = abs(stem_x - seed[1]) < self.stem_reach or abs(x - seed[0]) < self.x_reach
            if close and min(abs(y - v) for v in ys) <= self.y_reach:
                return tuple(kept) + ((seed, ys + (y,)),) + tuple(groups[i + 1 :]), [(rid, seed[4])]
            if x - seed[0] < self.x_reach:
                kept.append(groups[i])
            # else: the first miss past the reach closes the group
        return tuple(kept) + ((row, (y,)),), [(rid, rid)]


def seed_cluster(df, keys, x, stem_x, stem, y, row_id, dy, single_staff=False) -> DataFrame:
    """(row id, seed id): chords by nearness to the first member and to any member in y.

    The state is the groups still open, those with a seed within reach of the current x.
    """
    d = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(stem_x).cast("double").alias("stem_x"),
                  _c(stem).alias("stem"), F.col(y).cast("double").alias("y"), F.col(row_id).alias("rid"))
    return fold(d, keys, ["x", "rid"], ["x", "stem_x", "stem", "y", "rid"], _SeedCluster(dy, single_staff),
                f"{row_id} long, seed_id long")


class _OrphanMerge(Rule):
    """State: (groups waiting, index of the next to settle).

    A group is (seed id, seed x, members), a member (id, x, y, stem).
    """

    start = ((), 0)

    def __init__(self, dy: float, single_staff: bool):
        self.x_reach, self.y_reach, self.single = dy * 0.9, dy * 4.0, single_staff

    def _best(self, groups, i):
        rid, x, y, stem = groups[i][2][0]
        best, dist = None, INF
        for j, g in enumerate(groups):
            m = g[2]
            if j == i or len(m) < 2 or abs(x - sum(v[1] for v in m) / len(m)) >= self.x_reach:
                continue
            if self.single and stem is not None:
                stems = {v[3] for v in m}
                if stem not in stems and None not in stems:
                    continue
            d = min(abs(y - v[2]) for v in m)
            if d <= self.y_reach and d < dist:
                best, dist = j, d
        return best

    def _settle(self, groups, nxt, upto):
        groups, out = list(groups), []
        while nxt < len(groups) and groups[nxt][1] + self.x_reach < upto:
            g = groups[nxt]
            j = self._best(groups, nxt) if len(g[2]) == 1 else None
            if j is None:
                nxt += 1
                continue
            t = groups[j]
            groups[j] = (t[0], t[1], t[2] + g[2])
            groups.pop(nxt)
        # no single row still to settle can reach groups this far left
        floor = groups[nxt][1] if nxt < len(groups) else upto
        i = 0
        while i < nxt:
            m = groups[i][2]
            if sum(v[1] for v in m) / len(m) + self.x_reach <= floor:
                out += [(v[0], groups[i][0]) for v in m]
                groups.pop(i)
                nxt -= 1
            else:
                i += 1
        return (tuple(groups), nxt), out

    def step(self, state, row):
        seed, seed_x, rid, x, y, stem = row
        groups, nxt = state
        member = (rid, x, y, stem)
        if groups and groups[-1][0] == seed:
            g = groups[-1]
            return (groups[:-1] + ((seed, seed_x, g[2] + (member,)),), nxt), []
        # all groups before this one are complete
        (groups, nxt), out = self._settle(groups, nxt, seed_x)
        return (groups + ((seed, seed_x, (member,)),), nxt), out

    def finish(self, state):
        return self._settle(*state, INF)[1]


def orphan_merge(df, keys, seed_id, x, y, stem, row_id, dy, single_staff=False) -> DataFrame:
    """Merge one-member groups into the nearest group (in y) whose mean x is within reach."""
    # the seed is the leftmost member of its group
    d = S.scan(df, [*keys, seed_id], [x, row_id], seed_x=S.total("min", F.col(x).cast("double"))).select(
        *keys, F.col(seed_id).alias("sid"), "seed_x", F.col(row_id).alias("rid"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), _c(stem).alias("stem"))
    return fold(d, keys, ["seed_x", "sid", "x", "rid"], ["sid", "seed_x", "rid", "x", "y", "stem"],
                _OrphanMerge(dy, single_staff), f"{row_id} long, {seed_id} long")


def group_summary(df, keys, group, x, y, stem_x, stem, length, row_id) -> DataFrame:
    """Mean x, stem of the longest-stemmed member, members from low to high: one row per chord."""
    from .aggregates import ordered_concat

    has = _c(stem).isNotNull()
    pick = F.min_by(F.struct(_c(stem).alias("stem"), F.col(stem_x).cast("double").alias("sx")), F.when(has, F.struct(-F.col(length), F.col(row_id))))
    a = df.groupBy(*keys, group).agg(F.avg(x).alias("x"), pick.alias("b"), F.avg(stem_x).alias("mean_stem"), F.count(F.lit(1)).alias("n"))
    a = a.select(*keys, group, "x", "n", F.col("b.stem").alias("stem"), F.coalesce(F.col("b.sx"), F.floor("mean_stem")).alias("stem_x"))
    d = df.withColumn("__low", -F.col(y))
    m = ordered_concat(d, [*keys, group], ["__low", row_id], F.col(row_id).cast("string"), " ", name="members")
    same = same_keys([F.col(k) for k in [*keys, group]], [F.col(f"__m_{k}") for k in [*keys, group]])
    m = m.select(*[F.col(k).alias(f"__m_{k}") for k in [*keys, group]], "members")
    return a.join(m, same).select(*a.columns, "members")


def layout_class(df, keys, order, top, bottom, name="layout") -> DataFrame:
    """'single' for one staff or evenly spaced staves (max/min gap under 1.6), else 'grand'."""
    d = S.scan(df, keys, [order], __nt=S.lead(top)).withColumn("__g", F.col("__nt") - _c(bottom))
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__g").alias("lo"), F.max("__g").alias("hi"))
    even = (F.col("lo") > 0) & (F.col("hi") / F.col("lo") < 1.6)
    kind = F.when(F.col("n") < 2, "single").when(F.col("n") < 3, "grand").when(even, "single").otherwise("grand")
    return a.select(*keys, kind.alias(name))


@probe_once
def pair_consecutive(df, keys, order, top, bottom, factor=4.0) -> DataFrame:
    """Pairs (row, next row) left to right: a close pair uses both rows.

    Inside a stretch of rows that could each pair with the next, every other row does.
    """
    d = S.scan(df, keys, [order], __nt=S.lead(top), second=S.lead(order), __rn=S.row_number())
    fits = F.coalesce(F.col("__nt") - _c(bottom) < (_c(bottom) - _c(top)) * factor, F.lit(False))
    d = d.withColumn("__fit", fits)
    d = S.scan(d, keys, [order], __miss=S.last_value(F.when(~F.col("__fit"), F.col("__rn"))))
    odd = (F.col("__rn") - F.coalesce("__miss", F.lit(0))) % 2 == 1
    return d.filter(F.col("__fit") & odd).select(*keys, F.col(order).alias("first"), "second")


def group_boundary(df, groups: DataFrame, keys, group, x, score, dy, zone, first_zone: Column, min_score=0.70) -> DataFrame:
    """Left boundary per group: leftmost good x beyond the zone, minus dy, at least 4 dy.

    ``zone`` is the page's default boundary; groups other than those in ``first_zone`` use
    a zone of 80 %. Groups without such a row get the default.
    """
    lo = F.when(first_zone, _c(zone)).otherwise(F.floor(_c(zone) * 0.80))
    good = df.join(groups.select(*keys, group, lo.alias("__lo")), [*keys, group]).filter(
        (F.coalesce(_c(score), F.lit(1.0)) >= min_score) & (F.col(x) > F.floor(_c(dy) * 4)) & (F.col(x) >= F.col("__lo")))
    m = good.groupBy(*keys, group).agg(F.min(x).alias("__x"))
    out = groups.join(m, [*keys, group], "left")
    bound = F.coalesce(F.greatest(F.floor(_c(dy) * 4), F.col("__x") - F.floor(_c(dy))), _c(zone))
    return out.withColumn("boundary", bound).drop("__x")
