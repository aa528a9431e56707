"""Group aggregates. All combine on the map side; medians come from ranks, and ordered text of groups without a
bound are rows, so no task holds such a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import scan as S
from ..core.skew import probe_once
from ..functions import scalar as N

LOW_CONFIDENCE = 0.75


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean_unit(df, keys, top, bottom, name="dy") -> DataFrame:
    """Mean line spacing of a page: the mean quarter of staff heights."""
    return df.groupBy(*keys).agg(F.avg((_c(bottom) - _c(top)) / 4.0).alias(name))


def row_profile(runs, keys, y="y") -> DataFrame:
    """Ink per row from runs [x0, x1)."""
    return runs.groupBy(*keys, y).agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))


def column_profile(runs, keys) -> DataFrame:
    """Depth of runs over x as steps [x, x_end): +1 where runs start, -1 where they end."""
    ends = runs.select(*keys, F.explode(F.array(
        F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    out = S.scan(steps, keys, ["x"], depth=S.run_sum("d"), x_end=S.lead("x"))
    return out.filter(F.col("x_end").isNotNull() & (F.col("depth") > 0)).drop("d")


def max_relative(df, keys, value, ratio, order) -> DataFrame:
    """Keep rows above a fraction of their group's maximum."""
    out = S.scan(df, keys, order, __max=S.total("max", value))
    return out.filter(_c(value) > F.col("__max") * ratio).drop("__max")


def group_range(df, keys, x) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def mode_first_seen(df, keys, value, order, name="mode") -> DataFrame:
    """Most frequent value of each group; the one seen first wins ties."""
    counts = df.groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__first"))
    return counts.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), F.col("__first"))).alias(name))


@probe_once
def group_median(df, keys, value, tie, upper: bool, name="median") -> DataFrame:
    """Median per group of the non-null values: the mean of the middle two, or with
    ``upper`` the element at n // 2 of the sorted values. From ranks: no group's values are gathered."""
    d = df.filter(_c(value).isNotNull()).select(*keys, _c(value).cast("double").alias("__v"), F.col(tie).alias("__tie"))
    r = S.scan(d, keys, ["__v", "__tie"], __r=S.row_number(), __n=S.total("count", F.lit(1)))
    high = F.floor(F.col("__n") / 2) + 1
    low = high if upper else F.floor((F.col("__n") + 1) / 2)
    return r.filter(F.col("__r").between(low, high)).groupBy(*keys).agg(F.avg("__v").alias(name))


@probe_once
def with_median(df, keys, value, tie, upper: bool, name="median") -> DataFrame:
    """The group median on every row, from ranks: the input is read once and not joined."""
    v = _c(value)
    d = df.withColumns({"__md_null": v.isNull(), "__md_v": v.cast("double")})
    d = S.scan(d, keys, ["__md_null", "__md_v", tie], __md_r=S.row_number(), __md_n=S.total("count", "__md_v"))
    high = F.floor(F.col("__md_n") / 2) + 1
    low = high if upper else F.floor((F.col("__md_n") + 1) / 2)
    mid = F.when(~F.col("__md_null") & F.col("__md_r").between(low, high), F.col("__md_v"))
    return S.scan(d, keys, ["__md_null", "__md_v", tie], **{name: S.total("avg", mid)}).drop("__md_null", "__md_v", "__md_r", "__md_n")


def weakest_member(df, keys, conf, spread=0.15) -> DataFrame:
    lo, hi = F.min(conf), F.max(conf)
    return df.groupBy(*keys).agg(lo.alias("conf"), ((F.count(conf) >= 2) & (hi - lo > spread)).alias("spread_flag"))


def ordered_lines(df, keys, order, text, name="text") -> DataFrame:
    """Texts of a group as rows (keys, position, text): an ordered set of lines for groups of any size."""
    return S.scan(df, keys, order, position=S.row_number()).select(*keys, "position", _c(text).alias(name))


def _in_order(order, text) -> Column:
    """Array of a group's texts in order."""
    items = F.sort_array(F.collect_list(F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(order)], _c(text).alias("t"))))
    return F.transform(items, lambda i: i["t"])


def ordered_concat(df, keys, order, text, sep=" ", name="text") -> DataFrame:
    """Texts joined in order, one row per group, for groups that their key keeps small (a chord, a
    measure, a user's path). Groups without such a bound are rows: ``ordered_lines``."""
    return df.groupBy(*keys).agg(F.array_join(_in_order(order, text), sep).alias(name))


def chord_text(df, keys, order, text, duration, name="text") -> DataFrame:
    """A single note as it is, several in brackets, then the duration suffix."""
    g = df.groupBy(*keys).agg(F.array_join(_in_order(order, text), " ").alias("__t"), F.count(F.lit(1)).alias("__n"), F.first(_c(duration)).alias("__d"))
    many = F.col("__n") > 1
    return g.select(*keys, F.concat(F.when(many, "[").otherwise(""), "__t", F.when(many, "]").otherwise(""), N.duration_suffix("__d")).alias(name))


def count_by_type(df, keys, typ, values: list[str]) -> DataFrame:
    """One count column per given type."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(typ) == v).alias(f"n_{v}") for v in values])


def reference_group(stats, keys, group, count, stat, name="ref") -> DataFrame:
    """The statistic of the group with most members; the first group wins ties."""
    return stats.groupBy(*keys).agg(F.max_by(stat, F.struct(F.col(count), -F.col(group))).alias(name))


def rollup_totals(df, sections: list[str], hits, totals, name_hits="hits", name_totals="total") -> DataFrame:
    """Hits and totals per section and overall, with the rounded percentage (null without totals)."""
    out = df.rollup(*sections).agg(F.sum(hits).alias(name_hits), F.sum(totals).alias(name_totals))
    pct = F.when(F.col(name_totals) > 0, F.round(F.col(name_hits) / F.col(name_totals) * 100))
    return out.withColumn("pct", pct)


def class_vote(df, keys, cls, score, first: str, second: str, cap=7) -> DataFrame:
    """Winner of two classes: more rows, then the higher mean score, then ``first``.

    Null (no row) when the winner's mean score is too low: 0.65 for one row, else 0.55.
    """
    one, two = F.col(cls) == first, F.col(cls) == second
    a = df.groupBy(*keys).agg(
        F.count_if(one).alias("n1"), F.count_if(two).alias("n2"),
        F.coalesce(F.avg(F.when(one, F.col(score))), F.lit(0.0)).alias("m1"),
        F.coalesce(F.avg(F.when(two, F.col(score))), F.lit(0.0)).alias("m2"))
    a = a.filter((F.col("n1") > 0) | (F.col("n2") > 0))
    wins = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("m1") >= F.col("m2")))
    a = a.select(*keys, F.when(wins, first).otherwise(second).alias("winner"),
                 F.least(F.when(wins, F.col("n1")).otherwise(F.col("n2")), F.lit(cap)).alias("n"),
                 F.when(wins, F.col("m1")).otherwise(F.col("m2")).alias("mean"))
    return a.filter(F.col("mean") >= F.when(F.col("n") == 1, 0.65).otherwise(0.55))


def densest_window(df, keys, x, width, span) -> DataFrame:
    """In groups spread over more than ``span``, keep the window [x0, x0 + width] with most
    rows (the leftmost on ties); other groups stay whole."""
    places = df.groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    marks = places.select(*keys, F.explode(F.array(
        F.struct(F.col("__x").alias("at"), F.lit(0).alias("side"), F.col("__x").alias("start"), F.col("__n").alias("n")),
        F.struct((F.col("__x") + width).alias("at"), F.lit(1).alias("side"), F.col("__x").alias("start"), F.lit(0).cast("long").alias("n")),
    )).alias("m")).select(*keys, "m.*")
    cum = S.scan(marks, keys, ["at", "side", "start"], cum=S.run_sum("n"))
    # rows up to the window's end minus rows before its start
    per = cum.groupBy(*keys, "start").agg(
        F.sum(F.when(F.col("side") == 1, F.col("cum")).otherwise(F.col("n") - F.col("cum"))).alias("inside"))
    best = per.groupBy(*keys).agg(
        F.max_by("start", F.struct(F.col("inside"), -F.col("start"))).alias("__start"),
        (F.max("start") - F.min("start")).alias("__span"))
    wide = F.col("__span") > span
    return df.join(best, keys).filter(~wide | F.col(x).between(F.col("__start"), F.col("__start") + width)).drop("__start", "__span")


def budget_check(df, keys, duration, capacity, tolerance=0.1, penalty=0.70) -> DataFrame:
    """Total duration against the group's capacity; a miss gives the penalty multiplier."""
    a = df.groupBy(*keys).agg(F.sum(F.coalesce(_c(duration), F.lit(1.0))).alias("beats"), F.first(_c(capacity)).alias("capacity"))
    off = F.abs(F.col("beats") - F.col("capacity")) > tolerance
    return a.withColumns({"mul": F.when(off, penalty).otherwise(1.0), "off": off})


def page_flag(df, stats, keys, count, least, name="flag") -> DataFrame:
    """Mark every row of a page whose statistic reaches ``least``."""
    s = stats.select(*keys, (F.col(count) >= least).alias(name))
    return df.join(s, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
