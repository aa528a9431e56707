"""Check queries: aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sequences as Q
from .registry import EV, LI, ev, query, table

GAPS = f"""{EV}, g AS (SELECT id, k, x, typ, y, x - lag(x) OVER (PARTITION BY k ORDER BY x, id) AS gap FROM ev)"""


def gaps(spark, sf):
    from ..core import scan as S

    d = S.scan(ev(spark, sf), ["k"], ["x", "id"], p=S.lag("x"))
    return d.withColumn("gap", F.col("x") - F.col("p")).drop("p")


@query("mean_unit", "SELECT l_suppkey, round(avg((l_extendedprice - l_quantity) / 4.0), 4) AS dy FROM lineitem GROUP BY 1")
def mean_unit(spark, sf):
    return A.mean_unit(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("dy", F.round("dy", 4))


RUNS_SQL = f"""{EV}, r AS (SELECT k, CAST(floor(x) AS BIGINT) AS y, CAST(floor(y) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) + 1 + id % 7 AS x1 FROM ev)"""


def ink_runs(spark, sf):
    x0 = F.floor("y")
    return ev(spark, sf).select("k", F.floor("x").alias("yy"), x0.alias("x0"), (x0 + 1 + F.col("id") % 7).alias("x1")).withColumnRenamed("yy", "y")


@query("projection_profile", f"WITH {RUNS_SQL} SELECT k, y, CAST(sum(x1 - x0) AS BIGINT) AS ink FROM r GROUP BY k, y")
def projection_profile(spark, sf):
    return A.row_profile(ink_runs(spark, sf), ["k"])


@query("column_profile", f"""WITH {RUNS_SQL} SELECT k, x, count(*) AS depth FROM (SELECT k, unnest(range(x0, x1)) AS x FROM r) GROUP BY k, x""")
def column_profile(spark, sf):
    steps = A.column_profile(ink_runs(spark, sf), ["k"])
    return steps.select("k", F.explode(F.sequence("x", F.col("x_end") - 1)).alias("x"), F.col("depth").cast("long").alias("depth"))


@query("max_relative", f"WITH {EV} SELECT id, k, y FROM (SELECT *, max(y) OVER (PARTITION BY k) AS m FROM ev) WHERE y > m * 0.3")
def max_relative(spark, sf):
    return A.max_relative(ev(spark, sf), ["k"], "y", 0.3, ["x", "id"]).select("id", "k", "y")


@query("group_range", f"WITH {EV} SELECT k, typ, min(x) AS lo, max(x) AS hi FROM ev GROUP BY k, typ")
def group_range(spark, sf):
    return A.group_range(ev(spark, sf), ["k", "typ"], "x")


@query("mode_first_seen", f"""WITH {EV}, c AS (SELECT k, typ, count(*) AS n, min((x, id)) AS f FROM ev GROUP BY k, typ)
 SELECT k, typ AS mode FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def mode_first_seen(spark, sf):
    return A.mode_first_seen(ev(spark, sf), ["k"], "typ", ["x", "id"])


@query("upper_median", f"""WITH {EV}, s AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY y, id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ev)
 SELECT k, y AS median FROM s WHERE i = n // 2""")
def upper_median(spark, sf):
    return A.group_median(ev(spark, sf), ["k"], "y", "id", upper=True)


@query("true_median", f"WITH {EV} SELECT k, median(y) AS median FROM ev GROUP BY k")
def true_median(spark, sf):
    return A.group_median(ev(spark, sf), ["k"], "y", "id", upper=False)


@query("weakest_member", """SELECT l_orderkey, min(l_discount) AS conf, count(*) >= 2 AND max(l_discount) - min(l_discount) > 0.055 AS spread_flag
 FROM lineitem GROUP BY 1""")
def weakest_member(spark, sf):
    return A.weakest_member(table(spark, sf, "lineitem"), ["l_orderkey"], "l_discount", 0.055)


@query("ordered_concat", f"WITH {EV} SELECT k, string_agg(typ, '>' ORDER BY x, id) AS path FROM ev GROUP BY k")
def ordered_concat(spark, sf):
    return A.ordered_concat(ev(spark, sf), ["k"], ["x", "id"], "typ", ">", name="path")


@query("count_by_type", f"""WITH {EV} SELECT k, count(*) FILTER (typ = 'view') AS n_view, count(*) FILTER (typ = 'click') AS n_click,
 count(*) FILTER (typ = 'error') AS n_error FROM ev GROUP BY k""")
def count_by_type(spark, sf):
    return A.count_by_type(ev(spark, sf), ["k"], "typ", ["view", "click", "error"])


@query("reference_group", f"""WITH {EV}, g AS (SELECT k % 10 AS page, k, x - lag(x) OVER (PARTITION BY k ORDER BY x, id) AS gap FROM ev WHERE typ = 'purchase'),
 s AS (SELECT page, k, count(*) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gs FROM g GROUP BY page, k),
 r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, k) AS rn FROM s)
 SELECT page, gs[len(gs) // 2 + 1] AS ref FROM r WHERE rn = 1""")
def reference_group(spark, sf):
    from ..core import scan as S

    p = S.scan(ev(spark, sf, "purchase"), ["k"], ["x", "id"], p=S.lag("x")).withColumn("gap", F.col("x") - F.col("p"))
    n = p.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    stats = n.join(A.group_median(p, ["k"], "gap", "id", upper=True), "k", "left").withColumn("page", F.col("k") % 10)
    return A.reference_group(stats, ["page"], "k", "n", "median")


@query("rollup_totals", """SELECT o_orderstatus, o_orderpriority, CAST(count(*) FILTER (o_totalprice > 200000) AS BIGINT) AS hits, count(*) AS total,
 round(count(*) FILTER (o_totalprice > 200000)::DOUBLE / count(*) * 100) AS pct FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_totals(spark, sf):
    o = table(spark, sf, "orders").withColumns({"hit": (F.col("o_totalprice") > 200000).cast("long"), "one": F.lit(1).cast("long")})
    return A.rollup_totals(o, ["o_orderstatus", "o_orderpriority"], "hit", "one")


@query("class_vote", f"""WITH {EV}, a AS (SELECT k, count(*) FILTER (typ = 'click') AS n1, count(*) FILTER (typ = 'view') AS n2,
 coalesce(avg(y / 80) FILTER (typ = 'click'), 0) AS m1, coalesce(avg(y / 80) FILTER (typ = 'view'), 0) AS m2 FROM ev WHERE typ IN ('click', 'view') GROUP BY k),
 w AS (SELECT k, n1 > n2 OR (n1 = n2 AND m1 >= m2) AS f, * FROM a),
 v AS (SELECT k, CASE WHEN f THEN 'click' ELSE 'view' END AS winner, least(CASE WHEN f THEN n1 ELSE n2 END, 7) AS n, CASE WHEN f THEN m1 ELSE m2 END AS mean FROM w)
 SELECT k, winner, n, round(mean, 4) AS mean FROM v WHERE mean >= CASE WHEN n = 1 THEN 0.65 ELSE 0.55 END""")
def class_vote(spark, sf):
    d = ev(spark, sf, "click", "view").withColumn("s", F.col("y") / 80)
    return A.class_vote(d, ["k"], "typ", "s", "click", "view").withColumn("mean", F.round("mean", 4))


@query("densest_window", f"""WITH {EV}, c AS (SELECT a.k AS k, a.x AS s, count(*) AS n FROM (SELECT DISTINCT k, x FROM ev) a JOIN ev b ON a.k = b.k AND b.x BETWEEN a.x AND a.x + 50.0 GROUP BY 1, 2),
 b AS (SELECT k, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS rn FROM c) WHERE rn = 1),
 p AS (SELECT k, max(x) - min(x) AS span FROM ev GROUP BY k)
 SELECT id, ev.k AS k FROM ev JOIN b ON b.k = ev.k JOIN p ON p.k = ev.k WHERE span <= 60 OR x BETWEEN s AND s + 50.0""")
def densest_window(spark, sf):
    return A.densest_window(ev(spark, sf), ["k"], "x", 50.0, 60.0).select("id", "k")


@query("budget_check", """SELECT l_orderkey, round(sum(l_extendedprice), 2) AS beats, any_value(o_totalprice) AS capacity,
 abs(sum(l_extendedprice) - any_value(o_totalprice)) > 50000 AS off, CASE WHEN abs(sum(l_extendedprice) - any_value(o_totalprice)) > 50000 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS mul
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def budget_check(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.budget_check(d, ["l_orderkey"], "l_extendedprice", "o_totalprice", 50000.0).withColumn("beats", F.round("beats", 2))


@query("page_flag", f"""WITH {EV}, p AS (SELECT a.k AS k, count(*) AS n FROM ev a JOIN ev b ON a.k = b.k AND a.id < b.id
 AND abs(a.x - b.x) < 2.0 AND abs(a.y - b.y) > 10 AND abs(a.y - b.y) < 25 GROUP BY a.k)
 SELECT id, ev.k AS k, coalesce(n >= 3, false) AS stacked FROM ev LEFT JOIN p ON p.k = ev.k""")
def page_flag(spark, sf):
    e = ev(spark, sf)
    pairs = J.stacked_pairs(e, ["k"], "x", "y", 2.0, 10.0, 25.0)
    return A.page_flag(e, pairs, ["k"], "n_pairs", 3, "stacked").select("id", "k", "stacked")
