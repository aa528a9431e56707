"""Check queries: sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sequences as Q
from .registry import EV, LI, LN, ev, lines, query, table

W = "OVER (PARTITION BY k ORDER BY x, id)"


@query("gap_cluster", f"""WITH {EV}, f AS (SELECT *, CASE WHEN x - lag(x) {W} < 6 THEN 0 ELSE 1 END AS fresh FROM ev),
 c AS (SELECT *, sum(fresh) {W} AS c FROM f) SELECT k, CAST(c AS BIGINT) AS cluster, count(*) AS n, CAST(floor(avg(x)) AS BIGINT) AS centre FROM c GROUP BY k, c""")
def gap_cluster(spark, sf):
    return Q.cluster_centres(ev(spark, sf), ["k"], "x", "id", 6.0)


_HOURS = f"""{EV}, h AS (SELECT k % 5 AS page, CAST(floor(x) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY 1, 2),
 m AS (SELECT *, max(n) OVER (PARTITION BY page) AS mx FROM h), t AS (SELECT page, hour FROM m WHERE n > 0.3 * mx)"""


def _hours(spark, sf):
    h = ev(spark, sf).groupBy((F.col("k") % 5).alias("page"), F.floor("x").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return A.max_relative(h, ["page"], "n", 0.3, ["hour"])


@query("threshold_runs", f"""WITH {_HOURS}, g AS (SELECT page, hour, hour - row_number() OVER (PARTITION BY page ORDER BY hour) AS r FROM t)
 SELECT page, min(hour) AS start, max(hour) + 1 AS "end", max(hour) + 1 - min(hour) AS width FROM g GROUP BY page, r HAVING max(hour) + 1 - min(hour) >= 2""")
def threshold_runs(spark, sf):
    return Q.threshold_runs(_hours(spark, sf), ["page"], "hour", F.lit(True), min_width=2)


@query("threshold_runs_merged", f"""WITH {_HOURS}, g AS (SELECT page, hour, CASE WHEN hour - lag(hour) OVER (PARTITION BY page ORDER BY hour) - 1 <= 2 THEN 0 ELSE 1 END AS f FROM t),
 r AS (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY hour) AS r FROM g)
 SELECT page, min(hour) AS start, max(hour) + 1 AS "end", max(hour) + 1 - min(hour) AS width FROM r GROUP BY page, r HAVING max(hour) + 1 - min(hour) BETWEEN 2 AND 40""")
def threshold_runs_merged(spark, sf):
    return Q.threshold_runs(_hours(spark, sf), ["page"], "hour", F.lit(True), min_width=2, max_width=40, max_gap=2)


_SPLIT = f"""{EV}, g AS (SELECT *, x - lag(x) {W} AS gap FROM ev), m AS (SELECT k, median(gap) AS med FROM g GROUP BY k),
 r AS (SELECT g.*, CAST(sum(CASE WHEN gap > med * 3.0 THEN 1 ELSE 0 END) OVER (PARTITION BY g.k ORDER BY x, id) AS BIGINT) AS run FROM g JOIN m ON g.k = m.k)"""


@query("median_split", f"WITH {_SPLIT} SELECT id, k, run FROM r")
def median_split(spark, sf):
    return Q.median_split(ev(spark, sf), ["k"], "x", "id").select("id", "k", "run")


@query("best_window5", f"""WITH {_SPLIT}, l AS (SELECT k, run, x AS x1, lead(x, 1) OVER q AS x2, lead(x, 2) OVER q AS x3, lead(x, 3) OVER q AS x4, lead(x, 4) OVER q AS x5
 FROM r WINDOW q AS (PARTITION BY k, run ORDER BY x)), s AS (SELECT *, (greatest(x2-x1, x3-x2, x4-x3, x5-x4) - least(x2-x1, x3-x2, x4-x3, x5-x4)) / (((x2-x1) + (x3-x2) + (x4-x3) + (x5-x4)) / 4.0) AS spread
 FROM l WHERE x5 IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY spread, x1) AS rn FROM s WHERE spread < 0.8)
 SELECT k, run, x1, x5, round(spread, 6) AS spread FROM b WHERE rn = 1""")
def best_window5(spark, sf):
    r = Q.median_split(ev(spark, sf), ["k"], "x", "id")
    return Q.best_window5(r, ["k", "run"], "x").select("k", "run", "x1", "x5", F.round("spread", 6).alias("spread"))


# segments between purchases, with the closing purchase as the right boundary
SEGS = f"""{EV}, b AS (SELECT k, x AS bx FROM ev WHERE typ = 'purchase'),
 s AS (SELECT e.*, (SELECT count(*) FROM b WHERE b.k = e.k AND bx <= e.x) AS m, (SELECT min(bx) FROM b WHERE b.k = e.k AND bx > e.x) AS edge
 FROM ev e WHERE typ <> 'purchase')"""
WM = "OVER (PARTITION BY k, m ORDER BY x, id)"


def segments(spark, sf, *types):
    rows = ev(spark, sf, *types) if types else ev(spark, sf).filter("typ <> 'purchase'")
    p = ev(spark, sf, "purchase")
    s = J.segment_by_boundary(rows, p, ["k"], "x", "x", "id", "m")
    return J.neighbours(s, p, ["k"], "x", "x", "id").withColumn("edge", F.col("__next.at")).drop("__prev", "__next")


@query("gap_with_boundary", f"""WITH {SEGS} SELECT id, k, m, coalesce(lead(x) {WM} - x, edge - x, x - lag(x) {WM}, 0) AS gap FROM s""")
def gap_with_boundary(spark, sf):
    return Q.gap_with_boundary(segments(spark, sf), ["k", "m"], "x", "id", "edge").select("id", "k", "m", "gap")


@query("gap_or_zero", f"""WITH {SEGS} SELECT id, k, m, coalesce(lead(x) {WM} - x, edge - x, 0) AS gap FROM s""")
def gap_or_zero(spark, sf):
    return Q.gap_with_boundary(segments(spark, sf), ["k", "m"], "x", "id", "edge", last="zero").select("id", "k", "m", "gap")


@query("gap_near_median", f"""WITH {SEGS}, g AS (SELECT *, lead(x) {WM} - x AS g, x - lag(x) {WM} AS pg FROM s),
 q AS (SELECT k, m, list_sort(list(g) FILTER (g IS NOT NULL)) AS gs FROM g GROUP BY k, m), md AS (SELECT k, m, gs[len(gs) // 2 + 1] AS med, len(gs) AS n FROM q)
 SELECT id, g.k AS k, g.m AS m, CASE WHEN g IS NOT NULL THEN g WHEN n >= 2 AND med > 0 AND edge - x BETWEEN med * 0.3 AND med * 3.0 THEN edge - x ELSE coalesce(pg, 0) END AS gap
 FROM g JOIN md ON g.k = md.k AND g.m = md.m""")
def gap_near_median(spark, sf):
    return Q.gap_with_boundary(segments(spark, sf), ["k", "m"], "x", "id", "edge", last="near_median").select("id", "k", "m", "gap")


def _passes(n):
    out = []
    for i in range(1, n + 1):
        out.append(f"""p{i} AS (SELECT * REPLACE (b OR (fit AND coalesce(bool_or(b) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false)
 AND coalesce(bool_or(b) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false)) AS b) FROM p{i - 1})""")
    return ", ".join(out)


@query("fixpoint_promote", f"""WITH {EV}, g AS (SELECT *, x - lag(x) {W} AS l, lead(x) {W} - x AS r FROM ev),
 p0 AS (SELECT id, k, x, id % 3 = 0 AS b, coalesce(id % 3 = 1 AND l > 0 AND r > 0 AND greatest(l, r) / least(l, r) < 1.3, false) AS fit FROM g), {_passes(8)}
 SELECT id, k, b AND id % 3 <> 0 AS promoted, CASE WHEN b AND id % 3 <> 0 THEN 0.5::DOUBLE ELSE 1.0 END AS duration FROM p8""")
def fixpoint_promote(spark, sf):
    i = F.col("id") % 3
    d = ev(spark, sf).withColumns({"beams": F.when(i == 0, 1).otherwise(0), "flag": i == 2, "duration": F.lit(1.0)})
    return Q.fixpoint_promote(d, ["k"], "x", "id").select("id", "k", "promoted", "duration")


@query("pattern_rewrite", f"""WITH {EV}, a AS (SELECT id, k, x, id % 4 AS b, id % 3 <> 0 AS dot, (1 + id % 6) / 4.0::DOUBLE AS d FROM ev),
 n AS (SELECT *, lead(x) {W} AS x1, lead(x, 2) {W} AS x2, lead(b) {W} AS b1, lead(b, 2) {W} AS b2, lag(b) {W} AS bp,
 max(d) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) > 1.0 AS lng FROM a),
 r AS (SELECT *, CASE WHEN NOT dot OR x1 IS NULL THEN 'none' WHEN b >= 1 AND b1 >= 2 AND x1 - x < 25 THEN 'pair'
 WHEN b >= 1 AND b1 = 1 AND x2 - x1 > 0 AND (x1 - x) / (x2 - x1) > 1.5 AND bp <> b THEN 'extended'
 WHEN b = b1 AND b >= 1 AND coalesce(b2 = b, false) AND (coalesce(bp = b, false) OR lng) THEN 'undot' ELSE 'none' END AS rule FROM n)
 SELECT id, k, rule, round(CASE WHEN rule IN ('pair', 'extended') THEN 0.75 WHEN rule = 'undot' THEN d / 1.5 ELSE d END, 6) AS duration, dot AND rule <> 'undot' AS dot FROM r""")
def pattern_rewrite(spark, sf):
    i = F.col("id")
    d = ev(spark, sf).withColumns({"beams": i % 4, "dot": i % 3 != 0, "duration": (1 + i % 6) / 4.0})
    out = Q.pattern_rewrite(d, ["k"], "x", "id", F.lit(5.0))
    return out.select("id", "k", "rule", F.round("duration", 6).alias("duration"), "dot")


@query("spacing_filter", f"""WITH {EV}, n AS (SELECT *, x - lag(x) {W} AS l, lead(x) {W} - x AS r, lag(y) {W} AS ps, lead(y) {W} AS ns FROM ev),
 q AS (SELECT k, list_sort(list(r) FILTER (r IS NOT NULL)) AS gs FROM n GROUP BY k), m AS (SELECT k, gs[len(gs) // 2 + 1] AS med FROM q)
 SELECT id, n.k AS k FROM n JOIN m ON n.k = m.k WHERE NOT coalesce(l < med * 0.6 AND r < med * 0.6 AND abs(l + r - med) < abs(l - med) AND y < least(ps, ns) * 0.7, false)""")
def spacing_filter(spark, sf):
    return Q.spacing_filter(ev(spark, sf), ["k"], "x", "id", "y").select("id", "k")


@query("running_start", f"""WITH {EV} SELECT id, k, round(coalesce(sum(y) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start FROM ev""")
def running_start(spark, sf):
    return Q.running_start(ev(spark, sf), ["k"], ["x", "id"], "y").select("id", "k", F.round("start", 4).alias("start"))


@query("carry_last", f"""WITH {EV} SELECT id, k, coalesce(last_value(CASE WHEN typ = 'purchase' THEN y END IGNORE NULLS) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2.0) AS bpm FROM ev""")
def carry_last(spark, sf):
    v = F.when(F.col("typ") == "purchase", F.col("y"))
    return Q.carry_last(ev(spark, sf), ["k"], ["x", "id"], v, 2.0, "bpm").select("id", "k", "bpm")


@query("carry_first", f"""WITH {EV} SELECT id, k, first_value(CASE WHEN typ = 'purchase' AND y < 60 THEN y END IGNORE NULLS) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS override FROM ev""")
def carry_first(spark, sf):
    v = F.when(F.col("typ") == "purchase", F.col("y"))
    return Q.carry_first(ev(spark, sf), ["k"], ["x", "id"], v, F.col("y") < 60, "override").select("id", "k", "override")


@query("renumber_global", f"""WITH {LN} SELECT source, d, n, row_number() OVER (PARTITION BY source ORDER BY d, n) AS line_no FROM ln JOIN documents ON d = doc_id""")
def renumber_global(spark, sf):
    src = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return Q.renumber_global(src, ["source"], ["d", "n"]).select("source", "d", F.col("n").cast("long").alias("n"), "line_no")


@query("gap_expiring_fill", f"""WITH RECURSIVE {EV}, a AS (SELECT id, k, typ, x, CASE WHEN id % 5 = 0 THEN '#' WHEN id % 11 = 0 THEN 'n' ELSE '' END AS s,
 CASE WHEN typ = 'view' THEN 'b' ELSE '' END AS ks, row_number() OVER (PARTITION BY k, typ ORDER BY x, id) AS rn FROM ev),
 r AS (SELECT id, k, typ, rn, CASE WHEN s = 'n' THEN '' WHEN s <> '' THEN s ELSE ks END AS shown, nullif(s, '') AS acc, CASE WHEN s <> '' THEN x END AS ax FROM a WHERE rn = 1
 UNION ALL SELECT a.id, a.k, a.typ, a.rn,
 CASE WHEN s = 'n' THEN '' WHEN s <> '' THEN s WHEN acc IS NOT NULL AND a.x - ax <= 70 THEN CASE WHEN acc = 'n' THEN '' ELSE acc END ELSE ks END,
 coalesce(nullif(s, ''), acc), CASE WHEN s <> '' OR (acc IS NOT NULL AND a.x - ax <= 70) THEN a.x ELSE ax END
 FROM r JOIN a ON a.k = r.k AND a.typ = r.typ AND a.rn = r.rn + 1)
 SELECT id, k, typ, shown FROM r""")
def gap_expiring_fill(spark, sf):
    i = F.col("id")
    d = ev(spark, sf).withColumn("s", F.when(i % 5 == 0, "#").when(i % 11 == 0, "n").otherwise(""))
    ks = F.when(F.col("typ") == "view", "b")
    return Q.gap_expiring_fill(d, ["k", "typ"], "x", "id", "s", ks, F.lit(70.0)).select("id", "k", "typ", "shown")


@query("trim_empty", f"""WITH {EV}, d AS (SELECT k, CAST(floor(x / 24) AS BIGINT) AS day, count(*) FILTER (typ = 'error') AS n FROM ev GROUP BY 1, 2),
 r AS (SELECT k, min(day) FILTER (n > 0) AS a, max(day) FILTER (n > 0) AS b FROM d GROUP BY k) SELECT d.k AS k, day, n FROM d JOIN r ON r.k = d.k WHERE day BETWEEN a AND b""")
def trim_empty(spark, sf):
    d = ev(spark, sf).groupBy("k", F.floor(F.col("x") / 24).alias("day")).agg(F.count_if(F.col("typ") == "error").alias("n"))
    return Q.trim_empty(d, ["k"], ["day"], F.col("n") > 0)


@query("tail_merge", f"""WITH RECURSIVE {SEGS}, c AS (SELECT k, count(*) AS last FROM b GROUP BY k), e AS (SELECT id, s.k AS k, x, typ, m, last, list_sort([y, y + id % 2]) AS ys FROM s JOIN c ON c.k = s.k),
 o AS (SELECT * FROM e WHERE m = last - 1 AND typ <> 'error'), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn FROM e WHERE m = last AND typ <> 'error'),
 g AS (SELECT k, 0::BIGINT AS rn, []::STRUCT(id BIGINT, x DOUBLE, ys DOUBLE[])[] AS kept FROM c
 UNION ALL SELECT g.k, t.rn, CASE WHEN len(list_filter(kept, lambda q: t.x - q.x <= 100 AND abs(q.ys[1] - t.ys[1]) <= 5.0 AND abs(q.ys[2] - t.ys[2]) <= 5.0)) > 0
 OR EXISTS (SELECT 1 FROM o WHERE o.k = t.k AND abs(o.x - t.x) <= 100 AND abs(o.ys[1] - t.ys[1]) <= 5.0 AND abs(o.ys[2] - t.ys[2]) <= 5.0)
 THEN kept ELSE list_append(kept, struct_pack(id := t.id, x := t.x, ys := t.ys)) END FROM g JOIN t ON t.k = g.k AND t.rn = g.rn + 1)
 SELECT k, id, m FROM e WHERE m < last UNION ALL SELECT e.k, e.id, e.m - 1 FROM e JOIN (SELECT k, unnest(arg_max(kept, rn)) AS q FROM g GROUP BY k) z ON e.k = z.k AND e.id = z.q.id""")
def tail_merge(spark, sf):
    p = ev(spark, sf, "purchase")
    s = segments(spark, sf).join(p.groupBy("k").agg(F.count(F.lit(1)).alias("last")), "k")
    s = s.withColumn("ys", F.array(F.col("y"), F.col("y") + F.col("id") % 2))
    return Q.tail_merge(s, ["k"], "m", "last", "x", "id", 20.0, F.col("typ") == "error", "ys").select("k", "id", "m")


@query("wide_gap_split", f"""WITH {EV}, b AS (SELECT k, x, lead(x) {W} AS nx FROM ev WHERE typ = 'purchase'),
 q AS (SELECT k, list_sort(list(nx - x) FILTER (nx IS NOT NULL)) AS gs FROM b GROUP BY k), md AS (SELECT k, gs[len(gs) // 2 + 1] AS med FROM q),
 c AS (SELECT b.k AS k, b.x AS left_x, v.id AS id, v.x AS x, abs(v.x - b.x - med) + abs(b.nx - v.x - med) AS fit FROM b JOIN md ON md.k = b.k JOIN ev v ON v.k = b.k AND v.typ = 'view' AND v.x >= b.x AND v.x < b.nx
 WHERE med >= 5 AND (v.x - b.x) + (b.nx - v.x) > med * 1.8 AND v.x - b.x > med * 0.5 AND v.x - b.x < med * 2.0 AND b.nx - v.x > med * 0.5 AND b.nx - v.x < med * 2.0)
 SELECT k, left_x, id, x FROM (SELECT *, row_number() OVER (PARTITION BY k, left_x ORDER BY fit, x, id) AS rn FROM c) WHERE rn = 1""")
def wide_gap_split(spark, sf):
    from ..core import scan as S

    p = ev(spark, sf, "purchase")
    g = S.scan(p, ["k"], ["x", "id"], nx=S.lead("x")).withColumn("g", F.col("nx") - F.col("x"))
    ref = A.group_median(g, ["k"], "g", "id", upper=True)
    return Q.wide_gap_split(p.select("k", "x"), ev(spark, sf, "view"), ref, ["k"], "x", "x", "id", 5.0)


@query("line_pack", f"""WITH RECURSIVE {LN}, r AS (SELECT d, 0::BIGINT AS n, 1::BIGINT AS ln, length(line) AS used FROM ln WHERE n = 0
 UNION ALL SELECT r.d, ln.n, CASE WHEN used + 3 + length(line) > 400 THEN r.ln + 1 ELSE r.ln END, CASE WHEN used + 3 + length(line) > 400 THEN length(line) ELSE used + 3 + length(line) END
 FROM r JOIN ln ON ln.d = r.d AND ln.n = r.n + 1) SELECT d, n, ln AS line FROM r""")
def line_pack(spark, sf):
    l = lines(spark, sf).select("d", F.col("n").cast("long").alias("n"), F.length("line").cast("long").alias("w"))
    return Q.line_pack(l, ["d"], ["n"], "n", "w", 400, 3)
