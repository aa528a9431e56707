"""Check queries: ink runs. Pages are suppliers; a row is a part number's residue, a run a stretch of twelve-day weeks from the
shipping date on, as long as the quantity's residue. Boxes are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from .registry import EV, ev, query, table

_ROWS, _PAGES = 40, 10
_INK = f"""ink AS (SELECT l_suppkey AS k, l_partkey % {_ROWS} AS y, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 12 AS x0,
 date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 12 + CAST(l_quantity AS BIGINT) % 7 AS x1 FROM lineitem),
px AS MATERIALIZED (SELECT DISTINCT k, y, unnest(range(x0, x1)) AS x FROM ink)"""
_BOXES = f"""bx AS (SELECT o_custkey % {_PAGES} + 1 AS k, o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 12 AS x, o_orderkey % {_ROWS} AS y,
 2 + o_orderkey % 5 AS w, 1 + o_custkey % 4 AS h FROM orders)"""


def _runs_of(src: str, line: str, at: str, names: str) -> str:
    """SQL of the maximal runs of pixels ``at`` in a ``line``."""
    return f"""SELECT k, {line} AS {names.split()[0]}, min({at}) AS {names.split()[1]}, max({at}) + 1 AS {names.split()[2]} FROM (
 SELECT k, {line}, {at}, {at} - row_number() OVER (PARTITION BY k, {line} ORDER BY {at}) AS g FROM {src}) GROUP BY k, {line}, g"""


def ink(spark, sf):
    t = table(spark, sf, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    x0 = F.floor(day / 12).cast("long")
    return t.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % _ROWS).alias("y"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("long") % 7).alias("x1"))


def boxes(spark, sf):
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return o.select(
        (F.col("o_custkey") % _PAGES + 1).alias("k"), F.col("o_orderkey").alias("id"), F.floor(day / 12).cast("long").alias("x"),
        (F.col("o_orderkey") % _ROWS).alias("y"), (2 + F.col("o_orderkey") % 5).alias("w"), (1 + F.col("o_custkey") % 4).alias("h"))


@query("merge_runs", f"WITH {_INK} {_runs_of('px', 'y', 'x', 'y x0 x1')}")
def merge_runs(spark, sf):
    return R.merge_runs(ink(spark, sf), ["k"])


@query("transpose_runs", f"WITH {_INK} {_runs_of('px', 'x', 'y', 'x y0 y1')}")
def transpose_runs(spark, sf):
    return R.transpose_runs(ink(spark, sf), ["k"], band=16)


@query("open_runs", f"WITH {_INK} SELECT * FROM ({_runs_of('px', 'y', 'x', 'y x0 x1')}) WHERE x1 - x0 >= 5")
def open_runs(spark, sf):
    return R.open_runs(ink(spark, sf), ["k"], 5)


_DOWN = _runs_of("px", "x", "y", "x y0 y1")


@query("open_columns", f"WITH {_INK}, op AS (SELECT k, x, unnest(range(y0, y1)) AS y FROM ({_DOWN}) WHERE y1 - y0 >= 3) {_runs_of('op', 'y', 'x', 'y x0 x1')}")
def open_columns(spark, sf):
    return R.open_runs(ink(spark, sf), ["k"], 3, across=True)


# staff lines of 7 or more, ledger lines of 2 or more that are under 4 high
@query("erase_lines", f"""WITH {_INK}, rn AS MATERIALIZED ({_runs_of('px', 'y', 'x', 'y x0 x1')}), st AS (SELECT k, y, unnest(range(x0, x1)) AS x FROM rn WHERE x1 - x0 >= 11),
 lv AS MATERIALIZED (SELECT k, y, unnest(range(x0, x1)) AS x FROM rn WHERE x1 - x0 >= 2),
 th AS (SELECT k, x, unnest(range(y0, y1)) AS y FROM ({_runs_of('lv', 'x', 'y', 'x y0 y1')}) WHERE y1 - y0 >= 4),
 ln AS (SELECT k, y, x FROM st UNION (SELECT k, y, x FROM lv EXCEPT SELECT k, y, x FROM th)), sy AS (SELECT k, y, x FROM px EXCEPT SELECT k, y, x FROM ln)
 SELECT 'line' AS layer, * FROM ({_runs_of('ln', 'y', 'x', 'y x0 x1')}) UNION ALL SELECT 'symbol' AS layer, * FROM ({_runs_of('sy', 'y', 'x', 'y x0 x1')})""")
def erase_lines(spark, sf):
    lines, symbols = R.erase_lines(ink(spark, sf), ["k"], 200)
    return lines.withColumn("layer", F.lit("line")).unionByName(symbols.withColumn("layer", F.lit("symbol")))


# what every pixel of a component can reach, step by step
@query("run_components", f"""WITH RECURSIVE {_INK}, rn AS MATERIALIZED ({_runs_of('px', 'y', 'x', 'y x0 x1')}),
 nb AS MATERIALIZED (SELECT a.k AS k, a.y AS y, a.x0 AS x0, b.y AS v, b.x0 AS u0 FROM rn AS a JOIN rn AS b ON a.k = b.k AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
 cl AS (SELECT k, y, x0, y AS fy, x0 AS fx FROM rn UNION SELECT nb.k, nb.v, nb.u0, fy, fx FROM cl JOIN nb ON nb.k = cl.k AND nb.y = cl.y AND nb.x0 = cl.x0),
 nm AS (SELECT k, y, x0, min((fy, fx)) AS f FROM cl GROUP BY k, y, x0)
 SELECT nm.k AS k, f[1] AS first_y, f[2] AS first_x, min(rn.x0) AS x, min(rn.y) AS y, max(x1) - min(rn.x0) AS w, max(rn.y) + 1 - min(rn.y) AS h, sum(x1 - rn.x0)::BIGINT AS area,
 round(sum((rn.x0 + x1 - 1) / 2.0 * (x1 - rn.x0)) / sum(x1 - rn.x0), 6) AS cx, round(sum(rn.y * (x1 - rn.x0)) / sum(x1 - rn.x0), 6) AS cy
 FROM nm JOIN rn ON rn.k = nm.k AND rn.y = nm.y AND rn.x0 = nm.x0 GROUP BY nm.k, f""")
def run_components(spark, sf):
    return R.run_components(ink(spark, sf), ["k"]).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


# row by row away from the box, with the rows missed in a row
@query("trace_stems", f"""WITH RECURSIVE {_INK}, {_BOXES}, s AS (SELECT k, id, x + w // 2 + d AS col, abs(d) AS far, up, CASE WHEN up THEN y ELSE y + h - 1 END AS pos
  FROM bx, range(-2, 3) AS r(d), (VALUES (true), (false)) AS t(up)),
 t AS (SELECT k, id, col, far, up, pos, pos AS tip, 0 AS n, 0 AS miss FROM s UNION ALL
  SELECT t.k, id, col, far, up, pos + CASE WHEN up THEN -1 ELSE 1 END, CASE WHEN px.k IS NOT NULL THEN pos + CASE WHEN up THEN -1 ELSE 1 END ELSE tip END, n + 1,
  CASE WHEN px.k IS NOT NULL THEN 0 ELSE miss + 1 END FROM t LEFT JOIN px ON px.k = t.k AND px.x = col AND px.y = pos + CASE WHEN up THEN -1 ELSE 1 END
  WHERE n < 9 AND miss + (px.k IS NULL)::INT < 2),
 b AS (SELECT k, id, col, far, up, max(least(8, abs(tip - a0))) AS n FROM (SELECT *, first_value(pos) OVER (PARTITION BY k, id, col, up ORDER BY n) AS a0 FROM t) GROUP BY ALL),
 c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k, id, up ORDER BY n DESC, far, col) = 1),
 d AS (SELECT bx.*, u.col AS uc, l.col AS dc, y + h // 2 - (y - u.n) AS rise, y + h + l.n - 1 - (y + h // 2) AS fall FROM bx JOIN c AS u ON u.k = bx.k AND u.id = bx.id AND u.up JOIN c AS l ON l.k = bx.k AND l.id = bx.id AND NOT l.up)
 SELECT k, id, CASE WHEN rise >= fall THEN uc ELSE dc END AS stem_x, CASE WHEN greatest(rise, fall) >= 3 THEN CASE WHEN rise >= fall THEN 'up' ELSE 'down' END END AS stem_dir,
 CASE WHEN greatest(rise, fall) < 3 THEN y + h // 2 WHEN rise >= fall THEN y + h // 2 - rise ELSE y + h // 2 + fall END AS stem_tip_y,
 CASE WHEN greatest(rise, fall) >= 3 THEN greatest(rise, fall) ELSE 0 END::DOUBLE AS stem_length FROM d""")
def trace_stems(spark, sf):
    columns = R.transpose_runs(ink(spark, sf), ["k"])
    out = R.trace_stems(columns, boxes(spark, sf), ["k"], "id", reach=2, gap=2, limit=8, least=3)
    return out.select("k", "id", "stem_x", "stem_dir", "stem_tip_y", "stem_length")


@query("stab_count", f"""WITH {_INK}, {_BOXES}, cl AS ({_DOWN})
 SELECT bx.k AS k, id, count(cl.x) AS stabs FROM bx LEFT JOIN cl ON cl.k = bx.k AND cl.x = bx.x AND y0 < bx.y + 6 * h AND y1 > bx.y AND y1 - y0 BETWEEN 1 AND 2 GROUP BY bx.k, id""")
def stab_count(spark, sf):
    columns = R.transpose_runs(ink(spark, sf), ["k"])
    probes = boxes(spark, sf).select("k", "id", "x", F.col("y").alias("p0"), (F.col("y") + 6 * F.col("h")).alias("p1"))
    return R.stab_count(columns, probes, ["k", "x"], "id", most=2).select("k", "id", "stabs")


_WIDE = "wd AS (SELECT k, id, x - 3 AS x1, y - 2 AS y1, x + 4 * w AS x2, y + 5 * h AS y2 FROM bx)"


def _wide(spark, sf):
    return boxes(spark, sf).select("k", "id", (F.col("x") - 3).alias("x1"), (F.col("y") - 2).alias("y1"), (F.col("x") + 4 * F.col("w")).alias("x2"), (F.col("y") + 5 * F.col("h")).alias("y2"))


@query("box_ink", f"""WITH {_INK}, {_BOXES}, {_WIDE}, rn AS ({_runs_of('px', 'y', 'x', 'y x0 x1')})
 SELECT wd.k AS k, id, coalesce(sum(greatest(0, least(rn.x1, wd.x2) - greatest(rn.x0, wd.x1))) FILTER (rn.k IS NOT NULL), 0)::BIGINT AS ink FROM wd LEFT JOIN rn ON rn.k = wd.k AND rn.y >= wd.y1 AND rn.y < wd.y2 GROUP BY wd.k, id""")
def box_ink(spark, sf):
    return R.box_ink(R.merge_runs(ink(spark, sf), ["k"]), _wide(spark, sf), ["k"], "id").select("k", "id", "ink")


@query("bar_score", f"""WITH {_INK}, {_BOXES}, st AS (SELECT k, id, unnest(range(greatest(x - 2, 0), x + 3)) AS col, y AS a, y + 2 * h + 1 AS z FROM bx),
 sc AS (SELECT st.k AS k, id, col, a, z, count(px.k) AS n, count(px.k) FILTER (px.y < a + (z - a) // 2) AS up FROM st LEFT JOIN px ON px.k = st.k AND px.x = col AND px.y >= a AND px.y < z GROUP BY ALL)
 SELECT k, id, round(max(n / (z - a)), 6) AS density, round(least(max(up / ((z - a) // 2)), max((n - up) / (z - a - (z - a) // 2))), 6) AS half_score FROM sc GROUP BY k, id""")
def bar_score(spark, sf):
    bars = boxes(spark, sf).select("k", "id", "x", F.col("y").alias("top"), (F.col("y") + 2 * F.col("h") + 1).alias("bottom"))
    out = R.bar_score(R.merge_runs(ink(spark, sf), ["k"]), bars, ["k"], "id")
    return out.select("k", "id", F.round("density", 6).alias("density"), F.round("half_score", 6).alias("half_score"))


@query("solid_boxes", f"""WITH {_INK}, {_BOXES}, n AS (SELECT bx.k AS k, id, w * h AS area, count(px.k) AS n FROM bx LEFT JOIN px ON px.k = bx.k AND px.x >= bx.x AND px.x < bx.x + w AND px.y >= bx.y AND px.y < bx.y + h GROUP BY ALL)
 SELECT k, id, round(n / area, 6) AS fill FROM n WHERE n / area >= 0.35""")
def solid_boxes(spark, sf):
    b = boxes(spark, sf).select("k", "id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return R.solid_boxes(R.merge_runs(ink(spark, sf), ["k"]), b, ["k"], "id", 0.35).select("k", "id", F.round("fill", 6).alias("fill"))


@query("count_bands", f"""WITH {_INK}, {_BOXES}, {_WIDE}, rw AS (SELECT k, id, x1, x2, unnest(range(y1, y2)) AS y FROM wd),
 n AS (SELECT rw.k AS k, id, rw.y AS y, rw.x2 - rw.x1 AS w, count(px.k) AS n FROM rw LEFT JOIN px ON px.k = rw.k AND px.y = rw.y AND px.x >= rw.x1 AND px.x < rw.x2 WHERE rw.y % 10 <> 0 GROUP BY ALL),
 i AS (SELECT k, id, count(*) AS m FROM (SELECT *, y - row_number() OVER (PARTITION BY k, id ORDER BY y) AS g FROM n WHERE n > 0.25 * w) GROUP BY k, id, g)
 SELECT wd.k AS k, wd.id AS id, count(m) AS bands FROM wd LEFT JOIN i ON i.k = wd.k AND i.id = wd.id AND m BETWEEN 1 AND 2 GROUP BY wd.k, wd.id""")
def count_bands(spark, sf):
    runs = R.merge_runs(ink(spark, sf), ["k"])
    staff = runs.select("k", "y").filter("y % 10 = 0").distinct()
    return R.count_bands(runs, _wide(spark, sf), ["k"], "id", 0.25, 1, 2, hidden=staff).select("k", "id", "bands")


@query("profile_peaks", f"""WITH {EV}, pr AS (SELECT k, x // 6 AS y, sum(y) AS v FROM (SELECT k, floor(x)::BIGINT AS x, y FROM ev) GROUP BY k, x // 6),
 b AS (SELECT k, min(y) AS lo, max(y) AS hi FROM pr WHERE v > 0 GROUP BY k), ax AS (SELECT k, lo, hi, unnest(range(lo, hi + 1)) AS y FROM b),
 s AS MATERIALIZED (SELECT ax.k AS k, lo, hi, ax.y AS y, coalesce(sum(pr.v), 0) / 3 AS s FROM ax LEFT JOIN pr ON pr.k = ax.k AND pr.y BETWEEN ax.y - 1 AND ax.y + 1 GROUP BY ALL),
 c AS (SELECT a.k AS k, a.y AS y, any_value(a.s) AS s, max(b.s) AS near, sum(b.s) FILTER (abs(b.y - a.y) <= 2) AS n2, sum(b.s) AS w, sum(b.s * b.y) AS wy, any_value(a.lo) AS lo, any_value(a.hi) AS hi,
  max(b.s) FILTER (abs(b.y - a.y) <= 2) AS m2 FROM s AS a JOIN s AS b ON a.k = b.k AND abs(a.y - b.y) <= 4 GROUP BY a.k, a.y),
 d AS (SELECT *, max(s) OVER (PARTITION BY k) AS top FROM c),
 e AS (SELECT *, y - lag(y) OVER (PARTITION BY k ORDER BY y) AS gap FROM d WHERE y BETWEEN lo + 2 AND hi - 2 AND s >= 0.95 * m2 AND s > 0.25 * top),
 f AS (SELECT *, sum(CASE WHEN gap < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY y) AS g FROM e),
 h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, g ORDER BY s DESC, y) = 1),
 i AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY y) AS p, lead(s) OVER (PARTITION BY k ORDER BY y) AS n FROM h WHERE s >= 0.65 * top)
 SELECT k, y AS peak, round(s, 4) AS height, round(wy / w, 4) AS centre FROM i WHERE NOT coalesce(s < 0.8 * p AND s < 0.8 * n, false)""")
def profile_peaks(spark, sf):
    profile = ev(spark, sf).groupBy("k", F.floor(F.floor("x") / 6).alias("row")).agg(F.sum("y").alias("amount"))
    out = R.profile_peaks(profile, ["k"], 3, 4, "row", "amount")
    return out.select("k", "peak", F.round("height", 4).alias("height"), F.round("centre", 4).alias("centre"))
