"""Check queries: row-local filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from .registry import EV, ev, query, table


@query("box_center", """SELECT l_orderkey, l_linenumber, l_partkey + CAST(floor(l_linenumber / 2.0) AS BIGINT) AS cx,
 l_suppkey + CAST(floor(CAST(l_quantity AS INT) / 2.0) AS BIGINT) AS y_center FROM lineitem""")
def box_center(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("h", F.col("l_quantity").cast("int"))
    return P.box_center(li, "l_partkey", "l_suppkey", "l_linenumber", "h").select("l_orderkey", "l_linenumber", "cx", "y_center")


@query("shape_filter", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
 WHERE l_extendedprice BETWEEN 5000 AND 60000 AND l_quantity / l_linenumber BETWEEN 2 AND 20
 AND l_extendedprice / (l_quantity * l_linenumber) >= 300 AND l_linenumber >= 2""")
def shape_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    return P.shape_filter(li, "l_extendedprice", "l_quantity", "l_linenumber", (5000, 60000), (2, 20), 300, 2).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


# staff from 40 to 60 and dy 10 for detections whose y is the event value
@query("tier_filter", f"""WITH {EV}, t AS (SELECT id, k, y, CASE WHEN id % 2 = 0 THEN 'treble' ELSE 'bass' END AS clef,
 (id % 100) / 100.0 AS score, CASE WHEN id % 10 = 9 THEN NULL ELSE 40.0 END AS top FROM ev)
 SELECT id, clef, y, CAST(score AS DOUBLE) AS score FROM t WHERE top IS NULL OR (clef = 'treble' AND NOT (
 (y - 60 > 5 AND score < 0.90) OR (y - 60 > 20 AND score < 0.95) OR score < 0.58 OR
 (40 - y > 10 AND score < 0.65) OR (40 - y > 30 AND score < 0.98)))
 OR (clef = 'bass' AND NOT ((40 - y > 10 AND score < 0.80) OR (y - 60 > 40 AND score < 0.65) OR score < 0.60 OR
 (y - 60 > 5 AND score < 0.90 AND abs(score - 0.95) > 0.02 AND abs(score - 1.0) > 0.02) OR
 (y - 60 > 15 AND score < 0.70) OR (y - 60 > 3 AND score < 0.65)))""")
def tier_filter(spark, sf):
    d = ev(spark, sf).select(
        "id", F.when(F.col("id") % 2 == 0, "treble").otherwise("bass").alias("clef"), "y",
        (F.col("id") % 100 / 100.0).alias("score"),
        F.when(F.col("id") % 10 != 9, 40.0).alias("top"), F.lit(60.0).alias("bottom"), F.lit(10.0).alias("dy"))
    return P.tier_filter(d, "y", "top", "bottom", "score", "dy", "clef").select("id", "clef", "y", "score")


@query("score_floor", "SELECT l_orderkey, l_linenumber, greatest(0.05, l_discount) AS score FROM lineitem")
def score_floor(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"))
    return P.score_floor(li, "score", 0.05)


@query("boundary_filter", f"""WITH {EV}, b AS (SELECT k, min(x) AS first_x FROM ev WHERE typ = 'signup' GROUP BY k)
 SELECT id, ev.k AS k, x FROM ev LEFT JOIN b ON ev.k = b.k WHERE x > coalesce(first_x, 473400.0)""")
def boundary_filter(spark, sf):
    e = ev(spark, sf)
    b = ev(spark, sf, "signup").groupBy("k").agg(F.min("x").alias("first_x"))
    return P.boundary_filter(e, b, ["k"], "x", "first_x", 473400.0).select("id", "k", "x")


@query("edge_filter", """SELECT o_orderkey, o_totalprice FROM orders
 WHERE o_totalprice > floor(500000 * 0.10) AND o_totalprice < floor(500000 * 0.96)""")
def edge_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.edge_filter(o, "o_totalprice", F.lit(500000))


@query("conditional_tier", f"""WITH {EV}, t AS (SELECT id, y, x, (id % 100) / 100.0 AS score, id % 3 = 0 AS m FROM ev)
 SELECT id, y FROM t WHERE NOT (x < 473500.0 + 10 AND y < 100 - 3 AND score < 0.70)
 AND NOT (CASE WHEN 100 - y > 50 THEN true WHEN 100 - y > 25 THEN (m OR score < 0.95) ELSE false END)""")
def conditional_tier(spark, sf):
    d = ev(spark, sf).withColumns({"score": F.col("id") % 100 / 100.0, "m": F.col("id") % 3 == 0})
    return P.above_staff_filter(d, "x", "y", F.lit(100.0), F.lit(473500.0), "score", F.lit(10.0), "m").select("id", "y")


@query("typed_threshold", f"""WITH {EV} SELECT id, typ, y FROM ev WHERE y >= CASE typ WHEN 'view' THEN 70 WHEN 'click' THEN 50 ELSE 60 END""")
def typed_threshold(spark, sf):
    return P.typed_threshold(ev(spark, sf), "typ", "y", {"view": 70.0, "click": 50.0}, 60.0).select("id", "typ", "y")


@query("ledger_threshold", f"""WITH {EV}, t AS (SELECT id, y, (id % 50) / 100.0 AS score, greatest(40 - y, y - 60) / 10.0 AS outside FROM ev)
 SELECT id, y FROM t WHERE score >= CASE WHEN outside > 0.5 AND outside <= 2.5 THEN 0.35 ELSE 0.42 END""")
def ledger_threshold(spark, sf):
    d = ev(spark, sf).withColumn("score", F.col("id") % 50 / 100.0)
    return P.ledger_threshold(d, "y", F.lit(40.0), F.lit(60.0), "score", F.lit(10.0)).select("id", "y")


@query("score_band", """SELECT l_orderkey, l_linenumber, CASE WHEN s = 0.80 THEN 'floor' WHEN abs(s - 0.80) < 0.02 THEN 'near_floor'
 WHEN s <= 0.81 THEN 'low' WHEN s >= 0.78 AND s < 0.85 THEN 'template' ELSE 'other' END AS band
 FROM (SELECT l_orderkey, l_linenumber, CAST(0.75 AS DOUBLE) + l_discount AS s FROM lineitem)""")
def score_band(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", P.score_band(F.lit(0.75) + F.col("l_discount")).alias("band"))


@query("parity_split", """SELECT s_suppkey, CAST(floor(s_nationkey / 2.0) AS BIGINT) AS pair_idx,
 CASE WHEN s_nationkey % 2 = 0 THEN 'treble' ELSE 'bass' END AS clef FROM supplier WHERE floor(s_nationkey / 2.0) < 10""")
def parity_split(spark, sf):
    return P.parity_split(table(spark, sf, "supplier"), "s_nationkey", 10).select("s_suppkey", "pair_idx", "clef")


# fixed values: a few of the distances the operators scale by the line spacing
PARAMS = [("chord_x", 0.9), ("chord_y", 4.0), ("barline_pair", 8.0), ("rest_near_note", 1.5), ("rest_dedupe", 2.0)]


@query("scaled_thresholds", f"""WITH {EV}, dy AS (SELECT k, avg(y) AS dy FROM ev GROUP BY k),
 p(name, mult) AS (VALUES ('chord_x', 0.9), ('chord_y', 4.0), ('barline_pair', 8.0), ('rest_near_note', 1.5), ('rest_dedupe', 2.0))
 SELECT k, name, round(mult * dy, 6) AS threshold FROM dy CROSS JOIN p""")
def scaled_thresholds(spark, sf):
    dy = ev(spark, sf).groupBy("k").agg(F.avg("y").alias("dy"))
    p = spark.createDataFrame(PARAMS, "name string, mult double")
    return P.scaled_thresholds(p, dy).select("k", "name", F.round("threshold", 6).alias("threshold"))
