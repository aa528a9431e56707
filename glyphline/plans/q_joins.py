"""Check queries: joins. The group is the user, positions are hours, boundaries are purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import EV, ev, query, table


@query("nearest_assign", """WITH c AS (SELECT n_regionkey AS g, c_nationkey AS n, floor(avg(c_acctbal)) AS centre FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
 s AS (SELECT s_suppkey, s_acctbal, n_regionkey AS g FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 d AS (SELECT s_suppkey, n, centre, abs(s_acctbal - centre) AS dist FROM s JOIN c ON c.g = s.g),
 r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, n) AS rn FROM d)
 SELECT s_suppkey, n AS nation, round(dist, 4) AS dist FROM r WHERE rn = 1""")
def nearest_assign(spark, sf):
    region = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    c = table(spark, sf, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.groupBy("region", F.col("c_nationkey").alias("nation")).agg(F.floor(F.avg("c_acctbal")).alias("centre"))
    s = table(spark, sf, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("region", "s_suppkey", "s_acctbal")
    out = J.nearest_assign(s, c, ["region"], "s_acctbal", "centre", "nation", "s_suppkey")
    return out.select("s_suppkey", "nation", F.round("dist", 4).alias("dist"))


_BANDS = """b AS (SELECT o_orderstatus AS st, CAST(o_orderpriority[1] AS INT) AS p, min(o_totalprice) + 60000 * CAST(o_orderpriority[1] AS INT) AS lo FROM orders GROUP BY 1, o_orderpriority),
 pr AS (SELECT st, p AS pair_idx, lo AS t_top, lo + 20000 AS t_bot, lo + 40000 AS b_top, lo + 60000 AS b_bot FROM b)"""


@query("range_nearest", f"""WITH {_BANDS}, j AS (SELECT o_orderkey, pair_idx, o_totalprice <= (t_bot + b_top) / 2.0 AS tr,
 abs(o_totalprice - CASE WHEN o_totalprice <= (t_bot + b_top) / 2.0 THEN (t_top + t_bot) / 2.0 ELSE (b_top + b_bot) / 2.0 END) AS d
 FROM orders JOIN pr ON o_orderstatus = st WHERE o_totalprice BETWEEN t_top - 5000.0 * 5 AND b_bot + 5000.0 * 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d, pair_idx) AS rn FROM j)
 SELECT o_orderkey, pair_idx, CASE WHEN tr THEN 'treble' ELSE 'bass' END AS clef FROM r WHERE rn = 1""")
def range_nearest(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1).cast("int"))
    b = o.groupBy("o_orderstatus", F.col("p").alias("pair_idx")).agg((F.min("o_totalprice") + 60000 * F.first("p")).alias("lo"))
    pairs = b.select("o_orderstatus", "pair_idx", F.col("lo").alias("t_top"), (F.col("lo") + 20000).alias("t_bot"),
                     (F.col("lo") + 40000).alias("b_top"), (F.col("lo") + 60000).alias("b_bot"))
    rows = o.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = J.range_nearest(rows, pairs, ["o_orderstatus"], "o_totalprice", F.lit(5000.0), "o_orderkey")
    return out.select("o_orderkey", "pair_idx", "clef")


@query("box_anti", f"""WITH {EV}, b AS (SELECT k, x - 2 AS x1, x + 2 AS x2, y - 10 AS y1, y + 10 AS y2 FROM ev WHERE typ = 'error')
 SELECT id, k FROM ev WHERE typ <> 'error' AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = ev.k
 AND ev.x BETWEEN x1 - 0.5 AND x2 + 0.5 AND ev.y BETWEEN y1 - 0.5 AND y2 + 0.5)""")
def box_anti(spark, sf):
    boxes = ev(spark, sf, "error").select("k", (F.col("x") - 2).alias("x1"), (F.col("x") + 2).alias("x2"),
                                          (F.col("y") - 10).alias("y1"), (F.col("y") + 10).alias("y2"))
    rows = ev(spark, sf).filter("typ <> 'error'")
    return J.box_anti(rows, boxes, ["k"], "x", "y", 0.5).select("id", "k")


@query("box_anti_sizes", f"""WITH {EV}, b AS (SELECT k, x - y / 5 AS x1, x + y AS x2, y - id % 9 AS y1, y + id % 40 AS y2 FROM ev WHERE typ = 'error')
 SELECT id, k FROM ev WHERE typ <> 'error' AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = ev.k AND ev.x BETWEEN x1 AND x2 AND ev.y BETWEEN y1 AND y2)""")
def box_anti_sizes(spark, sf):
    i = F.col("id")
    boxes = ev(spark, sf, "error").select("k", (F.col("x") - F.col("y") / 5).alias("x1"), (F.col("x") + F.col("y")).alias("x2"), (F.col("y") - i % 9).alias("y1"), (F.col("y") + i % 40).alias("y2"))
    return J.box_anti(ev(spark, sf).filter("typ <> 'error'"), boxes, ["k"], "x", "y", 0.0).select("id", "k")


@query("proximity_anti", f"""WITH {EV} SELECT id, k FROM ev v WHERE typ = 'view'
 AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.typ = 'error' AND e.k = v.k AND abs(e.x - v.x) < 1)""")
def proximity_anti(spark, sf):
    return J.proximity_anti(ev(spark, sf, "view"), ev(spark, sf, "error"), ["k"], "x", "x", "id", 1.0).select("id", "k")


@query("before_first", f"""WITH {EV}, p AS (SELECT k, min(x) AS f FROM ev WHERE typ = 'purchase' GROUP BY k)
 SELECT id, ev.k AS k FROM ev LEFT JOIN p ON p.k = ev.k WHERE f IS NULL OR x >= f""")
def before_first(spark, sf):
    return J.before_first(ev(spark, sf), ev(spark, sf, "purchase"), ["k"], "x", "x").select("id", "k")


@query("two_stage_assign", f"""WITH {EV}, c AS (SELECT m.k AS k, m.id AS mark_id, m.y AS score, n.id AS note_id,
 sqrt((n.x - m.x) * (n.x - m.x) + abs(n.y - m.y) * abs(n.y - m.y)) AS d FROM ev m JOIN ev n ON m.k = n.k
 WHERE m.typ = 'error' AND n.typ = 'purchase' AND n.x - m.x BETWEEN -10.0 AND 70.0 AND abs(n.y - m.y) <= 24.0),
 a AS (SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY d, note_id) AS rn FROM c),
 b AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, mark_id) AS rw FROM a WHERE rn = 1)
 SELECT k, note_id, mark_id, score FROM b WHERE rw = 1""")
def two_stage_assign(spark, sf):
    m = ev(spark, sf, "error").select("k", F.col("id").alias("mark_id"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("y").alias("score"))
    n = ev(spark, sf, "purchase").select("k", F.col("id").alias("note_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return J.two_stage_assign(m, n, ["k"], 20.0)


@query("two_stage_zone", f"""WITH {EV}, c AS (SELECT m.k AS k, m.id AS mark_id, m.y AS score, n.id AS note_id,
 sqrt((n.x - m.x) * (n.x - m.x) + abs(n.y - m.y) * abs(n.y - m.y)) AS d FROM ev m JOIN ev n ON m.k = n.k AND floor(m.y / 20) = floor(n.y / 20)
 WHERE m.typ = 'error' AND n.typ = 'purchase' AND n.x - m.x BETWEEN -10.0 AND 70.0 AND abs(n.y - m.y) <= 24.0),
 a AS (SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY d, note_id) AS rn FROM c),
 b AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, mark_id) AS rw FROM a WHERE rn = 1)
 SELECT k, note_id, mark_id, score FROM b WHERE rw = 1""")
def two_stage_zone(spark, sf):
    zone = F.floor(F.col("y") / 20)
    m = ev(spark, sf, "error").select("k", F.col("id").alias("mark_id"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("y").alias("score"), zone.alias("mark_zone"))
    n = ev(spark, sf, "purchase").select("k", F.col("id").alias("note_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), zone.alias("note_zone"))
    return J.two_stage_assign(m, n, ["k"], 20.0, F.col("mark_zone") == F.col("note_zone"))


@query("snap_best", f"""WITH {EV}, c AS (SELECT v.k AS k, v.id AS id, v.y AS y, p.x AS target, abs(p.x - v.x) AS d FROM ev v JOIN ev p ON p.k = v.k
 WHERE v.typ = 'click' AND p.typ = 'purchase'),
 a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, target) AS rn FROM c),
 b AS (SELECT *, row_number() OVER (PARTITION BY k, target ORDER BY y DESC, id) AS rw FROM a WHERE rn = 1 AND d <= 35)
 SELECT k, target, id, y FROM b WHERE rw = 1""")
def snap_best(spark, sf):
    return J.snap_best(ev(spark, sf, "click"), ev(spark, sf, "purchase"), ["k"], "x", "x", "id", "y", 35.0)


@query("greedy_pair", f"""WITH RECURSIVE {EV}, l AS (SELECT k, id, x, row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn FROM ev WHERE typ = 'click'),
 r AS (SELECT k, list(struct_pack(x := x, id := id) ORDER BY x, id) AS rs FROM ev WHERE typ = 'purchase' GROUP BY k),
 g AS (SELECT k, 0::BIGINT AS rn, NULL::BIGINT AS lid, NULL::BIGINT AS rid, NULL::DOUBLE AS x, coalesce(rs, []) AS rest FROM (SELECT DISTINCT k FROM l) LEFT JOIN r USING (k)
  UNION ALL SELECT g.k, l.rn, l.id, best.id, CASE WHEN best IS NULL THEN l.x ELSE (l.x + best.x) / 2.0 END,
  CASE WHEN best IS NULL THEN rest ELSE list_filter(rest, lambda e: e.id <> best.id) END
  FROM (SELECT g.k, l.rn, l.id, l.x, rest, list_sort(list_transform(list_filter(rest, lambda e: abs(l.x - e.x) < 8.0), lambda e: struct_pack(d := abs(l.x - e.x), x := e.x, id := e.id)))[1] AS best
   FROM g JOIN l ON l.k = g.k AND l.rn = g.rn + 1) AS q(k, rn, id, lx, rest, best), LATERAL (SELECT q.k, q.rn, q.id, q.lx AS x) l, LATERAL (SELECT q.k) g),
 last AS (SELECT k, arg_max(rest, rn) AS rest FROM g GROUP BY k),
 rights AS (SELECT k, unnest(rest) AS e FROM last UNION ALL SELECT k, unnest(rs) FROM r WHERE k NOT IN (SELECT k FROM l))
 SELECT k, lid AS left_id, rid AS right_id, x FROM g WHERE rn > 0 UNION ALL SELECT k, NULL, e.id, e.x FROM rights""")
def greedy_pair(spark, sf):
    return J.greedy_pair(ev(spark, sf, "click"), ev(spark, sf, "purchase"), ["k"], "x", "id", 8.0)


@query("asof_backward", f"""WITH {EV}, a AS (SELECT k, x, y AS bpm FROM ev WHERE typ = 'signup'), l AS (SELECT id, k, x + 1 AS x1 FROM ev WHERE typ <> 'signup')
 SELECT l.id AS id, l.k AS k, coalesce(a.bpm, 2.0) AS bpm FROM l ASOF LEFT JOIN a ON l.k = a.k AND l.x1 >= a.x""")
def asof_backward(spark, sf):
    a = ev(spark, sf, "signup").withColumnRenamed("y", "bpm")
    rows = ev(spark, sf).filter("typ <> 'signup'")
    return J.asof_backward(rows, a, ["k"], "x", "x", "bpm", "id", 2.0, slack=1.0).select("id", "k", "bpm")


@query("segment_by_boundary", f"""WITH {EV} SELECT id, k, (SELECT count(*) FROM ev p WHERE p.typ = 'purchase' AND p.k = e.k AND p.x <= e.x) AS measure_idx
 FROM ev e WHERE typ <> 'purchase'""")
def segment_by_boundary(spark, sf):
    rows = ev(spark, sf).filter("typ <> 'purchase'")
    return J.segment_by_boundary(rows, ev(spark, sf, "purchase"), ["k"], "x", "x", "id").select("id", "k", "measure_idx")


@query("midpoint_bind", f"""WITH {EV}, s AS (SELECT id, k, x, (SELECT count(*) FROM ev p WHERE p.typ = 'purchase' AND p.k = e.k AND p.x <= e.x) AS m
 FROM ev e WHERE typ IN ('view', 'click')), r AS (SELECT k, m, min(x) AS lo, max(x) AS hi FROM s GROUP BY k, m),
 b AS (SELECT k, m, coalesce((lag(hi) OVER w + lo) / 2.0, '-inf'::DOUBLE) AS lo, coalesce((hi + lead(lo) OVER w) / 2.0, 'inf'::DOUBLE) AS hi
 FROM r WINDOW w AS (PARTITION BY k ORDER BY m))
 SELECT id, ev.k AS k, m AS measure_idx FROM ev JOIN b ON ev.k = b.k AND ev.x >= lo AND ev.x < hi WHERE typ = 'signup'""")
def midpoint_bind(spark, sf):
    notes = J.segment_by_boundary(ev(spark, sf, "view", "click"), ev(spark, sf, "purchase"), ["k"], "x", "x", "id")
    return J.midpoint_bind(ev(spark, sf, "signup"), notes, ["k"], "measure_idx", "x", "x", "id").select("id", "k", "measure_idx")


@query("positional_zip", """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations),
 u AS (SELECT conv_id, pos, text AS user_text FROM t WHERE role = 'user'), a AS (SELECT conv_id, pos, text AS answer FROM t WHERE role = 'assistant')
 SELECT conv_id, pos, user_text, answer, user_text IS NOT NULL AND answer IS NOT NULL AS both_sides FROM u FULL JOIN a USING (conv_id, pos)""")
def positional_zip(spark, sf):
    from ..core import scan as S

    c = S.scan(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn"], pos=S.row_number()).withColumn("pos", F.col("pos") - 1)
    u = c.filter("role = 'user'").withColumnRenamed("text", "user_text")
    a = c.filter("role = 'assistant'").withColumnRenamed("text", "answer")
    out = J.positional_zip(u, a, ["conv_id"], "pos", ["user_text"], ["answer"])
    return out.withColumn("both_sides", F.col("user_text").isNotNull() & F.col("answer").isNotNull())


@query("section_left", "SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS matched FROM documents")
def section_left(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return J.section_left(d, table(spark, sf, "labels"), ["doc_id"])


# members of a unit from the event: one or two notes, stems and durations from the id
def _units(spark, sf):
    i = F.col("id")
    stem = lambda e: F.when(e % 3 == 0, "up").when(e % 3 == 1, "down")
    note = lambda j: F.struct((((i * 7 + j) % 7) + 1).cast("string").alias("pitch"),
                              (F.lit(0.25) * (1 + (i + j * 3) % 4)).cast("double").alias("dur"), stem(i + j).alias("stem"))
    two = F.col("typ").isin("click", "view")
    return ev(spark, sf).select("k", F.col("id").alias("unit_id"), "x", F.when(two, F.array(note(0), note(1))).otherwise(F.array(note(0))).alias("notes"))


# one small step at a time: held note h of unit i looks at unit j, else the next held note or unit
_HELD = """CASE WHEN {i} > len(us) THEN [] ELSE (SELECT CASE WHEN len(ns) >= 2 AND u > 0 AND dn > 0 THEN list_transform(list_filter(ns, lambda e: e.s = mi AND e.d > bs), lambda e: struct_pack(p := e.p, s := mi, fin := st + least(e.d, 2 * bs))) ELSE [] END FROM
 (SELECT *, list_min(list_transform(list_filter(ns, lambda e: e.s IS DISTINCT FROM mi), lambda e: e.d)) AS bs FROM (SELECT *, CASE WHEN u <= dn THEN 'up' ELSE 'down' END AS mi FROM
 (SELECT us[{i}].ns AS ns, us[{i}].st AS st, len(list_filter(us[{i}].ns, lambda e: e.s = 'up')) AS u, len(list_filter(us[{i}].ns, lambda e: e.s = 'down')) AS dn)))) END"""


@query("overlap_propagate", f"""WITH RECURSIVE {EV}, nt AS (SELECT k, id, x, list_transform(range(0, CASE WHEN typ IN ('click', 'view') THEN 2 ELSE 1 END), lambda j: struct_pack(p := ((id * 7 + j) % 7 + 1)::VARCHAR,
 d := 0.25 * (1 + (id + j * 3) % 4)::DOUBLE, s := CASE (id + j) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END)) AS ns FROM ev),
 ut AS (SELECT *, coalesce(sum(list_min(list_transform(ns, lambda e: e.d))) OVER (PARTITION BY k ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM nt),
 ul AS (SELECT k, list(struct_pack(id := id, x := x, st := st, ns := ns) ORDER BY x, id) AS us FROM ut GROUP BY k),
 w AS (SELECT k, 0 AS step, us, 1 AS i, {_HELD.format(i='1')} AS hs, 1 AS h, 2 AS j FROM ul UNION ALL
 SELECT k, step + 1, CASE WHEN go AND len(list_filter(us[j].ns, lambda e: e.p = hs[h].p)) = 0 THEN list_transform(range(1, len(us) + 1), lambda q: CASE WHEN q = j THEN struct_pack(id := us[q].id, x := us[q].x, st := us[q].st,
  ns := list_append(us[q].ns, struct_pack(p := hs[h].p, d := list_min(list_transform(us[q].ns, lambda e: e.d)), s := hs[h].s))) ELSE us[q] END) ELSE us END,
 CASE WHEN nxt THEN i + 1 ELSE i END, CASE WHEN nxt THEN {_HELD.format(i='(i + 1)')} ELSE hs END, CASE WHEN nxt THEN 1 WHEN go THEN h ELSE h + 1 END, CASE WHEN nxt THEN i + 2 WHEN go THEN j + 1 ELSE i + 1 END
 FROM (SELECT *, NOT go AND h >= len(hs) AS nxt FROM (SELECT *, coalesce(h <= len(hs) AND j <= len(us) AND us[j].st < hs[h].fin AND len(list_filter(range(1, len(us) + 1), lambda q: q <> i AND abs(us[q].x - us[j].x) < 0.75
  AND (len(list_filter(us[q].ns, lambda e: e.s = hs[h].s)) > 0 OR (len(us[q].ns) >= 2 AND len(list_filter(us[q].ns, lambda e: e.s IS NULL)) > 0)))) = 0, false) AS go FROM w WHERE i <= len(us)))),
 z AS (SELECT k, unnest(arg_max(us, step)) AS u FROM w GROUP BY k)
 SELECT k, u.id AS unit_id, len(u.ns) AS n_notes, array_to_string(list_transform(u.ns, lambda e: e.p), ' ') AS pitches FROM z""")
def overlap_propagate(spark, sf):
    out = J.overlap_propagate(_units(spark, sf), ["k"], 0.5)
    return out.select("k", "unit_id", F.size("notes").alias("n_notes"), F.array_join(F.transform("notes", lambda n: n["pitch"]), " ").alias("pitches"))


@query("pair_count", f"""WITH {EV} SELECT a.k AS k, CAST(count(b.id) AS BIGINT) AS n_pairs FROM ev a LEFT JOIN ev b ON a.k = b.k
 AND (b.x > a.x OR (b.x = a.x AND b.id > a.id)) AND b.x < a.x + 1.0 GROUP BY a.k""")
def pair_count(spark, sf):
    return J.pair_count(ev(spark, sf), ["k"], "x", "id", 1.0)


@query("stacked_pairs", f"""WITH {EV} SELECT a.k AS k, count(*) AS n_pairs FROM ev a JOIN ev b ON a.k = b.k AND a.id < b.id
 AND abs(a.x - b.x) < 2.0 AND abs(a.y - b.y) > 10 AND abs(a.y - b.y) < 25 GROUP BY a.k""")
def stacked_pairs(spark, sf):
    return J.stacked_pairs(ev(spark, sf), ["k"], "x", "y", 2.0, 10.0, 25.0)


@query("lone_rows", f"""WITH {EV} SELECT id, k FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE a.k = b.k AND abs(a.x - b.x) < 2.0 AND abs(a.y - b.y) > 8)""")
def lone_rows(spark, sf):
    return J.lone_rows(ev(spark, sf), ["k"], "x", "y", 2.0, 8.0, "id").select("id", "k")


@query("bracket_gap", f"""WITH {EV} SELECT id, k FROM (SELECT id, k, (SELECT max(x) FROM ev n WHERE n.k = r.k AND n.typ IN ('view', 'click') AND n.x < r.x) AS l,
 (SELECT min(x) FROM ev n WHERE n.k = r.k AND n.typ IN ('view', 'click') AND n.x > r.x) AS h FROM ev r WHERE typ = 'error')
 WHERE NOT coalesce(h - l < 5, false)""")
def bracket_gap(spark, sf):
    return J.bracket_gap(ev(spark, sf, "error"), ev(spark, sf, "view", "click"), ["k"], "x", "x", "id", 5.0).select("id", "k")


@query("tolerance_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_discount - 0.0) < 0.005 THEN 'none' WHEN abs(l_discount - 0.02) < 0.015 THEN 'low'
 WHEN abs(l_discount - 0.05) < 0.025 THEN 'mid' ELSE 'high' END AS label FROM lineitem""")
def tolerance_lookup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return J.lookup_first(li, "l_discount", [(0.0, 0.005, "none"), (0.02, 0.015, "low"), (0.05, 0.025, "mid")], "high", "label").drop("l_discount")


@query("interval_overlap_sum", f"""WITH {EV}, b AS (SELECT k, id, x - 6 AS b0, x + 20 AS b1 FROM ev WHERE typ = 'purchase'),
 r AS (SELECT k, x AS r0, x + y / 10 AS r1 FROM ev WHERE typ <> 'purchase')
 SELECT b.k AS k, id, round(coalesce(sum(greatest(0, least(r1, b1) - greatest(r0, b0))), 0) / 26, 6) AS fill FROM b LEFT JOIN r ON b.k = r.k GROUP BY b.k, id""")
def interval_overlap_sum(spark, sf):
    b = ev(spark, sf, "purchase").select("k", "id", (F.col("x") - 6).alias("b0"), (F.col("x") + 20).alias("b1"))
    r = ev(spark, sf).filter("typ <> 'purchase'").select("k", F.col("x").alias("r0"), (F.col("x") + F.col("y") / 10).alias("r1"))
    return J.overlap_sum(b, r, ["k"], "id").select("k", "id", F.round(F.col("overlap") / 26, 6).alias("fill"))
