"""Check queries: de-duplication, set operations and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import scan as S
from ..operators import dedupe as D
from ..operators import groups as G
from ..operators import joins as J
from ..operators import sets as U
from .registry import EV, ev, query, table


def greedy_sql(rows: str, order: str, fields: str, conflict: str) -> str:
    """Recursive greedy suppression of ``rows`` (k, id, ...): ``q`` is kept, ``t`` the candidate."""
    return f"""WITH RECURSIVE {EV}, s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS rn FROM ({rows})),
 g AS (SELECT DISTINCT k, 0::BIGINT AS rn, []::STRUCT({fields})[] AS kept FROM s
 UNION ALL SELECT g.k, t.rn, CASE WHEN len(list_filter(kept, lambda q: {conflict})) > 0 THEN kept
 ELSE list_append(kept, struct_pack({', '.join(f'{f.split()[0]} := t.{f.split()[0]}' for f in fields.split(', '))})) END
 FROM g JOIN s t ON t.k = g.k AND t.rn = g.rn + 1) SELECT k, unnest(arg_max(kept, rn)).id AS id FROM g GROUP BY k"""


_BOX = "SELECT id, k, x AS x1, x + y / 10 AS x2, y FROM ev"
_INTER = "greatest(0, least(q.x2, t.x2) - greatest(q.x1, t.x1) + 1)"


def _boxes(spark, sf):
    return ev(spark, sf).select("id", "k", F.col("x").alias("x1"), (F.col("x") + F.col("y") / 10).alias("x2"),
                                F.lit(0.0).alias("y1"), F.lit(0.0).alias("y2"), "y")


@query("nms_overlap", greedy_sql(_BOX, "y DESC, id", "id BIGINT, x1 DOUBLE, x2 DOUBLE", f"{_INTER} / (t.x2 - t.x1 + 1) > 0.3"))
def nms_overlap(spark, sf):
    return D.nms_overlap(_boxes(spark, sf), ["k"], "x1", "y1", "x2", "y2", "y", "id").select("k", "id")


@query("nms_overlap_min", greedy_sql(_BOX, "y DESC, id", "id BIGINT, x1 DOUBLE, x2 DOUBLE", f"{_INTER} / least(t.x2 - t.x1 + 1, q.x2 - q.x1 + 1) > 0.3"))
def nms_overlap_min(spark, sf):
    return D.nms_overlap(_boxes(spark, sf), ["k"], "x1", "y1", "x2", "y2", "y", "id", relative_to="min").select("k", "id")


@query("nms_center", greedy_sql("SELECT id, k, x, y FROM ev", "y DESC, id", "id BIGINT, x DOUBLE, y DOUBLE", "abs(q.x - t.x) < 8 AND abs(q.y - t.y) < 8"))
def nms_center(spark, sf):
    return D.nms_center(ev(spark, sf), ["k"], "x", "y", "y", "id", 8.0).select("k", "id")


@query("nms_center_1d", greedy_sql("SELECT id, k, x, y FROM ev", "y DESC, id", "id BIGINT, x DOUBLE", "abs(q.x - t.x) < 1"))
def nms_center_1d(spark, sf):
    return D.nms_center(ev(spark, sf), ["k"], "x", None, "y", "id", 1.0).select("k", "id")


_TIER = "CASE typ WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END"


@query("nms_tiered", greedy_sql(f"SELECT id, k, x, y, {_TIER} AS tier FROM ev", "tier, y DESC, id", "id BIGINT, x DOUBLE, y DOUBLE", "abs(q.x - t.x) < 6 AND abs(q.y - t.y) < 24"))
def nms_tiered(spark, sf):
    tier = F.when(F.col("typ") == "purchase", 0).when(F.col("typ") == "signup", 1).otherwise(2)
    return D.nms_tiered(ev(spark, sf).withColumn("tier", tier), ["k"], "x", "y", "tier", "y", "id", 6.0).select("k", "id")


_RN = "row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn"


@query("sweep_keep_best", f"""WITH RECURSIVE {EV}, s AS (SELECT id, k, x, y, {_RN} FROM ev),
 g AS (SELECT k, rn, x AS lx, y AS ly, id AS lid, false AS fresh, NULL::BIGINT AS done FROM s WHERE rn = 1
 UNION ALL SELECT s.k, s.rn, CASE WHEN s.x - lx > 8 OR s.y > ly THEN s.x ELSE lx END, CASE WHEN s.x - lx > 8 OR s.y > ly THEN s.y ELSE ly END,
 CASE WHEN s.x - lx > 8 OR s.y > ly THEN s.id ELSE lid END, s.x - lx > 8, CASE WHEN s.x - lx > 8 THEN lid END FROM g JOIN s ON s.k = g.k AND s.rn = g.rn + 1),
 f AS (SELECT k, done AS id FROM g WHERE done IS NOT NULL UNION ALL SELECT k, arg_max(lid, rn) FROM g GROUP BY k)
 SELECT f.k AS k, f.id AS id, x, y FROM f JOIN ev USING (id)""")
def sweep_keep_best(spark, sf):
    return D.sweep_keep_best(ev(spark, sf), ["k"], "x", "y", "id", 8.0)


@query("sweep_keep_first", f"""WITH RECURSIVE {EV}, s AS (SELECT id, k, x, {_RN} FROM ev), g AS (SELECT k, rn, x AS lx, id, true AS keep FROM s WHERE rn = 1
 UNION ALL SELECT s.k, s.rn, CASE WHEN s.x - lx > 12 THEN s.x ELSE lx END, s.id, s.x - lx > 12 FROM g JOIN s ON s.k = g.k AND s.rn = g.rn + 1)
 SELECT k, id, lx AS x FROM g WHERE keep""")
def sweep_keep_first(spark, sf):
    return D.sweep_keep_first(ev(spark, sf), ["k"], "x", "id", 12.0)


@query("sweep_average", f"""WITH RECURSIVE {EV}, s AS (SELECT id, k, floor(x) AS x, row_number() OVER (PARTITION BY k ORDER BY floor(x), id) AS rn FROM ev),
 g AS (SELECT k, rn, x AS p, 1::BIGINT AS n, NULL::DOUBLE AS dp, NULL::BIGINT AS dn FROM s WHERE rn = 1
 UNION ALL SELECT s.k, s.rn, CASE WHEN abs(s.x - p) > 10 THEN s.x ELSE floor((p + s.x) / 2) END, CASE WHEN abs(s.x - p) > 10 THEN 1 ELSE n + 1 END,
 CASE WHEN abs(s.x - p) > 10 THEN p END, CASE WHEN abs(s.x - p) > 10 THEN n END FROM g JOIN s ON s.k = g.k AND s.rn = g.rn + 1)
 SELECT k, dp AS x, dn AS n FROM g WHERE dp IS NOT NULL UNION ALL SELECT k, arg_max(p, rn), arg_max(n, rn) FROM g GROUP BY k""")
def sweep_average(spark, sf):
    d = ev(spark, sf).withColumn("x", F.floor("x").cast("double"))
    return D.sweep_average(d, ["k"], "x", "id", 10.0, whole=True)


# one row at a time: the rows in reach it may drop, and the first that drops it instead
@query("pair_dedupe", f"""WITH RECURSIVE {EV}, l AS (SELECT k, list(struct_pack(id := id, x := x, y := y, s := id % 20 / 20.0::DOUBLE) ORDER BY x, id) AS r FROM ev GROUP BY k),
 g AS (SELECT k, r, 0 AS i, list_transform(r, lambda e: true) AS f FROM l UNION ALL
 SELECT k, r, i + 1, CASE WHEN NOT f[i + 1] THEN f ELSE list_transform(range(1, len(r) + 1), lambda j: CASE WHEN j = i + 1 THEN killer IS NULL WHEN list_contains(cand, j) AND (killer IS NULL OR j < killer) THEN false ELSE f[j] END) END
 FROM (SELECT *, list_filter(cand, lambda j: r[j].s > r[i + 1].s)[1] AS killer FROM (SELECT *, list_filter(range(i + 2, len(r) + 1), lambda j: f[j] AND r[j].x - r[i + 1].x <= 9.0
 AND NOT (abs(r[j].s - r[i + 1].s) < 0.01 AND abs(r[j].y - r[i + 1].y) > 4.5)) AS cand FROM g WHERE i < len(r))))
 SELECT k, r[j].id AS id FROM (SELECT k, r, f, unnest(range(1, len(r) + 1)) AS j FROM g WHERE i = len(r)) WHERE f[j]""")
def pair_dedupe(spark, sf):
    d = ev(spark, sf).withColumn("score", F.col("id") % 20 / 20.0)
    return D.pair_dedupe(d, ["k"], "x", "y", "score", "id", 9.0)


def _greedy_cte(name, rows, order, conflict):
    """CTEs giving ``name`` (k, e): rows ``e`` of (id, x, y, s) that survive greedy suppression."""
    t = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, s DOUBLE)"
    return f"""{name}_s AS (SELECT k, struct_pack(id := id, x := x, y := y, s := s) AS t, row_number() OVER (PARTITION BY k ORDER BY {order}) AS rn FROM ({rows})),
 {name}_g AS (SELECT DISTINCT k, 0::BIGINT AS rn, []::{t}[] AS kept FROM {name}_s UNION ALL
 SELECT g.k, n.rn, CASE WHEN len(list_filter(kept, lambda q: {conflict.format(t='n.t')})) > 0 THEN kept ELSE list_append(kept, n.t) END FROM {name}_g g JOIN {name}_s n ON n.k = g.k AND n.rn = g.rn + 1),
 {name} AS (SELECT k, unnest(arg_max(kept, rn)) AS e FROM {name}_g GROUP BY k)"""


_BOX10 = "abs(q.x - {t}.x) < 10.0 AND abs(q.y - {t}.y) < 10.0"
_BOX13 = "abs(q.x - {t}.x) < 13.0 AND abs(q.y - {t}.y) < 13.0"


@query("class_replace", f"""WITH RECURSIVE {EV}, c AS (SELECT *, id % 40 / 40.0::DOUBLE AS s0 FROM ev),
 {_greedy_cte('h', "SELECT k, id, x, y, greatest(0.8, s0) AS s FROM c WHERE typ = 'click'", 's DESC, id', _BOX13)},
 hs AS (SELECT k, e, row_number() OVER (PARTITION BY k ORDER BY e.s DESC, e.id) AS rn FROM h),
 rg AS (SELECT k, list(struct_pack(id := id, x := x, y := y, s := s0) ORDER BY id) FILTER (typ IN ('view', 'error')) AS slots FROM c GROUP BY k),
 m AS (SELECT k, 0::BIGINT AS rn, coalesce(slots, []) AS slots, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, s DOUBLE)[] AS extra FROM rg UNION ALL
 SELECT k, rn, CASE WHEN ix IS NOT NULL AND slots[ix].s < 0.95 THEN list_transform(range(1, len(slots) + 1), lambda j: CASE WHEN j = ix THEN e ELSE slots[j] END) ELSE slots END,
 CASE WHEN ix IS NULL THEN list_append(extra, e) ELSE extra END FROM
 (SELECT m.k AS k, hs.rn AS rn, slots, extra, e, list_filter(range(1, len(slots) + 1), lambda j: abs(e.x - slots[j].x) < 15.0 AND abs(e.y - slots[j].y) < 15.0)[1] AS ix FROM m JOIN hs ON hs.k = m.k AND hs.rn = m.rn + 1)),
 fin AS (SELECT k, unnest(list_concat(arg_max(slots, rn), arg_max(extra, rn))) AS e FROM m GROUP BY k),
 {_greedy_cte('o', 'SELECT k, e.id AS id, e.x AS x, e.y AS y, e.s AS s FROM fin', 's DESC, id', _BOX10)}
 SELECT k, e.id AS id, e.x AS x, e.y AS y, e.s AS s FROM o""")
def class_replace(spark, sf):
    s = F.col("id") % 40 / 40.0
    reg, hol = ev(spark, sf, "view", "error").withColumn("s", s), ev(spark, sf, "click").withColumn("s", F.greatest(F.lit(0.8), s))
    return D.class_replace(reg, hol, ["k"], "x", "y", "s", "id", 10.0)


@query("argmax_group", f"""WITH {EV} SELECT k, typ, id, y FROM (SELECT *, row_number() OVER (PARTITION BY k, typ ORDER BY y DESC, x, id) AS rn FROM ev) WHERE rn = 1""")
def argmax_group(spark, sf):
    return D.argmax_group(ev(spark, sf), ["k", "typ"], "y", ["x", "id"], ["id", "y"])


@query("natural_break", f"""WITH {EV}, g AS (SELECT k, id, x - lag(x) OVER (PARTITION BY k ORDER BY x, id) AS gap FROM ev WHERE typ = 'purchase'),
 j AS (SELECT k, gap, lead(gap) OVER (PARTITION BY k ORDER BY gap, id) AS ng FROM g WHERE gap IS NOT NULL),
 b AS (SELECT k, count(*) AS n, arg_max((gap + ng) / 2, (ng - gap, -gap)) FILTER (ng - gap > 0) AS mid FROM j GROUP BY k)
 SELECT k, greatest(20.0, coalesce(mid, 32.0)) AS threshold FROM b WHERE n >= 2""")
def natural_break(spark, sf):
    return D.natural_break(ev(spark, sf, "purchase"), ["k"], "x", "id", 4.0)


@query("topn_per_group", f"""WITH {EV} SELECT k, id, y, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, id) AS rank FROM ev) WHERE rank <= 10""")
def topn_per_group(spark, sf):
    return D.topn_per_group(ev(spark, sf), ["k"], [F.col("y").desc(), F.col("id")], 10).select("k", "id", "y", F.col("rank").cast("long").alias("rank"))


_PURGE = f"""WITH {EV}, n AS (SELECT id, k, x, id % 4 = 0 AS hollow, id % 5 = 0 AS comp FROM ev WHERE typ IN ('view', 'click')),
 b AS (SELECT k, x, coalesce(lag(x) OVER w, 473352.0) AS l, lead(x) OVER w IS NOT NULL AS mid, count(*) OVER (PARTITION BY k) AS nb FROM ev WHERE typ = 'purchase' WINDOW w AS (PARTITION BY k ORDER BY x)),
 q AS (SELECT k, list_sort(list(x - l)) AS gs FROM b GROUP BY k), m AS (SELECT k, gs[len(gs) // 2 + 1] AS med FROM q),
 c AS (SELECT b.*, med, (SELECT count(*) FROM n WHERE n.k = b.k AND n.x > l AND n.x < b.x) AS a, (SELECT count(*) FROM n WHERE n.k = b.k AND n.x > l AND n.x < b.x AND NOT hollow) AS r FROM b JOIN m ON m.k = b.k),
 v AS (SELECT *, nb >= 2 AND mid AND r = 0 AND a < 2 AND EXISTS (SELECT 1 FROM n WHERE n.k = c.k) AS o FROM c)"""


def _purge(spark, sf):
    rows = ev(spark, sf, "view", "click").withColumns({"s": F.when(F.col("id") % 4 == 0, 0.80).otherwise(0.9), "comp": F.col("id") % 5 == 0})
    b = ev(spark, sf, "purchase").select("k", "x")
    starts = b.select("k").distinct().withColumn("start", F.lit(473352.0))
    return D.narrow_segment_purge(rows, b, starts, ["k"], "x", "s", "id", "comp")


@query("narrow_segment_purge", _PURGE + """ SELECT k, x FROM v WHERE NOT (o AND x - l < med * 0.5)""")
def narrow_segment_purge(spark, sf):
    return _purge(spark, sf)[1]


@query("lone_hollow_purge", _PURGE + """ SELECT n.k AS k, id FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.k = n.k AND n.x > l AND n.x < v.x AND o
 AND ((x - l >= med * 0.5 AND a = 1) OR (x - l < med * 0.5 AND comp)))""")
def lone_hollow_purge(spark, sf):
    return _purge(spark, sf)[0].select("k", "id")


@query("typed_union", f"""WITH {EV} SELECT 'note' AS type, k, x, id, y, NULL::DOUBLE AS price FROM ev
 UNION ALL SELECT 'order', o_custkey, epoch_us(o_orderdate) / 3.6e9, o_orderkey, NULL, o_totalprice FROM orders""")
def typed_union(spark, sf):
    from .registry import hours

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), hours("o_orderdate").alias("x"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return U.typed_union({"note": ev(spark, sf).select("k", "x", "id", "y"), "order": o})


@query("union_dedupe", greedy_sql("SELECT id, k, x, y FROM ev WHERE typ IN ('view', 'click', 'error')", "y DESC, id", "id BIGINT, x DOUBLE, y DOUBLE", "abs(q.x - t.x) < 12 AND abs(q.y - t.y) < 12"))
def union_dedupe(spark, sf):
    passes = [ev(spark, sf, t) for t in ("view", "click", "error")]
    return U.union_dedupe(passes, ["k"], "x", "y", "y", "id", 12.0).select("k", "id")


@query("removed_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderpriority <> '5-LOW')")
def removed_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return U.removed_rows(o, (F.col("o_totalprice") > 100000) & (F.col("o_orderpriority") != "5-LOW")).drop("o_orderpriority")


def _clusters(spark, sf):
    d = _stems(spark, sf)
    return d.join(G.seed_cluster(d, ["k"], "x", "sx", "stem", "y", "id", 10.0), ["k", "id"])


def _stems(spark, sf):
    i = F.col("id")
    return ev(spark, sf).select("k", "id", "x", (F.col("x") + i % 3).alias("sx"), F.when(i % 3 == 0, "up").when(i % 3 == 1, "down").alias("stem"), "y", (i % 9).alias("length"))


def _seed_ctes(single):
    """CTEs giving ``sc`` (k, id, seed_id): rows in order meet the groups still open, oldest first."""
    skip = "(st IS NOT NULL AND q.st IS NOT NULL AND st <> q.st)" if single else "false"
    near = f"q.o AND NOT {skip} AND (abs(sx - q.sx) < 5.0 OR abs(x - q.x) < 9.0) AND list_min(list_transform(q.ys, lambda v: abs(v - y))) <= 40.0"
    g = "STRUCT(id BIGINT, x DOUBLE, sx DOUBLE, st VARCHAR, ys DOUBLE[], o BOOLEAN)"
    return f"""{EV}, r AS (SELECT k, id, x, y, x + id % 3 AS sx, CASE id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS st, row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn FROM ev),
 a AS (SELECT DISTINCT k, 0::BIGINT AS rn, []::{g}[] AS gs, NULL::BIGINT AS id, NULL::BIGINT AS seed_id FROM r UNION ALL
 SELECT k, rn, CASE WHEN ix IS NULL THEN list_append(closed, struct_pack(id := id, x := x, sx := sx, st := st, ys := [y], o := true)) ELSE closed END, id, CASE WHEN ix IS NULL THEN id ELSE gs[ix].id END FROM
 (SELECT *, list_transform(range(1, len(gs) + 1), lambda j: CASE WHEN j = ix THEN struct_pack(id := gs[j].id, x := gs[j].x, sx := gs[j].sx, st := gs[j].st, ys := list_append(gs[j].ys, y), o := gs[j].o)
  WHEN (ix IS NULL OR j < ix) AND NOT {skip.replace('q.', 'gs[j].')} AND x - gs[j].x >= 9.0 THEN struct_pack(id := gs[j].id, x := gs[j].x, sx := gs[j].sx, st := gs[j].st, ys := gs[j].ys, o := false) ELSE gs[j] END) AS closed FROM
 (SELECT r.*, gs, list_filter(range(1, len(gs) + 1), lambda j: {near.replace('q.', 'gs[j].')})[1] AS ix FROM a JOIN r ON r.k = a.k AND r.rn = a.rn + 1))),
 sc AS (SELECT k, id, seed_id FROM a WHERE id IS NOT NULL)"""


@query("seed_cluster", f"WITH RECURSIVE {_seed_ctes(False)} SELECT * FROM sc")
def seed_cluster(spark, sf):
    return G.seed_cluster(_stems(spark, sf), ["k"], "x", "sx", "stem", "y", "id", 10.0)


@query("seed_cluster_single", f"WITH RECURSIVE {_seed_ctes(True)} SELECT * FROM sc")
def seed_cluster_single(spark, sf):
    return G.seed_cluster(_stems(spark, sf), ["k"], "x", "sx", "stem", "y", "id", 10.0, single_staff=True)


@query("orphan_merge", f"""WITH RECURSIVE {_seed_ctes(False)}, gm AS (SELECT sc.k AS k, seed_id, list(struct_pack(id := id, x := x, y := y) ORDER BY x, id) AS m FROM sc JOIN ev USING (id) GROUP BY sc.k, seed_id),
 gl AS (SELECT k, list(struct_pack(seed := seed_id, m := m) ORDER BY m[1].x, seed_id) AS gs FROM gm GROUP BY k),
 w AS (SELECT k, 0 AS i, gs FROM gl UNION ALL SELECT k, i + 1, CASE WHEN b IS NULL THEN gs ELSE list_transform(range(1, len(gs) + 1), lambda j: CASE WHEN j = i + 1 THEN struct_pack(seed := gs[j].seed, m := []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[])
 WHEN j = b.j THEN struct_pack(seed := gs[j].seed, m := list_concat(gs[j].m, gs[i + 1].m)) ELSE gs[j] END) END FROM
 (SELECT *, CASE WHEN len(gs[i + 1].m) = 1 THEN list_sort(list_filter(list_transform(list_filter(range(1, len(gs) + 1), lambda j: j <> i + 1 AND len(gs[j].m) >= 2 AND abs(gs[i + 1].m[1].x - list_avg(list_transform(gs[j].m, lambda v: v.x))) < 9.0),
 lambda j: struct_pack(d := list_min(list_transform(gs[j].m, lambda v: abs(v.y - gs[i + 1].m[1].y))), j := j)), lambda q: q.d <= 40.0))[1] END AS b FROM w WHERE i < len(gs))),
 z AS (SELECT k, unnest(gs) AS g FROM w WHERE i = len(gs)), y AS (SELECT k, g.seed AS seed_id, unnest(g.m) AS e FROM z) SELECT k, e.id AS id, seed_id FROM y""")
def orphan_merge(spark, sf):
    return G.orphan_merge(_clusters(spark, sf), ["k"], "seed_id", "x", "y", "stem", "id", 10.0)


@query("group_summary", f"""WITH {EV}, e AS (SELECT *, CAST(floor(x / 12) AS BIGINT) AS g, CASE id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS stem, x + id % 3 AS sx FROM ev),
 a AS (SELECT k, g, avg(x) AS x, count(*) AS n, arg_min((stem, sx), (-(id % 9), id)) FILTER (stem IS NOT NULL) AS b, floor(avg(sx)) AS ms, string_agg(id::VARCHAR, ' ' ORDER BY y DESC, id) AS members FROM e GROUP BY k, g)
 SELECT k, g, round(x, 4) AS x, n, b[1] AS stem, round(CAST(coalesce(b[2], ms) AS DOUBLE), 4) AS stem_x, members FROM a""")
def group_summary(spark, sf):
    d = _stems(spark, sf).withColumn("g", F.floor(F.col("x") / 12))
    out = G.group_summary(d, ["k"], "g", "x", "y", "sx", "stem", "length", "id")
    return out.withColumns({"x": F.round("x", 4), "stem_x": F.round(F.col("stem_x").cast("double"), 4)})


# staves: one per order line, tops and bottoms from the line's running position; tops are rounded as decimals, half up
_STAFF = """st AS (SELECT l_orderkey AS k, pos, top, top + 4.0 AS bottom FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS pos,
 round(CAST(l_extendedprice / 500 AS DECIMAL(18, 5)), 2)::DOUBLE AS top FROM lineitem))"""


def _staves(spark, sf):
    li = table(spark, sf, "lineitem")
    d = S.scan(li, ["l_orderkey"], ["l_extendedprice", "l_partkey"], pos=S.row_number())
    top = F.round(F.col("l_extendedprice") / 500, 2)
    return d.select(F.col("l_orderkey").alias("k"), "pos", top.alias("top"), (top + 4.0).alias("bottom"))


@query("layout_class", f"""WITH {_STAFF}, g AS (SELECT k, lead(top) OVER (PARTITION BY k ORDER BY pos) - bottom AS g FROM st), a AS (SELECT k, count(*) AS n, min(g) AS lo, max(g) AS hi FROM g GROUP BY k)
 SELECT k, CASE WHEN n < 2 THEN 'single' WHEN n < 3 THEN 'grand' WHEN lo > 0 AND hi / lo < 1.6 THEN 'single' ELSE 'grand' END AS layout FROM a""")
def layout_class(spark, sf):
    return G.layout_class(_staves(spark, sf), ["k"], "pos", "top", "bottom")


# the same tops, rounded once from the shortest decimal of the quotient: five places first would round twice
_STAFF_ONCE = _STAFF.replace("CAST(l_extendedprice / 500 AS DECIMAL(18, 5))", "CAST(CAST(l_extendedprice / 500 AS VARCHAR) AS DECIMAL(38, 20))")


@query("pair_consecutive", f"""WITH RECURSIVE {_STAFF_ONCE}, f AS (SELECT k, pos, coalesce(lead(top) OVER w - bottom < (bottom - top) * 4, false) AS fit FROM st WINDOW w AS (PARTITION BY k ORDER BY pos)),
 g AS (SELECT k, 1::BIGINT AS i FROM f WHERE pos = 1 UNION ALL SELECT g.k, CASE WHEN fit THEN i + 2 ELSE i + 1 END FROM g JOIN f ON f.k = g.k AND f.pos = g.i)
 SELECT g.k AS k, i AS first, i + 1 AS second FROM g JOIN f ON f.k = g.k AND f.pos = g.i WHERE fit""")
def pair_consecutive(spark, sf):
    return G.pair_consecutive(_staves(spark, sf), ["k"], "pos", "top", "bottom")


@query("group_boundary", f"""WITH {EV}, e AS (SELECT k % 10 AS page, k, x - 473352 AS x, y / 100 AS s FROM ev), gr AS (SELECT DISTINCT k % 10 AS page, k FROM ev),
 m AS (SELECT e.page, e.k, min(x) AS x FROM e WHERE s >= 0.70 AND x > 40 AND x >= CASE WHEN e.k < 10 THEN 60 ELSE floor(60 * 0.80) END GROUP BY 1, 2)
 SELECT gr.page AS page, gr.k AS k, coalesce(greatest(40, m.x - 10), 60.0) AS boundary FROM gr LEFT JOIN m ON m.k = gr.k""")
def group_boundary(spark, sf):
    d = ev(spark, sf).select((F.col("k") % 10).alias("page"), "k", (F.col("x") - 473352).alias("x"), (F.col("y") / 100).alias("s"))
    g = d.select("page", "k").distinct()
    return G.group_boundary(d, g, ["page"], "k", "x", "s", F.lit(10.0), F.lit(60.0), F.col("k") < 10)
