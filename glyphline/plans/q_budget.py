"""Check queries: reconciliation. Measures are orders, notes their lines placed by price."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import scan as S
from ..core.skew import PART_ROWS, spread
from ..operators import budget as R
from .q_functions import STEPS_SQL
from .registry import EV, ev, query, table

ML = """ml AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber, l_suppkey) AS id,
 l_extendedprice / 1000 AS x, (CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE 0.75 END)::DOUBLE AS dur,
 (l_orderkey % 5 + 4) / 2.0 AS cap, (l_orderkey % 3) * 0.5::DOUBLE AS rb, CASE WHEN l_orderkey % 4 > 0 THEN 110.0::DOUBLE END AS edge, l_partkey % 2 = 0 AS evd FROM lineitem)"""


def snap_sql(v: str) -> str:
    return f"(list_sort(list_transform({STEPS_SQL}, lambda sv: struct_pack(d := abs(sv - ({v})), s := sv)))[1].s)::DOUBLE"


def notes(spark, sf):
    # the rules of a measure are one chain of scans over this exchange
    columns = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    li = S.scan(spread(columns, ["l_orderkey"], part_rows=PART_ROWS), ["l_orderkey"], ["l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey"], id=S.row_number())
    q, o = F.col("l_quantity").cast("int") % 5, F.col("l_orderkey")
    dur = F.when(q == 0, 0.25).when(q.isin(1, 2), 0.5).when(q == 3, 1.0).otherwise(0.75)
    return li.select(o.alias("k"), "id", (F.col("l_extendedprice") / 1000).alias("x"), dur.alias("dur"), ((o % 5 + 4) / 2.0).alias("cap"),
                     ((o % 3) * 0.5).alias("rb"), F.when(o % 4 > 0, 110.0).alias("edge"), (F.col("l_partkey") % 2 == 0).alias("evd"))


@query("pickup_group", f"""WITH {ML}, g AS (SELECT *, count(*) OVER (PARTITION BY k) >= 2 AND min(x) OVER (PARTITION BY k) > 40 * 0.6 AND k % 2 = 0 AS p FROM ml)
 SELECT k, id, x, CASE WHEN p THEN 0.5 ELSE dur END AS duration, 'note_unit' AS type FROM g UNION ALL SELECT DISTINCT k, NULL, 0.0::DOUBLE, 1.0::DOUBLE, 'rest' FROM g WHERE p""")
def pickup_group(spark, sf):
    d = notes(spark, sf).select("k", "id", "x", F.col("dur").alias("duration"))
    return R.pickup_group(d, ["k"], F.lit(40.0), "x", F.col("k") % 2 == 0, ["x", "id"]).select("k", "id", "x", "duration", "type")


@query("single_fill", f"""WITH {ML}, o AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, dur * (1 + k % 3) AS idur FROM ml)
 SELECT k, id, CASE WHEN idur >= 2.0 OR (idur < 1.0 AND (rb > 0 OR evd)) THEN idur ELSE {snap_sql('greatest(0.25, cap - rb)')} END AS duration,
 CASE WHEN idur >= 2.0 THEN 'whole' WHEN idur < 1.0 AND (rb > 0 OR evd) THEN 'beam' ELSE 'single_fill' END AS source FROM o WHERE n = 1""")
def single_fill(spark, sf):
    d = notes(spark, sf).withColumn("idur", F.col("dur") * (1 + F.col("k") % 3))
    return R.single_fill(d, ["k"], ["x", "id"], "idur", "cap", "rb", F.col("evd")).select("k", "id", "duration", "source")


_UP = f"""u AS (SELECT *, sum(dur) OVER w AS t, count(*) OVER w AS n, max(dur) OVER w AS hi, min(dur) OVER w AS lo, bool_and(evd) OVER w AS ae FROM ml WINDOW w AS (PARTITION BY k)),
 v AS (SELECT *, (cap - rb) / n AS tg FROM u), up AS (SELECT * REPLACE (CASE WHEN t + rb < cap - 0.1 AND n >= 2 AND list_contains({STEPS_SQL}::DOUBLE[], tg)
 AND NOT (tg IN (0.75, 1.5, 3.0) AND rb > 0.1) AND NOT (ae AND rb > 0.1) AND hi <= tg + 1e-6 AND lo < tg - 1e-6 THEN tg ELSE dur END AS dur) FROM v)"""


@query("uniform_upgrade", f"WITH {ML}, {_UP} SELECT k, id, dur FROM up")
def uniform_upgrade(spark, sf):
    return R.uniform_upgrade(notes(spark, sf), ["k"], ["x", "id"], "dur", "cap", "rb", F.col("evd")).select("k", "id", "dur")


def walk(name: str, queue: str, groups: str, stop: float) -> str:
    """Recursive hand-out: rows of ``queue`` (k, rn, id, step) take ``step`` while ``stop`` is left of b."""
    return f"""{name} AS (SELECT k, 0::BIGINT AS rn, b AS b, NULL::BIGINT AS id, 0::DOUBLE AS took FROM {groups} UNION ALL
 SELECT q.k, q.rn, CASE WHEN w.b >= {stop} THEN w.b - q.step ELSE w.b END, q.id, CASE WHEN w.b >= {stop} THEN q.step ELSE 0 END FROM {name} w JOIN {queue} q ON q.k = w.k AND q.rn = w.rn + 1)"""


def deficit_sql(src: str, p: str) -> str:
    g = f"coalesce(lead(x) OVER w - x, CASE WHEN edge > x THEN edge - x END, x - lag(x) OVER w, 0)"
    return f"""{p}g AS (SELECT k, id, x, dur, cap, rb, edge, evd, {g} AS gap, count(*) OVER (PARTITION BY k) AS n, sum(dur) OVER (PARTITION BY k) AS t FROM {src} WINDOW w AS (PARTITION BY k ORDER BY x, id)),
 {p}m AS (SELECT k, list_sort(list(gap)) AS gs, CASE WHEN any_value(n) >= 3 AND any_value(t + rb < cap - 0.1) THEN any_value(cap - rb - t) ELSE 0 END AS b FROM {p}g GROUP BY k),
 {p}q1 AS (SELECT g.k AS k, id, least(dur * 2, 4.0) - dur AS step, row_number() OVER (PARTITION BY g.k ORDER BY x, id) AS rn FROM {p}g g JOIN {p}m m ON m.k = g.k WHERE gap > gs[len(gs) // 2 + 1] * 1.25),
 {walk(p + 'w1', p + 'q1', p + 'm', 0.4)},
 {p}d1 AS (SELECT g.* REPLACE (g.dur + coalesce(took, 0) AS dur) FROM {p}g g LEFT JOIN {p}w1 w ON w.k = g.k AND w.id = g.id), {p}b1 AS (SELECT k, arg_max(b, rn) AS b FROM {p}w1 GROUP BY k),
 {p}q2 AS (SELECT k, id, least(dur * 2, 1.0) - dur AS step, row_number() OVER (PARTITION BY k ORDER BY gap DESC, x, id) AS rn FROM {p}d1 WHERE dur <= 0.25),
 {walk(p + 'w2', p + 'q2', p + 'b1', 0.2)},
 {p}d2 AS (SELECT g.* REPLACE (g.dur + coalesce(took, 0) AS dur), b.b AS b FROM {p}d1 g JOIN (SELECT k, arg_max(b, rn) AS b FROM {p}w2 GROUP BY k) b ON b.k = g.k LEFT JOIN {p}w2 w ON w.k = g.k AND w.id = g.id),
 {p}o AS (SELECT * REPLACE (CASE WHEN b BETWEEN 0.4 AND 0.6 AND dur = 0.5 AND row_number() OVER (PARTITION BY k, dur ORDER BY gap DESC, x, id) = 1 THEN 1.0 ELSE dur END AS dur) FROM {p}d2)"""


@query("deficit_alloc", f"WITH RECURSIVE {ML}, {deficit_sql('ml', 'a')} SELECT k, id, dur FROM ao")
def deficit_alloc(spark, sf):
    return R.deficit_alloc(notes(spark, sf), ["k"], "x", "id", "dur", "cap", "rb", "edge").select("k", "id", "dur")


def surplus_sql(src: str, p: str) -> str:
    g = "coalesce(lead(x) OVER w - x, CASE WHEN edge > x THEN edge - x END, 0)"
    first = lambda cond, by: f"CASE WHEN {cond} THEN row_number() OVER (PARTITION BY k, {cond} ORDER BY {by}x, id) END"
    return f"""{p}g AS (SELECT k, id, x, dur, cap, rb, edge, evd, {g} AS gap, count(*) OVER (PARTITION BY k) AS n, sum(dur) OVER (PARTITION BY k) AS t, count(*) FILTER (dur = 0.25) OVER (PARTITION BY k) AS n16
 FROM {src} WINDOW w AS (PARTITION BY k ORDER BY x, id)),
 {p}m AS (SELECT k, any_value(t + rb - cap) AS s0, CASE WHEN any_value(n) >= 3 AND any_value(t + rb - cap) >= 0.2 THEN any_value(t + rb - cap) ELSE -1e9 END AS b, CASE WHEN any_value(n16) >= 2 AND any_value(t + rb - cap) >= 0.45 THEN 0 ELSE 1e9 END AS bar FROM {p}g GROUP BY k),
 {p}q1 AS (SELECT g.k AS k, id, 0.25::DOUBLE AS step, row_number() OVER (PARTITION BY g.k ORDER BY gap, x, id) AS rn FROM {p}g g JOIN {p}m m ON m.k = g.k WHERE dur = 0.5 AND bar = 0),
 {walk(p + 'w1', p + 'q1', p + 'm', 0.2)}, {p}b1 AS (SELECT k, arg_max(b, rn) AS b FROM {p}w1 GROUP BY k),
 {p}d1 AS (SELECT g.* REPLACE (g.dur - coalesce(took, 0) AS dur) FROM {p}g g LEFT JOIN {p}w1 w ON w.k = g.k AND w.id = g.id),
 {p}q2 AS (SELECT k, id, 0.5::DOUBLE AS step, row_number() OVER (PARTITION BY k ORDER BY gap, x, id) AS rn FROM {p}d1 WHERE dur = 1.0),
 {walk(p + 'w2', p + 'q2', p + 'b1', 0.4)}, {p}b2 AS (SELECT k, arg_max(b, rn) AS b FROM {p}w2 GROUP BY k),
 {p}d2 AS (SELECT g.* REPLACE (g.dur - coalesce(took, 0) AS dur), b.b AS b, s0 FROM {p}d1 g JOIN {p}b2 b ON b.k = g.k JOIN {p}m m ON m.k = g.k LEFT JOIN {p}w2 w ON w.k = g.k AND w.id = g.id),
 {p}e AS (SELECT *, lag(dur) OVER v AS pd, lead(dur) OVER v AS nd, lag(x) OVER v AS px, lead(x) OVER v AS nx, count(*) FILTER (dur = 0.25) OVER (PARTITION BY k) AS c16, count(*) FILTER (dur = 1.0) OVER (PARTITION BY k) AS c4,
  count(*) FILTER (dur = 0.75) OVER (PARTITION BY k) AS cd, count(*) FILTER (dur = 0.5) OVER (PARTITION BY k) AS c8 FROM {p}d2 WINDOW v AS (PARTITION BY k ORDER BY x, id)),
 {p}f AS (SELECT *, {first('dur = 1.0', 'gap, ')} AS r4, {first('dur = 0.25', 'gap DESC, ')} AS r16, {first('dur = 0.5', 'gap, ')} AS r8, {first('dur = 0.75', 'gap, ')} AS rd,
  {first('(dur = 0.5 AND c16 = 1 AND (coalesce(pd = 0.25, false) OR coalesce(nd = 0.25, false)))', 'CASE WHEN nd = 0.25 THEN nx - x ELSE x - px END, ')} AS rn_, {first('(dur = 0.5 AND coalesce(pd = 0.75, false))', '')} AS rc FROM {p}e),
 {p}h AS (SELECT *, CASE WHEN NOT b BETWEEN 0.2 AND 0.3 THEN 0 WHEN c4 > 0 AND c16 > 0 THEN 3 WHEN max(rn_) OVER z > 0 THEN 4 WHEN max(rc) OVER z > 0 THEN 5 WHEN cd > 0 AND c16 >= 2 AND c8 > 0 THEN 6 WHEN cd > 0 THEN 7 ELSE 0 END AS rule FROM {p}f WINDOW z AS (PARTITION BY k)),
 {p}o AS (SELECT k, id, x, cap, rb, edge, evd, CASE WHEN rule = 3 AND (r4 = 1 OR r16 = 1) THEN 0.5 WHEN rule = 4 AND rn_ = 1 THEN 0.25 WHEN rule = 5 AND rc = 1 THEN 0.25 WHEN rule = 6 AND r8 = 1 THEN 0.25 WHEN rule = 7 AND rd = 1 THEN 0.5 ELSE dur END AS dur,
  CASE WHEN b < -1e8 THEN s0 ELSE b END - CASE WHEN rule > 0 THEN 0.25 ELSE 0 END AS surplus FROM {p}h)"""


@query("surplus_reduce", f"WITH RECURSIVE {ML}, {surplus_sql('ml', 'a')} SELECT k, id, dur, round(surplus, 6) AS surplus FROM ao")
def surplus_reduce(spark, sf):
    out = R.surplus_reduce(notes(spark, sf), ["k"], "x", "id", "dur", "cap", "rb", "edge")
    return out.select("k", "id", "dur", F.round("surplus", 6).alias("surplus"))


def swap_sql(src: str, p: str) -> str:
    """Swap one pair at a time over an array per measure until none qualifies."""
    g = "coalesce(lead(x) OVER w - x, CASE WHEN edge > x THEN edge - x END, 0)"
    pick = lambda lst, f: f"list_filter(list_transform(range(1, len(ds) + 1), lambda i: struct_pack(g := {lst}, i := i, ok := {f})), lambda e: e.ok)"
    s16 = pick("-gs[i]", "ds[i] = 0.25 AND NOT (i > 1 AND abs(coalesce(ds[i - 1], 0) - 0.75) < 0.01)")
    s8 = pick("gs[i]", "ds[i] = 0.5")
    return f"""{p}g AS (SELECT k, id, x, dur, surplus, {g} AS gap, row_number() OVER w AS pos, count(*) OVER (PARTITION BY k) AS n FROM {src} WINDOW w AS (PARTITION BY k ORDER BY x, id)),
 {p}l AS (SELECT k, 0 AS it, list(dur ORDER BY pos) AS ds, list(gap ORDER BY pos) AS gs, true AS more FROM {p}g WHERE n >= 3 AND abs(surplus) < 0.1 GROUP BY k
 UNION ALL SELECT k, it + 1, CASE WHEN sw THEN list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i = a.i THEN 0.5 WHEN i = b.i THEN 0.25 ELSE ds[i] END) ELSE ds END, gs, sw FROM
 (SELECT *, coalesce(-a.g > b.g * 1.2, false) AS sw FROM (SELECT k, it, ds, gs, list_sort({s16})[1] AS a, list_sort({s8})[1] AS b FROM {p}l WHERE more))),
 {p}z AS (SELECT k, arg_max(ds, it) AS ds FROM {p}l GROUP BY k),
 {p}o AS (SELECT g.k AS k, g.id AS id, g.x AS x, coalesce(z.ds[g.pos], g.dur)::DOUBLE AS dur FROM {p}g g LEFT JOIN {p}z z ON z.k = g.k)"""


_SW = "sw AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0.2 ELSE 0.0 END AS surplus FROM ml)"


@query("swap_fixpoint", f"WITH RECURSIVE {ML}, {_SW}, {swap_sql('sw', 'a')} SELECT k, id, dur FROM ao")
def swap_fixpoint(spark, sf):
    d = notes(spark, sf).withColumn("surplus", F.when(F.col("k") % 3 == 0, 0.2).otherwise(0.0))
    return R.swap_fixpoint(d, ["k"], "x", "id", "dur", "surplus", "edge").select("k", "id", "dur")


# all rules in turn, as one job
@query("provenance_tag", f"""WITH RECURSIVE {ML}, {_UP}, lead_ AS (SELECT k FROM ml GROUP BY k HAVING count(*) >= 2 AND (any_value(cap) > 2.5 OR abs(sum(dur) + any_value(rb) - any_value(cap)) < 0.1 OR bool_or(abs(dur - 0.75) < 0.01))),
 l0 AS (SELECT up.* FROM up JOIN lead_ ON lead_.k = up.k), {deficit_sql('l0', 'a')}, {surplus_sql('ao', 'b')}, {swap_sql('bo', 'c')}
 SELECT co.k AS k, co.id AS id, co.dur AS dur, CASE WHEN ml.dur = co.dur THEN 'beam' ELSE 'beam_rescue' END AS source FROM co JOIN ml ON ml.k = co.k AND ml.id = co.id""")
def provenance_tag(spark, sf):
    d = R.measure_budget(notes(spark, sf), ["k"], "x", "id", "dur", "cap", "rb", "edge", F.col("evd"))
    return d.select("k", "id", "dur", "source")


@query("proportional_alloc", f"""WITH {ML}, g AS (SELECT *, lead(x) OVER w - x AS g, x - lag(x) OVER w AS pg, greatest(0.25, cap - rb) AS rem, count(*) OVER (PARTITION BY k) AS n, id % 4 = 0 AS h, max(x) OVER (PARTITION BY k) = min(x) OVER (PARTITION BY k) AS flat FROM ml WINDOW w AS (PARTITION BY k ORDER BY x, id)),
 md AS (SELECT k, list_sort(list(g) FILTER (g IS NOT NULL)) AS gs FROM g GROUP BY k),
 p AS (SELECT g.*, CASE WHEN g IS NOT NULL THEN g WHEN n > 2 AND gs[len(gs) // 2 + 1] > 0 AND edge > x AND edge - x BETWEEN gs[len(gs) // 2 + 1] * 0.3 AND gs[len(gs) // 2 + 1] * 3.0 THEN edge - x ELSE coalesce(pg, 0) END AS gap FROM g JOIN md ON md.k = g.k WHERE n >= 2),
 s AS (SELECT *, {snap_sql('gap / nullif(sg, 0) * rem')} AS s FROM (SELECT *, sum(gap) OVER (PARTITION BY k) AS sg, bool_and(h) OVER (PARTITION BY k) AS allh, row_number() OVER (PARTITION BY k ORDER BY gap DESC, x, id) AS r FROM p)),
 t AS (SELECT *, sum(s) OVER (PARTITION BY k) AS st FROM s)
 SELECT k, id, CASE WHEN allh OR (flat AND h) THEN dur WHEN flat THEN {snap_sql('rem / n')} WHEN abs(rem - st) > 0.1 AND r = 1 THEN {snap_sql('s + rem - st')} ELSE s END AS duration FROM t""")
def proportional_alloc(spark, sf):
    d = notes(spark, sf).withColumn("rem", F.greatest(F.lit(0.25), F.col("cap") - F.col("rb")))
    return R.proportional_alloc(d, ["k"], "x", "id", "rem", "edge", F.col("id") % 4 == 0, "dur").select("k", "id", "duration")


# every choice of plain lengths, one note at a time, and the cheapest
@query("dotted_decompose", f"""WITH RECURSIVE {ML}, e AS (SELECT k, id, x, dur, x / sum(x) OVER (PARTITION BY k) * cap AS raw, cap, count(*) OVER (PARTITION BY k) AS n FROM ml),
 o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn FROM e),
 c AS (SELECT k, 0::BIGINT AS rn, 0.0::DOUBLE AS acc, 0.0::DOUBLE AS cost, []::DOUBLE[] AS path FROM o WHERE rn = 1 UNION ALL
 SELECT c.k, o.rn, acc + v, cost + pow(v - raw, 2) + CASE WHEN v <> dur THEN 0.05 ELSE 0 END, list_append(path, v) FROM c JOIN o ON o.k = c.k AND o.rn = c.rn + 1, (SELECT unnest([0.25, 0.5, 1.0, 2.0]::DOUBLE[]) AS v)
 WHERE acc + v + (n - o.rn) * 0.25 <= cap + 0.01),
 b AS (SELECT * FROM c JOIN (SELECT k AS bk, n, cap FROM o WHERE rn = 1) ON bk = k AND c.rn = n AND abs(acc - cap) < 0.01 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(cost, 9), path) = 1)
 SELECT o.k AS k, o.id AS id, path[o.rn] AS plain FROM b JOIN o ON o.k = b.k""")
def dotted_decompose(spark, sf):
    d = notes(spark, sf)
    d = S.scan(d, ["k"], ["x", "id"], sx=S.total("sum", "x")).withColumn("raw", F.col("x") / F.col("sx") * F.col("cap"))
    return R.dotted_decompose(d, ["k"], ["x", "id"], "raw", F.array("dur"), "cap").select("k", "id", "plain")


_NW = f"""{EV}, pl AS (SELECT k, id, x, row_number() OVER (PARTITION BY k ORDER BY x, id) AS pos, count(*) OVER (PARTITION BY k) AS sz FROM ev WHERE typ IN ('view', 'click')),
 mk AS (SELECT k, id AS mid, x AS mx, CASE WHEN id % 2 = 0 THEN 3 ELSE 6 END AS n FROM ev WHERE typ = 'signup'),
 an AS (SELECT mk.*, pos, sz FROM mk JOIN pl ON pl.k = mk.k QUALIFY row_number() OVER (PARTITION BY mid ORDER BY abs(x - mx), pos) = 1),
 st AS (SELECT *, unnest(CASE WHEN sz <= n THEN [1::BIGINT] ELSE range(greatest(1, pos - n + 1), least(pos, sz - n + 1) + 1) END) AS s FROM an),
 sc AS (SELECT st.k, mid, n, s, any_value(mx) AS mx, sum(pl.x) / any_value(n) AS c FROM st JOIN pl ON pl.k = st.k AND pl.pos >= s AND pl.pos < s + n GROUP BY st.k, mid, n, s),
 bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY mid ORDER BY abs(c - mx), s) = 1)"""


@query("nearest_n_window", f"WITH {_NW} SELECT bs.k AS k, mid, id FROM bs JOIN pl ON pl.k = bs.k AND pl.pos >= s AND pl.pos < s + n")
def nearest_n_window(spark, sf):
    mk = ev(spark, sf, "signup").select("k", F.col("id").alias("mid"), F.col("x").alias("mx"), F.when(F.col("id") % 2 == 0, 3).otherwise(6).alias("n"))
    return R.nearest_n_window(ev(spark, sf, "view", "click"), mk, ["k"], "x", "id", "mx", "n", "mid")


# the first of base, base / 2, base / 4, … that fits
_HALVES = """h7 AS (SELECT * REPLACE (base / pow(2, list_filter(range(0, 64), lambda i: NOT (base / pow(2, i) * 2.0 / 3.0 * nt + (na - nt) * 0.25 + rb > cap + 0.1 AND base / pow(2, i) > 0.125))[1]) AS base) FROM h0)"""


@query("choose_interpretation", f"""WITH {ML}, mk AS (SELECT o_orderkey AS k, o_totalprice / 5000 AS mx FROM orders),
 nt AS MATERIALIZED (SELECT ml.*, mx, CASE WHEN id % 3 = 0 THEN [dur, 0.5] ELSE [dur] END AS ds FROM ml JOIN mk ON mk.k = ml.k), rd AS MATERIALIZED (SELECT nt.*, r AS rd FROM nt, range(2) t(r)),
 pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, rd ORDER BY x, id) AS pos, count(*) OVER (PARTITION BY k, rd) AS sz FROM rd WHERE rd = 1 OR id % 3 <> 0),
 an AS MATERIALIZED (SELECT k, rd, mx, pos, sz FROM pl QUALIFY row_number() OVER (PARTITION BY k, rd ORDER BY abs(x - mx), pos) = 1),
 st AS (SELECT *, unnest(CASE WHEN sz <= 3 THEN [1::BIGINT] ELSE range(greatest(1, pos - 2), least(pos, sz - 2) + 1) END) AS s FROM an),
 sc AS MATERIALIZED (SELECT st.k AS k, st.rd AS rd, s, sum(x) / 3 AS c, any_value(st.mx) AS mx FROM st JOIN pl ON pl.k = st.k AND pl.rd = st.rd AND pl.pos >= s AND pl.pos < s + 3 GROUP BY st.k, st.rd, s),
 bs AS MATERIALIZED (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY k, rd ORDER BY abs(c - mx), s) = 1),
 ids AS MATERIALIZED (SELECT pl.k AS k, pl.rd AS rd, pl.id AS id FROM bs JOIN pl ON pl.k = bs.k AND pl.rd = bs.rd AND pl.pos >= s AND pl.pos < s + 3),
 al AS MATERIALIZED (SELECT rd.*, ids.id IS NOT NULL AS inn FROM rd JOIN (SELECT DISTINCT k AS gk, rd AS gr FROM ids) ON gk = rd.k AND gr = rd.rd LEFT JOIN ids ON ids.k = rd.k AND ids.rd = rd.rd AND ids.id = rd.id),
 mb AS (SELECT k, rd, x, id, unnest(ds) AS v, unnest(range(len(ds))) AS p FROM al WHERE inn),
 md AS MATERIALIZED (SELECT k, rd, v AS base FROM (SELECT k, rd, v, count(*) AS c, min((x, id, p)) AS f FROM mb GROUP BY k, rd, v) QUALIFY row_number() OVER (PARTITION BY k, rd ORDER BY c DESC, f) = 1),
 h0 AS MATERIALIZED (SELECT al.k AS k, al.rd AS rd, any_value(md.base) AS base, count(*) FILTER (inn) AS nt, count(*) AS na, any_value(rb) AS rb, any_value(cap) AS cap FROM al JOIN md ON md.k = al.k AND md.rd = al.rd GROUP BY al.k, al.rd),
 {_HALVES}, t1 AS (SELECT *, base * 2.0 / 3.0 AS td FROM h7), t2 AS (SELECT *, CASE WHEN na > nt THEN {snap_sql('greatest(0.25, cap - td * nt - rb) / (na - nt)')} END AS ld FROM t1),
 w AS (SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(td * nt + coalesce(ld * (na - nt), 0) + rb - cap), rd) = 1)
 SELECT al.k AS k, al.id AS id, round(CASE WHEN inn THEN td ELSE ld END, 9) AS duration, CASE WHEN inn THEN 'tuplet' ELSE 'tuplet_leftover' END AS source FROM al JOIN w ON w.k = al.k AND w.rd = al.rd""")
def choose_interpretation(spark, sf):
    d = notes(spark, sf)
    d = d.withColumn("idurs", F.when(F.col("id") % 3 == 0, F.array("dur", F.lit(0.5))).otherwise(F.array("dur")))
    mk = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("mid"), (F.col("o_totalprice") / 5000).alias("mx"), F.lit(3).alias("n"))
    out = R.choose_interpretation(d, mk, ["k"], "x", "id", "idurs", "rb", "cap", "mx", "n", "mid")
    return out.withColumn("duration", F.round("duration", 9))


@query("overflow_prune", f"""WITH RECURSIVE {ML}, s AS (SELECT *, id % 2 = 0 AS sus, sum(dur) OVER (PARTITION BY k) AS t, count(*) OVER (PARTITION BY k) AS n, count(*) FILTER (id % 2 = 0) OVER (PARTITION BY k) AS ns, row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn FROM ml),
 g AS (SELECT k, 0::BIGINT AS rn, NULL::BIGINT AS id, t AS now, true AS keep FROM (SELECT DISTINCT k, t FROM s) UNION ALL
 SELECT s.k, s.rn, s.id, CASE WHEN drp THEN now - dur ELSE now END, NOT drp FROM (SELECT g.k AS gk, g.now AS now, s.*, s.sus AND s.t > s.cap * 1.2 AND NOT (ns = n AND n >= 2) AND abs(now - dur - cap) < abs(now - cap) AS drp FROM g JOIN s ON s.k = g.k AND s.rn = g.rn + 1) s)
 SELECT k, id FROM g WHERE id IS NOT NULL AND keep""")
def overflow_prune(spark, sf):
    return R.overflow_prune(notes(spark, sf), ["k"], ["x", "id"], "id", "dur", F.col("id") % 2 == 0, "cap")


@query("dominant_drop", f"""WITH {ML} SELECT k, id FROM (SELECT *, max(dur * 4) FILTER (id % 3 <> 0) OVER (PARTITION BY k) AS hi FROM ml) WHERE NOT (id % 3 = 0 AND coalesce(hi >= 3.5, false))""")
def dominant_drop(spark, sf):
    return R.dominant_drop(notes(spark, sf), ["k"], ["x", "id"], F.col("dur") * 4, F.col("id") % 3 == 0).select("k", "id")


_FIT = f"list_filter({STEPS_SQL}::DOUBLE[], lambda sv: sv > d AND sv <= d + now + 0.01)"


@query("rest_adjust", f"""WITH RECURSIVE {ML}, e AS (SELECT k, id, x, dur AS d, id % 2 = 0 AS r, cap + 1 AS cap, edge FROM ml),
 g0 AS (SELECT k, coalesce(sum(d) FILTER (NOT r), 0) AS nb, sum(d) FILTER (r) AS rb, count(*) FILTER (r) AS n, count(*) FILTER (NOT r) AS nn, min(x) FILTER (r) AS fx, any_value(cap) AS cap, any_value(edge) AS edge FROM e GROUP BY k),
 g1 AS (SELECT *, cap - nb AS rem, cap - nb - rb AS gap, (SELECT max(x) FROM e WHERE e.k = g0.k AND NOT r AND e.x < fx) AS px FROM g0 WHERE n > 0 AND cap - nb > 0),
 g2 AS (SELECT *, {snap_sql('gap')} AS sg FROM g1), g AS (SELECT *, coalesce(abs(gap - sg) < 0.01 AND nn > 0 AND fx - px > 5, false) AS put FROM g2),
 ins AS (SELECT k, -1::BIGINT AS id, floor((px + fx) / 2) AS x, sg AS d FROM g WHERE put), rs AS (SELECT e.k AS k, id, x, d FROM e JOIN g ON g.k = e.k WHERE r UNION ALL SELECT * FROM ins),
 sp AS (SELECT k, x FROM e UNION ALL SELECT k, x FROM ins),
 q AS (SELECT rs.*, rem, edge, n + put::INT AS n, rb + CASE WHEN put THEN sg ELSE 0 END AS total, coalesce(coalesce((SELECT min(x) FROM sp WHERE sp.k = rs.k AND sp.x > rs.x + 1), edge) - rs.x, 0) AS span FROM rs JOIN g ON g.k = rs.k),
 o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, -span, x, id) AS rn FROM q),
 t AS (SELECT k, 0::BIGINT AS rn, any_value(CASE WHEN rem - total > 0 AND rem - total <= 3.5 THEN rem - total ELSE 0 END)::DOUBLE AS now, NULL::BIGINT AS id, NULL::DOUBLE AS trial FROM o GROUP BY k UNION ALL
 SELECT k, rn, CASE WHEN fit IS NULL THEN now ELSE now - (fit - d) END, id, coalesce(fit, d) FROM (SELECT o.k AS k, o.rn AS rn, o.id AS id, o.d AS d, now, CASE WHEN now > 0.01 THEN {_FIT}[-1] END AS fit FROM t JOIN o ON o.k = t.k AND o.rn = t.rn + 1)),
 u AS (SELECT o.*, trial, sum(trial) OVER (PARTITION BY o.k) AS tt, row_number() OVER (PARTITION BY o.k ORDER BY x, o.id) AS pos FROM o JOIN t ON t.k = o.k AND t.id = o.id),
 v AS (SELECT *, abs(tt - rem) < abs(total - rem) AS better, {snap_sql('rem / n')} AS per FROM u), v2 AS (SELECT *, abs(per * n - rem) < abs(CASE WHEN better THEN tt ELSE total END - rem) AS eq FROM v),
 y AS (SELECT *, better OR (n > 1 AND abs(CASE WHEN eq THEN per * n WHEN better THEN tt ELSE total END - rem) < 0.01) AS tidy, CASE WHEN eq THEN per WHEN better THEN trial ELSE d END AS val FROM v2),
 z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY val, pos) AS srt FROM y)
 SELECT a.k AS k, CASE WHEN a.id >= 0 THEN a.id END AS id, a.x AS x, CASE WHEN a.tidy THEN b.val ELSE a.val END AS duration, CASE WHEN a.id < 0 THEN 'gap_insert' ELSE 'rest_detected' END AS source FROM z a JOIN z b ON a.k = b.k AND a.pos = b.srt""")
def rest_adjust(spark, sf):
    d = notes(spark, sf)
    return R.rest_adjust(d, ["k"], "x", "id", F.col("id") % 2 == 0, "dur", F.col("cap") + 1, "edge", 2.0)


@query("gap_fill", f"""WITH RECURSIVE {ML}, m AS (SELECT k, sum(dur) + any_value(rb) AS st, any_value(cap) AS cap, max(x) + 1 AS a, k % 7 = 0 AND max(x) < 60 AS narrow FROM ml GROUP BY k),
 f AS (SELECT k, a, 0::BIGINT AS i, CASE WHEN k % 7 = 0 THEN 0 ELSE st END::DOUBLE AS pos, CASE WHEN k % 7 = 0 THEN cap ELSE cap - st END::DOUBLE AS rem, NULL::DOUBLE AS d FROM m WHERE CASE WHEN k % 7 = 0 THEN cap ELSE cap - st END >= 0.2 AND NOT narrow
 UNION ALL SELECT k, a, i + 1, pos + c, rem - c, c FROM (SELECT *, CASE WHEN r >= 1.0 THEN 1.0 WHEN r >= 0.5 THEN 0.5 WHEN r >= 0.25 THEN 0.25 END AS c FROM
 (SELECT *, least(CASE WHEN pos - floor(pos) > 0.01 THEN 1.0 - (pos - floor(pos)) ELSE 1.0 END, 1.0, rem) + 0.01 AS r FROM f WHERE rem > 0.2)) WHERE c IS NOT NULL)
 SELECT k, i - 1 AS i, a + i - 1 AS x, d AS duration FROM f WHERE i > 0""")
def gap_fill(spark, sf):
    m = notes(spark, sf).groupBy("k").agg(F.sum("dur").alias("t"), F.first("rb").alias("rb"), F.first("cap").alias("cap"), F.max("x").alias("hi"))
    st = F.col("t") + F.col("rb")
    empty = F.col("k") % 7 == 0
    m = m.withColumns({"start": F.when(empty, 0.0).otherwise(st), "gap": F.when(empty, F.col("cap")).otherwise(F.col("cap") - st),
                       "anchor": F.col("hi") + 1, "width": F.when(F.col("hi") < 60, 0.0).otherwise(1e9)})
    out = R.gap_fill(m, ["k"], "start", "gap", "anchor", "width", "cap", empty, 1.0)
    return out.withColumn("i", F.col("i").cast("long"))


@query("expand_count", """WITH m AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS l, CAST(l_quantity AS BIGINT) % 7 AS n FROM lineitem),
 c AS (SELECT *, unnest(range(0, CASE WHEN n >= 5 THEN 1 ELSE n END)) AS copy FROM m WHERE n >= 2)
 SELECT k, ln, pk, sk, copy, 'rest' AS type, 1.0::DOUBLE AS duration, NULL::BIGINT AS n, l + 1 + copy * 1000 + i AS x FROM c, range(2) r(i)
 UNION ALL SELECT k, ln, pk, sk, copy, 'multi_rest_count', NULL, n, l FROM c WHERE n >= 5""")
def expand_count(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
                  F.col("l_extendedprice").alias("l"), (F.col("l_quantity").cast("long") % 7).alias("c"))
    return R.expand_count(m, ["k", "ln", "pk", "sk"], "c", F.lit(2.0), "l")


@query("clean_then_dedupe", f"""WITH RECURSIVE {EV}, n AS (SELECT k, x FROM ev WHERE typ IN ('view', 'click')),
 r AS (SELECT id, k, x, row_number() OVER (PARTITION BY k ORDER BY x, id) AS rn FROM ev e WHERE typ = 'error' AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = e.k AND abs(n.x - e.x) < 4.5)
 AND NOT coalesce((SELECT min(x) FROM n WHERE n.k = e.k AND n.x > e.x) - (SELECT max(x) FROM n WHERE n.k = e.k AND n.x < e.x) < 15, false)),
 g AS (SELECT k, rn, id, x AS lx, true AS keep FROM r WHERE rn = 1 UNION ALL SELECT r.k, r.rn, r.id, CASE WHEN r.x - lx >= 6 THEN r.x ELSE lx END, r.x - lx >= 6 FROM g JOIN r ON r.k = g.k AND r.rn = g.rn + 1)
 SELECT k, id, lx AS x FROM g WHERE keep""")
def clean_then_dedupe(spark, sf):
    return R.clean_then_dedupe(ev(spark, sf, "error"), ev(spark, sf, "view", "click"), ["k"], "x", "id", 3.0)
