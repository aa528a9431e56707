"""Check queries: sources, sinks, evaluation and confidence.

The tables hold no notation, so the queries first rewrite text lines into notation files:
every few lines become section heads, the others bars around the line's own words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import scan as S
from ..functions import scalar as N
from ..operators import aggregates as A
from ..operators import confidence as C
from ..operators import evaluation as E
from ..operators import joins as J
from ..sources import notation as T
from ..sources import tables as B
from .q_functions import SUFFIX_SQL
from .registry import EV, LN, ev, lines, query, table

STRIP = lambda s: f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


@query("page_no_from_url", """SELECT page_id, url, CAST(nullif(regexp_extract(url, '/(\\d+)([./?#]|$)', 1), '') AS INT) AS page FROM pages
 WHERE regexp_extract(url, '/(\\d+)([./?#]|$)', 1) <> ''""")
def page_no_from_url(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "url").withColumn("page", B.page_number(F.col("url"), r"/(\d+)([./?#]|$)"))
    return d.filter(F.col("page").isNotNull())


@query("quarantine_split", f"""SELECT event_id, user_id, right(props, 6) AS err, true AS failed FROM events WHERE event_type = 'error'
 UNION ALL SELECT event_id, user_id, props, false FROM events WHERE event_type <> 'error'""")
def quarantine_split(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", F.col("props").alias("err"), "event_type")
    good, bad = B.quarantine(d, F.col("event_type") == "error", "err", 6)
    out = bad.withColumn("failed", F.lit(True)).unionByName(good.withColumn("failed", F.lit(False)))
    return out.drop("event_type")


_TRUTH = f"""{LN}, src AS (SELECT d, n, CASE n % 8 WHEN 0 THEN CASE WHEN d % 4 = 0 THEN '高音部分 (line=' || (n // 8 + 1) || '):' WHEN d % 4 = 1 THEN 'line ' || (n // 8 + 1) || ': 4/4'
 WHEN d % 4 = 2 THEN '--- 第' || (n // 8 + 1) || '行 ---' WHEN (n // 8) % 2 = 1 THEN 'Line ' || (n // 8 + 1) || ':' ELSE 'line ' || (n // 8 + 1) || ':(undone)' END
 WHEN 5 THEN CASE WHEN d % 2 = 0 THEN '空三拍' ELSE '|空一拍|' END ELSE '|' || line || '(1.5拍) (x)|' END AS t FROM ln)"""


def _truth_lines(spark, sf):
    n, d = F.col("n"), F.col("d")
    no = (F.floor(n / 8) + 1).cast("string")
    head = (F.when(d % 4 == 0, F.concat(F.lit("高音部分 (line="), no, F.lit("):"))).when(d % 4 == 1, F.concat(F.lit("line "), no, F.lit(": 4/4")))
            .when(d % 4 == 2, F.concat(F.lit("--- 第"), no, F.lit("行 ---")))
            .when(F.floor(n / 8) % 2 == 1, F.concat(F.lit("Line "), no, F.lit(":"))).otherwise(F.concat(F.lit("line "), no, F.lit(":(undone)"))))
    t = F.when(n % 8 == 0, head).when(n % 8 == 5, F.when(d % 2 == 0, "空三拍").otherwise("|空一拍|")).otherwise(
        F.concat(F.lit("|"), "line", F.lit("(1.5拍) (x)|")))
    return lines(spark, sf).select(d.alias("doc"), "n", t.alias("line"))


@query("sections_from_text", f"""WITH {_TRUTH}, h AS (SELECT *, CASE WHEN n % 8 = 0 THEN CASE WHEN t LIKE '%undone%' THEN -1 ELSE n // 8 + 1 END END AS sec FROM src),
 s AS (SELECT d, n, t, last_value(sec IGNORE NULLS) OVER (PARTITION BY d ORDER BY n) AS sec FROM h), b AS (SELECT * FROM s WHERE n % 8 <> 0 AND sec > 0),
 p AS (SELECT d, n, sec, CASE WHEN t = '空三拍' THEN ['0 0 0 0', '0 0 0 0', '0 0 0 0'] WHEN t = '|空一拍|' THEN ['0---'] ELSE list_filter(list_transform(list_filter(list_transform(string_split({STRIP("t")}, '|'),
 lambda v: {STRIP("v")}), lambda v: v <> ''), lambda v: {STRIP("regexp_replace(regexp_replace(v, '\\(1\\.5拍\\)', '.', 'g'), '\\([^)]*\\)', '', 'g')")}), lambda v: v <> '') END AS parts FROM b),
 u AS (SELECT d, n, sec, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
 SELECT d AS doc, CASE WHEN d % 4 = 0 THEN 'treble' ELSE 'solo' END AS clef, sec AS line, row_number() OVER (PARTITION BY d, sec ORDER BY n, i) AS measure_no, parts[i] AS text FROM u""")
def sections_from_text(spark, sf):
    return T.read_truth(_truth_lines(spark, sf))


_OUT = f"""{LN}, src AS (SELECT d, n, CASE WHEN n % 9 = 0 THEN '--- 第' || (n // 9 + 1) || '行 ---' WHEN n % 9 = 1 AND d % 2 = 0 THEN '高音: | ' || line || ' |'
 WHEN n % 9 = 4 THEN '低音: | ' || line || ' |' WHEN n % 9 = 7 AND d % 3 = 0 THEN '======' ELSE '|' || line || '|' END AS t FROM ln)"""


@query("sections_reset", f"""WITH {_OUT}, h AS (SELECT *, CASE WHEN n % 9 = 0 THEN n // 9 + 1 WHEN t = '======' THEN 0 END AS sec, CASE WHEN n % 9 = 0 OR t = '======' THEN 'solo' WHEN n % 9 = 1 AND d % 2 = 0 THEN 'treble' WHEN n % 9 = 4 THEN 'bass' END AS c FROM src),
 s AS (SELECT d, n, t, last_value(sec IGNORE NULLS) OVER w AS sec, last_value(c IGNORE NULLS) OVER w AS clef FROM h WINDOW w AS (PARTITION BY d ORDER BY n)),
 p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '^(高音|低音):', ''), '|'), lambda v: {STRIP("v")}), lambda v: v <> '') AS parts FROM s WHERE n % 9 <> 0 AND sec > 0),
 u AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)
 SELECT d AS doc, clef, sec AS line, row_number() OVER (PARTITION BY d, clef, sec ORDER BY n, i) AS measure_no, parts[i] AS text FROM u""")
def sections_reset(spark, sf):
    n, d = F.col("n"), F.col("d")
    bar = lambda label: F.concat(F.lit(label + ": | "), "line", F.lit(" |"))
    t = (F.when(n % 9 == 0, F.concat(F.lit("--- 第"), (F.floor(n / 9) + 1).cast("string"), F.lit("行 ---"))).when((n % 9 == 1) & (d % 2 == 0), bar("高音"))
         .when(n % 9 == 4, bar("低音")).when((n % 9 == 7) & (d % 3 == 0), "======").otherwise(F.concat(F.lit("|"), "line", F.lit("|"))))
    return T.read_output(lines(spark, sf).select(d.alias("doc"), "n", t.alias("line")))


_MEAS = """m AS (SELECT l_suppkey % 10 AS doc, CASE WHEN l_suppkey % 2 = 0 THEN 'solo' WHEN l_linenumber % 2 = 0 THEN 'treble' ELSE 'bass' END AS clef, CAST(l_orderkey AS INT) AS line, l_quantity::INT::VARCHAR AS text,
 row_number() OVER (PARTITION BY l_suppkey % 10, CASE WHEN l_suppkey % 2 = 0 THEN 'solo' WHEN l_linenumber % 2 = 0 THEN 'treble' ELSE 'bass' END, l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) AS no FROM lineitem)"""


@query("notation_lines", f"""WITH {_MEAS}, g AS (SELECT doc, bool_or(clef <> 'solo') AS g FROM m GROUP BY doc)
 SELECT doc, 1 AS block, line, CASE WHEN clef = 'bass' THEN 2 ELSE 1 END AS part, no AS measure_no, CASE WHEN no = 1 AND clef = 'treble' THEN '高音: ' WHEN no = 1 AND clef = 'bass' THEN '低音: ' ELSE '' END || '|' || text || '|' AS text FROM m
 UNION ALL SELECT DISTINCT doc, 1, line, 0, 0, '--- 第' || line || '行 ---' FROM m
 UNION ALL SELECT doc, b, l, 0, 0, t FROM g, (VALUES (0, 0, '简谱翻译结果'), (0, 1, repeat('=', 60)), (2, 0, repeat('=', 60))) v(b, l, t)
 UNION ALL SELECT doc, b, 0, 0, 0, t FROM g, (VALUES (3, '高音部分:'), (4, '低音部分:')) v(b, t) WHERE g
 UNION ALL SELECT doc, CASE WHEN clef = 'bass' THEN 4 ELSE 3 END, line, 1, no, '|' || text || '|' FROM m WHERE clef <> 'solo'""")
def notation_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    clef = F.when(F.col("l_suppkey") % 2 == 0, "solo").when(F.col("l_linenumber") % 2 == 0, "treble").otherwise("bass")
    d = li.select((F.col("l_suppkey") % 10).alias("doc"), clef.alias("clef"), F.col("l_orderkey").cast("int").alias("line"),
                  F.col("l_quantity").cast("int").cast("string").alias("text"), "l_partkey", "l_linenumber", "l_extendedprice")
    d = S.scan(d, ["doc", "clef", "line"], ["l_partkey", "l_linenumber", "l_extendedprice"], measure_no=S.row_number())
    return T.notation_lines(d.withColumn("measure_no", F.col("measure_no").cast("int")))


@query("strip_header_concat", f"""WITH {LN}, src AS (SELECT source AS score, d AS page, n, CASE WHEN n % 6 = 3 THEN '--- 第' || n || '行 ---' ELSE line END AS t FROM ln JOIN documents ON doc_id = d WHERE d % 13 <> 0),
 f AS (SELECT score, page, min(n) AS b FROM src WHERE starts_with(t, '---') OR starts_with(t, '|') GROUP BY 1, 2),
 k AS (SELECT src.* FROM src LEFT JOIN f USING (score, page) WHERE b IS NULL OR n >= b),
 r AS (SELECT *, sum(CASE WHEN n % 6 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY score ORDER BY page, n) AS no FROM k)
 SELECT score, page, n, CASE WHEN n % 6 = 3 THEN '--- 第' || no || '行 ---' ELSE t END AS text FROM r
 UNION ALL SELECT source, doc_id, n, t FROM documents, LATERAL (VALUES (-3, repeat('#', 60)), (-2, '# 第 ' || doc_id || ' 页'), (-1, repeat('#', 60))) v(n, t) WHERE doc_id % 13 <> 0""")
def strip_header_concat(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("score"), F.col("doc_id").alias("page"), "text")
    n = F.col("n")
    l = docs.select("score", "page", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    l = l.select("score", "page", "n", F.when(n % 6 == 3, F.concat(F.lit("--- 第"), n.cast("string"), F.lit("行 ---"))).otherwise(F.col("line")).alias("text"))
    p = docs.select("score", "page", F.when(F.col("page") % 13 == 0, "failed").otherwise("ok").alias("status"))
    return T.concat_pages(l, p)


@query("unit_text", f"""WITH {EV}, g AS (SELECT k, CAST(floor(x / 6) AS BIGINT) AS g, list((id % 7 + 1)::VARCHAR ORDER BY x, id) AS n, any_value(k % 9) / 4.0::DOUBLE AS d FROM ev GROUP BY 1, 2)
 SELECT k, g, CASE WHEN len(n) = 1 THEN n[1] ELSE '[' || array_to_string(n, ' ') || ']' END || {SUFFIX_SQL.format(d='d')} AS text FROM g""")
def unit_text(spark, sf):
    d = ev(spark, sf).withColumn("g", F.floor(F.col("x") / 6))
    out = A.chord_text(d, ["k", "g"], ["x", "id"], (F.col("id") % 7 + 1).cast("string"), F.col("k") % 9 / 4.0)
    return out.drop("part")


@query("slot_layout", f"""WITH {EV}, s AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY x, id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ev)
 SELECT id, k, CAST(100 + 8 + floor(i * (greatest(1, 900 - 2 * 8) / n)) AS BIGINT) AS slot FROM s""")
def slot_layout(spark, sf):
    d = S.scan(ev(spark, sf), ["k"], ["x", "id"], i=S.row_number(), n=S.total("count", F.lit(1)))
    return d.select("id", "k", N.slot_x(F.lit(100), F.lit(900), F.lit(8), F.col("i") - 1, "n").cast("long").alias("slot"))


# truth: five lines to a section; output: some sections and lines missing, some words changed
_T = f"""{LN}, t AS (SELECT d, n // 5 AS line, n % 5 + 1 AS m, replace(line, '|', '[') AS text FROM ln),
 f AS (SELECT d, n // 5 AS line, row_number() OVER (PARTITION BY d, n // 5 ORDER BY n) AS m, CASE WHEN n % 4 = 1 THEN replace(replace(line, '|', '['), 'e', '/2 ') ELSE replace(line, '|', '[') END AS text FROM ln WHERE (n // 5) % 7 <> 1 AND (d + n) % 11 <> 0),
 z AS (SELECT d, line, m, coalesce(t.text, '') AS gt, coalesce(f.text, '') AS out FROM t FULL JOIN f USING (d, line, m) WHERE (d, line) IN (SELECT (d, line) FROM f))"""
_EVENTS = """regexp_extract_all({c}, '(\\[[^\\]]*\\](?:/[^ \\[]*)?|[^ \\[]+)')"""
_DUR = """CASE WHEN {e} LIKE '%]%' THEN CASE WHEN starts_with(substr({e}, instr({e}, ']') + 1), '/') THEN substr({e}, instr({e}, ']') + 1) ELSE '' END ELSE regexp_extract({e}, '/[0-9]+$') END"""
_NOTES = """list_filter(regexp_split_to_array(trim(CASE WHEN {e} LIKE '%]%' THEN substr({e}, 1, instr({e}, ']')) ELSE regexp_replace({e}, '/[0-9]+$', '') END, '[]'), '\\s+'), lambda v: v <> '')"""


def _pair(spark, sf):
    l = lines(spark, sf).withColumn("line", F.replace("line", F.lit("|"), F.lit("[")))
    n = F.col("n")
    t = l.select(F.col("d").alias("doc"), F.lit("solo").alias("clef"), F.floor(n / 5).alias("sec"), (n % 5 + 1).cast("long").alias("measure_no"), F.col("line").alias("text")).withColumnRenamed("sec", "line")
    f = l.filter((F.floor(n / 5) % 7 != 1) & ((F.col("d") + n) % 11 != 0)).withColumn("sec", F.floor(n / 5))
    f = S.scan(f, ["d", "sec"], ["n"], measure_no=S.row_number())
    text = F.when(n % 4 == 1, F.replace("line", F.lit("e"), F.lit("/2 "))).otherwise(F.col("line"))
    return t, f.select(F.col("d").alias("doc"), F.lit("solo").alias("clef"), F.col("sec").alias("line_"), "measure_no", text.alias("text")).withColumnRenamed("line_", "line")


_SCORES = f"""WITH {_T}, e AS (SELECT *, {_EVENTS.format(c='gt')} AS ge, {_EVENTS.format(c='out')} AS oe FROM z),
 u AS (SELECT d, line, m, coalesce(ge[i], '') AS g, coalesce(oe[i], '') AS o FROM (SELECT *, unnest(range(1, greatest(len(ge), len(oe)) + 1)) AS i FROM e)),
 s AS (SELECT d, line, m, g, o, {_NOTES.format(e='g')} AS gn, {_NOTES.format(e='o')} AS onn, {_DUR.format(e='g')} AS gd, {_DUR.format(e='o')} AS od FROM u),
 c AS (SELECT d, line, count(*) AS n_events, count(*) FILTER (g = o) AS events_ok, CAST(sum(greatest(len(gn), len(onn))) AS BIGINT) AS n_notes,
 CAST(sum(len(list_filter(range(1, least(len(gn), len(onn)) + 1), lambda i: gn[i] = onn[i]))) AS BIGINT) AS pitch_ok, count(*) FILTER (gd = od AND g <> '' AND o <> '') AS duration_ok FROM s GROUP BY 1, 2),
 mm AS (SELECT d, line, count(*) AS n_measures, count(*) FILTER (gt = out) AS measures_ok FROM z GROUP BY 1, 2),
 a AS (SELECT mm.d AS doc, 'solo' AS clef, mm.line AS line, n_measures, measures_ok, coalesce(n_events, 0) AS n_events, coalesce(events_ok, 0) AS events_ok, coalesce(n_notes, 0) AS n_notes, coalesce(pitch_ok, 0) AS pitch_ok,
 coalesce(duration_ok, 0) AS duration_ok FROM mm LEFT JOIN c ON c.d = mm.d AND c.line = mm.line)"""


@query("accuracy_metrics", _SCORES + " SELECT * FROM a")
def accuracy_metrics(spark, sf):
    return E.accuracy_metrics(*_pair(spark, sf))


@query("diff_rows", f"WITH {_T} SELECT d AS doc, 'solo' AS clef, line, m AS measure_no, gt, out FROM z WHERE gt <> out")
def diff_rows(spark, sf):
    return E.diff_rows(*_pair(spark, sf))


@query("top_diffs", f"""WITH {_T} SELECT * FROM (SELECT d AS doc, 'solo' AS clef, line, m AS measure_no, gt, out, row_number() OVER (PARTITION BY d, line ORDER BY m) AS rank FROM z WHERE gt <> out) WHERE rank <= 2""")
def top_diffs(spark, sf):
    return E.top_diffs(E.diff_rows(*_pair(spark, sf)), 2).withColumn("rank", F.col("rank").cast("long"))


@query("accuracy_rollup", _SCORES + """, l AS (SELECT doc, clef, line, unnest([struct_pack(level := 'measures', h := measures_ok, t := n_measures), struct_pack(level := 'events', h := events_ok, t := n_events), struct_pack(level := 'pitch', h := pitch_ok, t := n_notes)]) AS r FROM a)
 SELECT doc, clef, line, r.level AS level, CAST(sum(r.h) AS BIGINT) AS hits, CAST(sum(r.t) AS BIGINT) AS total, CASE WHEN sum(r.t) > 0 THEN round(sum(r.h)::DOUBLE / sum(r.t) * 100) END AS pct
 FROM l GROUP BY GROUPING SETS ((doc, clef, line, r.level), (r.level))""")
def accuracy_rollup(spark, sf):
    return E.accuracy_report(E.accuracy_metrics(*_pair(spark, sf)))


_CONF = "CASE WHEN {s} <= 0.55 THEN 0.60::DOUBLE WHEN {s} >= 0.90 THEN 1.0::DOUBLE ELSE 0.60 + ({s} - 0.55) * (0.40 / 0.35)::DOUBLE END"


@query("note_conf", f"""WITH {EV}, s AS (SELECT id, coalesce(CASE WHEN id % 17 <> 0 THEN (id % 128) / 128.0::DOUBLE END, 0.70::DOUBLE) AS s FROM ev)
 SELECT id, round({_CONF.format(s='s')}, 6) AS conf, CASE WHEN s < 0.70 THEN 'notehead match=' || printf('%.2f', s) END AS reason FROM s""")
def note_conf(spark, sf):
    s = F.when(F.col("id") % 17 != 0, F.col("id") % 128 / 128.0)
    d = ev(spark, sf).select("id", C.note_confidence(s).alias("c"))
    return d.select("id", F.round("c.conf", 6).alias("conf"), "c.reason")


_SRC = "(CASE id % 6 WHEN 0 THEN 'beam' WHEN 1 THEN 'proportional' WHEN 2 THEN 'hollow' WHEN 3 THEN 'single_fill' WHEN 4 THEN 'rest_detected' END)"
_SRCC = "CASE {v} WHEN 'beam' THEN 1.0::DOUBLE WHEN 'single_fill' THEN 0.8 WHEN 'rest_detected' THEN 0.9 WHEN 'unknown' THEN 0.55 ELSE 0.70 END"
_EVC = f"""{EV}, e AS (SELECT id, k, x, y, CASE typ WHEN 'error' THEN 'rest' WHEN 'signup' THEN 'multi_rest_count' ELSE 'note_unit' END AS t, {_SRC} AS src, (id % 96) / 96.0::DOUBLE AS s1, (id % 72) / 72.0::DOUBLE AS s2, id % 2 = 0 AS two, id % 23 = 0 AS none FROM ev),
 m AS (SELECT *, {_CONF.format(s='s1')} AS c1, CASE WHEN two THEN {_CONF.format(s='s2')} END AS c2, coalesce(src, 'unknown') AS tag FROM e),
 c AS (SELECT *, CASE WHEN t = 'rest' THEN CASE WHEN src IS NULL THEN 0.55 ELSE {_SRCC.format(v='src')} END WHEN t = 'multi_rest_count' THEN 1.0 WHEN none THEN 0.5 ELSE least(c1, coalesce(c2, c1), {_SRCC.format(v='tag')}) END AS conf,
 CASE WHEN t = 'rest' THEN CASE WHEN src IS NULL THEN 'untagged rest (likely injected)' WHEN {_SRCC.format(v='src')} < 0.9 THEN 'rest dur: ' || src ELSE '' END WHEN t = 'multi_rest_count' THEN '' WHEN none THEN 'empty unit' ELSE
 array_to_string(list_filter([CASE WHEN s1 < 0.7 THEN 'notehead match=' || printf('%.2f', s1) END, CASE WHEN two AND s2 < 0.7 THEN 'notehead match=' || printf('%.2f', s2) END,
 CASE WHEN {_SRCC.format(v='tag')} < 0.9 THEN 'duration source: ' || tag END, CASE WHEN two AND abs(c1 - c2) > 0.15 THEN 'chord member score spread' END], lambda v: v IS NOT NULL), '; ') END AS why FROM m)"""


def _scored(spark, sf):
    i = F.col("id")
    src = (F.when(i % 6 == 0, "beam").when(i % 6 == 1, "proportional").when(i % 6 == 2, "hollow").when(i % 6 == 3, "single_fill").when(i % 6 == 4, "rest_detected"))
    typ = F.when(F.col("typ") == "error", "rest").when(F.col("typ") == "signup", "multi_rest_count").otherwise("note_unit")
    s1, s2 = i % 96 / 96.0, i % 72 / 72.0
    scores = F.when(i % 23 == 0, F.array().cast("array<double>")).when(i % 2 == 0, F.array(s1, s2)).otherwise(F.array(s1))
    d = ev(spark, sf).select("id", "k", "x", "y", typ.alias("t"), src.alias("src"), F.when(typ != "rest", scores).alias("scores"))
    return d.withColumn("c", C.event_confidence("t", "src", "scores")).withColumns({"conf": F.col("c.conf"), "reasons": F.col("c.reasons")})


@query("event_conf", f"WITH {_EVC} SELECT id, round(conf, 6) AS conf, why FROM c")
def event_conf(spark, sf):
    return _scored(spark, sf).select("id", F.round("conf", 6).alias("conf"), F.array_join("reasons", "; ").alias("why"))


# measures are the user's calendar days; beats are the events' values against the last signup's
_ADJ = f"""{_EVC}, b AS (SELECT *, CAST(floor(x / 240) AS BIGINT) AS m FROM c), mb AS (SELECT k, m, sum(CASE WHEN t IN ('rest', 'note_unit') THEN floor(y / 32) ELSE 0 END) AS beats, min(x) + 1 AS x1 FROM b GROUP BY k, m),
 an AS (SELECT k, x, floor(y / 16) AS bpm FROM ev WHERE typ = 'signup'), cap AS (SELECT mb.*, coalesce(an.bpm, 2.0) AS cap FROM mb ASOF LEFT JOIN an ON mb.k = an.k AND mb.x1 >= an.x),
 adj AS (SELECT b.*, beats, cap, conf * CASE WHEN abs(beats - cap) > 0.1 THEN 0.70 ELSE 1.0 END AS adjusted FROM b JOIN cap ON b.k = cap.k AND b.m = cap.m)"""


def _adjusted(spark, sf):
    d = _scored(spark, sf).withColumn("m", F.floor(F.col("x") / 240))
    a = ev(spark, sf, "signup").select("k", "x", F.floor(F.col("y") / 16).cast("double").alias("bpm"))
    first = d.groupBy("k", "m").agg(F.min("x").alias("x"))
    cap = J.asof_backward(first, a, ["k"], "x", "x", "bpm", "m", 2.0, slack=1.0).select("k", "m", "bpm")
    d = d.join(cap, ["k", "m"]).withColumn("dur", F.floor(F.col("y") / 32).cast("double"))
    return C.adjusted_confidence(d, ["k", "m"], ["x", "id"], "t", "dur", "bpm")


@query("adjusted_conf", f"WITH {_ADJ} SELECT id, k, m, round(adjusted, 6) AS adjusted, adjusted < 0.75 AS low FROM adj")
def adjusted_conf(spark, sf):
    return _adjusted(spark, sf).select("id", "k", "m", F.round("adjusted", 6).alias("adjusted"), "low")


@query("flag_report", f"WITH {_ADJ} SELECT k, count(*) AS total, count(*) FILTER (adjusted < 0.75) AS low, round(count(*) FILTER (adjusted < 0.75) * 100.0::DOUBLE / count(*), 1) AS pct FROM adj GROUP BY ROLLUP (k)")
def flag_report(spark, sf):
    return C.flag_summary(_adjusted(spark, sf), "k")


@query("flag_details", f"WITH {_ADJ} SELECT k, m, id, t AS text, round(adjusted, 2) AS conf, CASE WHEN why = '' THEN '(aggregate low)' ELSE why END AS why FROM adj WHERE adjusted < 0.75")
def flag_details(spark, sf):
    return C.flag_details(_adjusted(spark, sf), ["k", "m"], "id", "t")


@query("report_lines", f"""WITH {_ADJ}, d AS (SELECT *, adjusted < 0.75 AS low FROM adj),
 f AS (SELECT k AS staff, m::BIGINT AS measure, string_agg(CASE WHEN low THEN '[!]' ELSE '' END || t, ' ' ORDER BY id) AS t, any_value(beats) AS beats, any_value(cap) AS cap FROM d GROUP BY k, m)
 SELECT k AS staff, -1::BIGINT AS measure, 0 AS part, 0::BIGINT AS pos, '--- ' || k || ': ' || count(*) || ' events, ' || count(*) FILTER (low) || ' low-conf (' || round(count(*) FILTER (low) * 100.0::DOUBLE / count(*), 1)::DECIMAL(18, 1) || '%) ---' AS text FROM d GROUP BY k
 UNION ALL SELECT staff, measure, 1, 0, '  M' || lpad((measure + 1)::VARCHAR, 2, '0') || ': |' || t || '|' FROM f
 UNION ALL SELECT staff, measure, 2, 0, '         measure: beat sum ' || round(beats, 2)::DECIMAL(18, 2) || ' != ' || cap::DOUBLE FROM f WHERE abs(beats - cap) > 0.1
 UNION ALL SELECT k, m, 3, id, '         pos ' || id || ' "' || t || '" conf=' || round(adjusted, 2)::DECIMAL(18, 2) || ': ' || CASE WHEN why = '' THEN '(aggregate low)' ELSE why END FROM d WHERE low""")
def report_lines(spark, sf):
    return C.report_lines(_adjusted(spark, sf), "k", "m", "id", "t", "bpm")


@query("measure_lines", """WITH t AS (SELECT l_orderkey AS k, string_agg(l_linenumber::VARCHAR || l_returnflag, ' ' ORDER BY l_extendedprice, l_partkey, l_linenumber, l_suppkey) AS text
  FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY l_orderkey),
 m AS (SELECT o_custkey AS doc, o_orderstatus AS clef, 1 AS line, o_orderkey AS measure_no, CASE WHEN o_orderkey % 7 > 4 THEN o_orderkey % 7 END AS n FROM orders)
 SELECT doc, clef, line, measure_no, '|' || coalesce(text, '0 0') || CASE WHEN n IS NOT NULL THEN ' ×' || n::VARCHAR ELSE '' END || '|' AS text FROM m LEFT JOIN t ON k = measure_no
 WHERE NOT (n IS NULL AND coalesce(text, '0 0') = '0 0')""")
def measure_lines(spark, sf):
    from .pipeline import measure_lines as lines_of

    key = [F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("clef"), F.lit(1).alias("line"), F.col("o_orderkey").alias("measure_no")]
    o = table(spark, sf, "orders")
    m = o.select(*key, F.when(F.col("o_orderkey") % 7 > 4, F.col("o_orderkey") % 7).alias("n"))
    li = table(spark, sf, "lineitem").filter("l_orderkey % 3 > 0").join(o.select("o_orderkey", *key), F.col("l_orderkey") == F.col("o_orderkey"))
    names = ["doc", "clef", "line", "measure_no"]
    one = li.select(*names, "l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey", F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("t"))
    texts = A.ordered_concat(one, names, ["l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey"], "t", " ")
    return lines_of(m, texts, skip_empty=True)


def _staves(spark, sf):
    """Users as staves: views are chords, clicks rests, purchases bars, signups triplet figures, positions in quarter days."""
    e = ev(spark, sf).withColumn("x", F.col("x") / 6)
    length = F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0), F.lit(2.0)), (F.col("id") % 4 + 1).cast("int"))
    units = e.filter("typ = 'view'").select("k", F.col("id").alias("unit_id"), "x", length.alias("dur"), (F.lit(0.8) + F.col("id") % 3 * 0.05).alias("score"), F.array("y").alias("ys"),
                                            (F.col("id") % 2 == 0).alias("evidence"), (F.col("id") % 7 + 1).cast("string").alias("pitch"))
    rests = e.filter("typ = 'click'").select("k", F.col("id").alias("rest_id"), "x", F.lit(0.5).alias("duration"))
    bars = e.filter("typ = 'purchase'").select("k", "x")
    anchors = bars.select("k").distinct().select("k", F.lit(0.0).alias("x"), (F.col("k") % 3 + 2).cast("double").alias("bpm"))
    figures = e.filter("typ = 'signup'").select("k", F.col("id").alias("marker_id"), "x", F.lit(3).alias("n"))
    return units, rests, bars, anchors, figures


@query("staff_pipeline")
def staff_pipeline(spark, sf):
    from .pipeline import staff_measures

    units, rests, bars, anchors, figures = _staves(spark, sf)
    out = staff_measures(units, rests, bars, anchors, ["k"], F.col("k") % 2 == 0, markers=figures)
    return out.select("k", "measure_idx", "event_id", "x", "type", F.round("duration", 6).alias("duration"), "source")


@query("measure_text")
def measure_text(spark, sf):
    from .pipeline import staff_lines

    units, rests, bars, anchors, figures = _staves(spark, sf)
    return staff_lines(units, rests, bars, anchors, ["k"], F.col("k") % 2 == 0, markers=figures)
