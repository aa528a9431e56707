"""Check queries: scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as N
from .registry import EV, LN, ev, lines, query, table

STEPS_SQL = "[0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]"
SUFFIX_SQL = """CASE WHEN abs({d} - 1.0::DOUBLE / 12) < 0.01 THEN '/12' WHEN abs({d} - 1.0::DOUBLE / 6) < 0.02 THEN '/6'
 WHEN abs({d} - 1.0::DOUBLE / 3) < 0.03 THEN '/3' WHEN abs({d} - 2.0::DOUBLE / 3) < 0.05 THEN '/3*2'
 WHEN abs({d} - 0.25::DOUBLE) < 0.01 THEN '/4' WHEN abs({d} - 0.5::DOUBLE) < 0.01 THEN '/2'
 WHEN abs({d} - 0.75::DOUBLE) < 0.05 THEN '/2.' WHEN abs({d} - 1.5::DOUBLE) < 0.1 THEN '.'
 WHEN abs({d} - 2.0::DOUBLE) < 0.1 THEN '-' WHEN abs({d} - 3.0::DOUBLE) < 0.1 THEN '--'
 WHEN abs({d} - 4.0::DOUBLE) < 0.1 THEN '---' ELSE '' END"""
# durations from the order lines: quarters and their thirds
DUR_SQL = "(CASE WHEN l_linenumber = 7 THEN l_quantity / 12 ELSE l_quantity / 4 END)"


def _dur():
    return F.when(F.col("l_linenumber") == 7, F.col("l_quantity") / 12).otherwise(F.col("l_quantity") / 4)


# a staff per part: top line p_size, spacing (p_partkey % 5) + 2
STAFF_SQL = "p_partkey, p_retailprice % 60 AS y, p_size::DOUBLE AS t, (p_partkey % 5 + 2)::DOUBLE AS dy"


def _staff(spark, sf):
    p = table(spark, sf, "part")
    dy = (F.col("p_partkey") % 5 + 2).cast("double")
    t = F.col("p_size").cast("double")
    return p.select("p_partkey", (F.col("p_retailprice") % 60).alias("y"), F.array(*[t + dy * i for i in range(5)]).alias("lines"))


@query("grid_points", f"""SELECT p_partkey, i AS pos, round(t - 2.5 * dy + i * dy / 2 - 10 * dy / 2, 6) AS centre
 FROM (SELECT {STAFF_SQL} FROM part), range(39) r(i)""")
def grid_points(spark, sf):
    d = _staff(spark, sf).select("p_partkey", F.posexplode(N.grid("lines", 10)).alias("pos", "centre"))
    return d.select("p_partkey", F.col("pos").cast("long").alias("pos"), F.round("centre", 6).alias("centre"))


@query("nearest_grid", f"""WITH s AS (SELECT {STAFF_SQL} FROM part), c AS (SELECT p_partkey, i, abs(y - (t - 2.5 * dy + i * (dy / 2) - 10 * (dy / 2))) AS d
 FROM s, range(39) r(i)), m AS (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY round(d, 9), i) AS rn FROM c)
 SELECT p_partkey, i - 10 AS idx FROM m WHERE rn = 1""")
def nearest_grid(spark, sf):
    return _staff(spark, sf).select("p_partkey", N.nearest_index("y", N.grid("lines", 10), 10).cast("long").alias("idx"))


@query("modular_map", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 15 ELSE 3 END - (l_partkey % 39 - 10) AS step FROM lineitem),
 p AS (SELECT l_orderkey, l_linenumber, (step % 7 + 7) % 7 + 1 AS degree, CAST(floor(step / 7.0) AS BIGINT) AS octave FROM s)
 SELECT l_orderkey, l_linenumber, degree, octave, degree::VARCHAR || repeat('''', greatest(octave, 0)) || repeat(',', greatest(-octave, 0)) AS pitch FROM p""")
def modular_map(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 39 - 10).alias("idx"),
        F.when(F.col("l_suppkey") % 2 == 0, "treble").otherwise("bass").alias("clef"))
    d = d.withColumn("p", N.pitch_parts("idx", "clef", standard_bass=True))
    return d.select("l_orderkey", "l_linenumber", "p.degree", "p.octave", N.pitch_text("p.degree", "p.octave").alias("pitch"))


@query("duration_suffix", f"SELECT l_orderkey, l_linenumber, {DUR_SQL} AS dur, {SUFFIX_SQL.format(d=DUR_SQL)} AS suffix FROM lineitem")
def duration_suffix(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _dur().alias("dur"), N.duration_suffix(_dur()).alias("suffix"))


@query("rest_suffix", """SELECT l_orderkey, l_linenumber, CASE WHEN abs(d - 4) < 0.05 THEN '0---' WHEN abs(d - 3) < 0.05 THEN '0--' WHEN abs(d - 2) < 0.05 THEN '0-'
 WHEN abs(d - 1.5) < 0.05 THEN '0.' WHEN abs(d - 0.75) < 0.05 THEN '0/2.' WHEN abs(d - 0.5) < 0.05 THEN '0/2' WHEN abs(d - 0.25) < 0.05 THEN '0/4' ELSE '0' END AS txt
 FROM (SELECT l_orderkey, l_linenumber, l_quantity / 4 AS d FROM lineitem)""")
def rest_suffix(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.rest_text(F.col("l_quantity") / 4).alias("txt"))


@query("piecewise_rescale", f"""WITH {EV} SELECT id, round(CASE WHEN s <= 0.55 THEN 0.60::DOUBLE WHEN s >= 0.90 THEN 1.0::DOUBLE
 ELSE 0.60 + (s - 0.55) * (0.40 / 0.35)::DOUBLE END, 6) AS conf FROM (SELECT id, y / 100 AS s FROM ev)""")
def piecewise_rescale(spark, sf):
    return ev(spark, sf).select("id", F.round(N.rescale(F.col("y") / 100), 6).alias("conf"))


@query("count_marks", f"""WITH {LN} SELECT d, n, substr(line, 1, 1) AS digit,
 CAST(length(substr(line, 2)) - length(replace(substr(line, 2), '''', '')) - (length(substr(line, 2)) - length(replace(substr(line, 2), ',', ''))) AS BIGINT) AS octave FROM ln""")
def count_marks(spark, sf):
    d = lines(spark, sf).withColumn("p", N.split_pitch("line"))
    return d.select("d", F.col("n").cast("long").alias("n"), "p.digit", F.col("p.octave").cast("long").alias("octave"))


@query("rhythm_struct", f"""SELECT l_orderkey, l_linenumber, CASE WHEN abs(d - 1.0::DOUBLE / 6) < 0.05 OR abs(d - 1.0::DOUBLE / 12) < 0.05 THEN 2 WHEN abs(d - 1.0::DOUBLE / 3) < 0.05 THEN 1
 WHEN abs(d - 2.0::DOUBLE / 3) < 0.05 THEN 0 WHEN abs(d - 0.25) < 0.05 THEN 2 WHEN abs(d - 0.5) < 0.05 OR abs(d - 0.75) < 0.05 THEN 1 ELSE 0 END AS underlines,
 abs(d - 2.0::DOUBLE / 3) >= 0.05 AND (abs(d - 0.75) < 0.05 OR abs(d - 1.5) < 0.05) AS dotted,
 CASE WHEN abs(d - 2) < 0.05 THEN 1 WHEN abs(d - 3) < 0.05 THEN 2 WHEN abs(d - 4) < 0.05 THEN 3 ELSE 0 END AS dashes
 FROM (SELECT l_orderkey, l_linenumber, {DUR_SQL} AS d FROM lineitem)""")
def rhythm_struct(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.rhythm_marks(_dur()).alias("m"))
    return d.select("l_orderkey", "l_linenumber", "m.*")


@query("meter_beats", "SELECT l_orderkey, l_linenumber, l_quantity * (4.0::DOUBLE / (l_linenumber + 1)) AS beats FROM lineitem")
def meter_beats(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.meter_beats("l_quantity", F.col("l_linenumber") + 1).alias("beats"))


@query("split_clean", f"""WITH {LN} SELECT d, n, m - 1 AS pos, p[m] AS part FROM (SELECT d, n, p, unnest(range(1, len(p) + 1)) AS m FROM
 (SELECT d, n, list_filter(list_transform(string_split(line, '|'), lambda s: trim(s)), lambda s: s <> '') AS p FROM ln))""")
def split_clean(spark, sf):
    d = lines(spark, sf).select("d", "n", F.posexplode(N.split_measures("line")).alias("pos", "part"))
    return d.select("d", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "part")


@query("tokenize_events", f"""WITH {LN} SELECT d, n, m - 1 AS pos, p[m] AS token FROM (SELECT d, n, p, unnest(range(1, len(p) + 1)) AS m FROM
 (SELECT d, n, regexp_extract_all(line, '(\\[[^\\]]*\\](?:/[^ \\[]*)?|[^ \\[]+)') AS p FROM ln))""")
def tokenize_events(spark, sf):
    d = lines(spark, sf).select("d", "n", F.posexplode(N.tokenize_events("line")).alias("pos", "token"))
    return d.select("d", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "token")


# URLs as events: the path segments give slashes and closing digits
@query("split_event", """WITH e AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '[' || replace(url, '/', ' ') || ']/' || (page_id % 3)::VARCHAR ELSE url END AS s FROM pages),
 b AS (SELECT page_id, CASE WHEN s LIKE '%]%' THEN substr(s, instr(s, ']') + 1) ELSE regexp_extract(s, '/[0-9]+$') END AS duration,
 CASE WHEN s LIKE '%]%' THEN substr(s, 1, instr(s, ']')) ELSE regexp_replace(s, '/[0-9]+$', '') END AS body FROM e)
 SELECT page_id, duration, array_to_string(list_filter(string_split(trim(trim(body, '[]')), ' '), lambda v: v <> ''), '~') AS notes FROM b""")
def split_event(spark, sf):
    s = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("["), F.replace("url", F.lit("/"), F.lit(" ")), F.lit("]/"), (F.col("page_id") % 3).cast("string"))).otherwise(F.col("url"))
    d = table(spark, sf, "pages").select("page_id", N.split_event(s).alias("e"))
    return d.select("page_id", "e.duration", F.array_join("e.notes", "~").alias("notes"))


@query("normalize_text", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\(1\\.5拍\\)', '.', 'g'),
 '\\(\\d+\\.?\\d*拍\\)', '', 'g'), '\\([^)]*\\)', '', 'g')) AS txt FROM documents""")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.normalize_measure("text").alias("txt"))


@query("counted_expand", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber % 4 + 1 AS INT) AS n FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, i AS pos, CASE WHEN n = 1 THEN '0---' ELSE '0 0 0 0' END AS measure FROM
 (SELECT *, unnest(range(0, n)) AS i FROM c)""")
def counted_expand(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 4 + 1).alias("n"))
    d = d.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(N.blank_measures("n")).alias("pos", "measure"))
    return d.withColumn("pos", F.col("pos").cast("long"))


@query("digits_to_int", """SELECT o_orderkey, CASE WHEN v >= 2 THEN v END AS number FROM (SELECT o_orderkey, CAST(o_orderkey % 2 * 100 + o_custkey % 10 * 10 + CAST(o_orderpriority[1] AS BIGINT) AS BIGINT) AS v
 FROM orders)""")
def digits_to_int(spark, sf):
    o = table(spark, sf, "orders")
    digits = F.array(F.col("o_orderkey") % 2, F.col("o_custkey") % 10, F.substring("o_orderpriority", 1, 1).cast("long"))
    return o.select("o_orderkey", N.digits_to_int(digits).alias("number"))


@query("prefix_slice", """SELECT o_orderkey, array_to_string(list_slice(CASE WHEN o_orderkey % 2 = 0 THEN [4,1,5,2,6,3,7] ELSE [7,3,6,2,5,1,4] END, 1, least(CAST(o_orderpriority[1] AS INT) + o_custkey % 5, 7)), ' ') AS degrees
 FROM orders""")
def prefix_slice(spark, sf):
    o = table(spark, sf, "orders")
    sign = F.when(F.col("o_orderkey") % 2 == 0, "#").otherwise("b")
    n = (F.substring("o_orderpriority", 1, 1).cast("int") + F.col("o_custkey") % 5).cast("int")
    return o.select("o_orderkey", F.array_join(N.key_degrees(sign, n).cast("array<string>"), " ").alias("degrees"))


@query("snap_value", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 11 AS v FROM lineitem),
 s AS (SELECT *, unnest({STEPS_SQL})::DOUBLE AS step FROM v)
 SELECT l_orderkey, l_linenumber, l_partkey, v, arg_min(step, (abs(v - step), step)) AS snapped FROM s GROUP BY ALL""")
def snap_value(spark, sf):
    li = table(spark, sf, "lineitem")
    v = F.col("l_quantity") / 11
    return li.select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"), N.snap(v).alias("snapped")).distinct()


@query("decode_case", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 5 = 0 THEN 4.0::DOUBLE ELSE 1.0 END ELSE
 (CASE WHEN l_suppkey % 5 = 0 THEN 2.0::DOUBLE WHEN l_linenumber % 4 >= 2 THEN 0.25 WHEN l_linenumber % 4 = 1 OR l_linestatus = 'F' THEN 0.5 ELSE 1.0 END)
 * CASE WHEN l_tax > 0.06 THEN 1.5::DOUBLE ELSE 1.0 END END AS dur FROM lineitem""")
def decode_case(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.decode_duration(F.col("l_suppkey") % 5 == 0, F.col("l_linenumber") % 4, F.col("l_linestatus") == "F",
                          F.col("l_returnflag") != "R", F.col("l_tax") > 0.06).alias("dur"))
