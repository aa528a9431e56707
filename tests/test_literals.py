"""Small cases with known answers: functions, notation files and the page pipeline."""

import pytest
from pyspark.sql import functions as F

from glyphline.functions import scalar as N
from glyphline.operators import budget as R
from glyphline.operators import confidence as C
from glyphline.operators import evaluation as E
from glyphline.operators import joins as J
from glyphline.plans import pipeline as P
from glyphline.sources import notation as T
from glyphline.sources import tables as B


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


@pytest.mark.parametrize("hollow,beams,flag,want", [(False, 0, True, 0.5), (False, 0, False, 1.0), (False, 1, False, 0.5), (False, 2, False, 0.25), (True, 0, False, 2.0)])
def test_decode(spark, hollow, beams, flag, want):
    args = [F.lit(v) for v in (hollow, beams, flag, True, False)]
    assert one(spark, N.decode_duration(*args)) == want


def test_decode_stemless_and_dotted(spark):
    f, t = F.lit(False), F.lit(True)
    assert one(spark, N.decode_duration(t, F.lit(0), f, f, t), N.decode_duration(f, F.lit(1), f, t, t)) == (4.0, 0.75)


def test_tokens(spark):
    s = F.lit("[1 1']/2 6'/2. [1 3]- 0---")
    assert one(spark, N.tokenize_events(s)) == ["[1 1']/2", "6'/2.", "[1 3]", "-", "0---"]
    split = lambda e: one(spark, N.split_event(F.lit(e)))
    assert tuple(split("[1 1']/2")) == (["1", "1'"], "/2")
    assert tuple(split("6'/2.")) == (["6'/2."], "")
    assert tuple(split("5/4")) == (["5"], "/4")
    assert tuple(split("[]")) == ([], "")


@pytest.mark.parametrize("idx,clef,std,want", [(0, "treble", False, "2''"), (8, "treble", False, "1'"), (15, "treble", False, "1"), (18, "treble", False, "5,"),
                                               (0, "bass", True, "4"), (4, "bass", True, "7,"), (18, "bass", True, "7,,,"), (-1, "treble", False, "3''"),
                                               (19, "treble", False, "4,"), (0, "bass", False, "2''")])
def test_pitches(spark, idx, clef, std, want):
    p = N.pitch_parts(F.lit(idx), F.lit(clef), std)
    assert one(spark, N.pitch_text(p["degree"], p["octave"])) == want


def test_grid(spark):
    lines = F.array(*[F.lit(v) for v in (100, 110, 120, 130, 140)])
    assert one(spark, F.size(N.grid(lines)), F.size(N.grid(lines, 10))) == (19, 39)
    # top line is position 5; exactly between two positions the first wins
    assert one(spark, N.nearest_index(F.lit(100), N.grid(lines))) == 5
    assert one(spark, N.nearest_index(F.lit(102.5), N.grid(lines))) == 5
    assert one(spark, N.nearest_index(F.lit(62), N.grid(lines, 10), 10)) == -3


def test_snap_and_fill(spark):
    assert [one(spark, N.snap(F.lit(v))) for v in (0.375, 1.2, 2.6, 9.0, 0.0)] == [0.25, 1.0, 3.0, 4.0, 0.25]
    assert one(spark, R.fill_chunks(F.lit(0.5), F.lit(1.5))) == [0.5, 1.0]
    assert one(spark, R.fill_chunks(F.lit(0.0), F.lit(4.0))) == [1.0] * 4
    assert one(spark, R.fill_chunks(F.lit(0.0), F.lit(0.1))) == []


def test_confidence(spark):
    assert [one(spark, F.round(N.rescale(F.lit(v)), 6)) for v in (0.55, 0.725, 0.90)] == [0.60, 0.80, 1.00]
    e = one(spark, C.event_confidence(F.lit("note_unit"), F.lit(None).cast("string"), F.array(F.lit(0.9), F.lit(0.6))))
    assert e["conf"] == 0.55 and e["reasons"] == ["notehead match=0.60", "duration source: unknown", "chord member score spread"]
    r = one(spark, C.event_confidence(F.lit("rest"), F.lit("fill_to_measure"), F.lit(None).cast("array<double>")))
    assert r["conf"] == 0.70 and r["reasons"] == ["rest dur: fill_to_measure"]


def test_suffixes(spark):
    assert [one(spark, N.duration_suffix(F.lit(v))) for v in (1 / 12, 1 / 6, 1 / 3, 2 / 3, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)] == [
        "/12", "/6", "/3", "/3*2", "/4", "/2", "/2.", "", ".", "-", "--", "---"]
    assert one(spark, N.key_degrees(F.lit("b"), F.lit(3))) == [7, 3, 6]


TRUTH = """notes: 高音 and 低音 are named here
line 1: 4/4
|5'---|1'(1.5拍) 2|
空两拍
line 2:(undone) later
|7 7 7|
--- 第3行 ---
|空一拍|
| 1 (a remark) | |
高音部分 (line=4):
|[1 3]/2 5|
line 1: again
|6|"""


def _lines(spark, text, doc="a"):
    return spark.createDataFrame([(doc, i, l) for i, l in enumerate(text.split("\n"))], "doc string, n int, line string")


def test_truth_reader(spark):
    got = {(r["clef"], r["line"], r["measure_no"]): r["text"] for r in T.read_truth(_lines(spark, TRUTH)).collect()}
    assert got == {
        ("solo", 1, 1): "5'---", ("solo", 1, 2): "1'. 2", ("solo", 1, 3): "0 0 0 0", ("solo", 1, 4): "0 0 0 0", ("solo", 1, 5): "6",
        ("solo", 3, 1): "0---", ("solo", 3, 2): "1", ("treble", 4, 1): "[1 3]/2 5"}
    # the legend opens an empty section
    assert {(r["clef"], r["line"]) for r in T.truth_sections(_lines(spark, TRUTH)).collect()} == {("treble", 1), ("solo", 1), ("solo", 3), ("treble", 4)}


def test_writer_and_reader_agree(spark):
    m = [("p", "treble", 1, 1, "1 2"), ("p", "treble", 1, 2, "3 4"), ("p", "bass", 1, 1, "0 0"), ("p", "treble", 2, 1, "5"), ("q", "solo", 1, 1, "7 7"), ("q", "solo", 2, 1, "6")]
    d = spark.createDataFrame(m, "doc string, clef string, line int, measure_no int, text string")
    from glyphline.core import scan as S

    text = S.scan(T.notation_lines(d), ["doc"], ["block", "line", "part", "measure_no"], n=S.row_number())
    back = T.read_output(text.select("doc", "n", F.col("text").alias("line")))
    assert sorted(map(tuple, back.collect())) == sorted(m)


def test_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("q", "solo", 1, i, str(i % 7 + 1)) for i in range(1, 40)], "doc string, clef string, line int, measure_no int, text string")
    T.write_lines(T.notation_lines(d), "doc", ["block", "line", "part", "measure_no"], str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out" / "doc=q")).count()
    assert lines == 39 + 1 + 3
    (tmp_path / "page_p2.txt").write_text("--- 第1行 ---\n|1 2|\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("x", encoding="utf-8")
    assert [r["page"] for r in B.list_pages(spark, str(tmp_path / "*.txt")).collect()] == [2]
    back = T.read_output(T.read_lines(spark, str(tmp_path / "page_p2.txt")))
    assert [(r["clef"], r["line"], r["text"]) for r in back.collect()] == [("solo", 1, "1 2")]


def test_concat_pages(spark):
    l = [("s", 1, 0, "title"), ("s", 1, 1, "--- 第1行 ---"), ("s", 1, 2, "|1|"), ("s", 2, 0, "--- 第1行 ---"), ("s", 3, 0, "|9|"), ("s", 3, 1, "--- 第1行 ---")]
    lines = spark.createDataFrame(l, "score string, page int, n int, text string")
    pages = spark.createDataFrame([("s", 1, "ok"), ("s", 2, "failed"), ("s", 3, "ok")], "score string, page int, status string")
    got = [r["text"] for r in T.concat_pages(lines, pages).orderBy("page", "n").collect()]
    assert got == ["#" * 60, "# 第 1 页", "#" * 60, "--- 第1行 ---", "|1|", "#" * 60, "# 第 3 页", "#" * 60, "|9|", "--- 第2行 ---"]


def test_scores(spark):
    schema = "doc string, clef string, line int, measure_no int, text string"
    t = spark.createDataFrame([("a", "solo", 1, 1, "[1 3]/2 5 6/4"), ("a", "solo", 1, 2, "7"), ("a", "solo", 2, 1, "1")], schema)
    f = spark.createDataFrame([("a", "solo", 1, 1, "[1 4]/2 5"), ("a", "solo", 9, 1, "7")], schema)
    r = E.accuracy_metrics(t, f).collect()
    # line 2 is missing from the output and leaves the totals, line 9 is ignored
    assert len(r) == 1 and r[0].asDict() == dict(
        doc="a", clef="solo", line=1, n_measures=2, measures_ok=0, n_events=4, events_ok=1, n_notes=5, pitch_ok=2, duration_ok=2)
    pct = {(r["line"], r["level"]): r["pct"] for r in E.accuracy_report(E.accuracy_metrics(t, f)).collect()}
    assert pct == {(1, "measures"): 0, (1, "events"): 25, (1, "pitch"): 40, (None, "measures"): 0, (None, "events"): 25, (None, "pitch"): 40}
    assert [r["measure_no"] for r in E.top_diffs(E.diff_rows(t, f), 1).collect()] == [1]


def test_positions_at_edges(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 10.0), (1, 3, -1.0), (2, 4, 3.0)], "k long, id long, x double")
    bars = spark.createDataFrame([(1, 5.0), (1, 9.0)], "k long, b double")
    seg = {r["id"]: r["m"] for r in J.segment_by_boundary(rows, bars, ["k"], "x", "b", "id", "m").collect()}
    assert seg == {1: 1, 2: 2, 4: 0}
    near = {r["id"] for r in J.proximity_anti(rows, bars, ["k"], "x", "b", "id", 1.0).collect()}
    # exactly the tolerance away is not near
    assert near == {2, 3, 4}


def test_page_to_text(spark):
    page = dict(score_id="s", page=1)
    systems = spark.createDataFrame([("s", 1, 0, [100, 110, 120, 130, 140]), ("s", 1, 1, [300, 310, 320, 330, 340])], "score_id string, page int, system int, y array<int>")
    notes = spark.createDataFrame(
        [(1, "s", 1, 50, 120, 1.0), (2, "s", 1, 80, 115, 1.0), (3, "s", 1, 60, 330, 1.0), (4, "s", 1, 90, 600, 1.0), (5, "s", 1, 95, 125, 0.2)],
        "note_id long, score_id string, page int, x int, y_center int, score double").withColumn("clef", F.lit(None).cast("string"))
    pages = spark.createDataFrame([("s", 1, 10.0)], "score_id string, page int, dy double")
    got = {r["note_id"]: (r["system"], r["pitch"]) for r in P.page_pitches(notes, systems, pages).collect()}
    # note 4 is too far from any staff, note 5 too weak
    assert got == {1: (0, "7"), 2: (0, "1'"), 3: (1, "5")}


def test_measure_text(spark):
    m = [("d", "solo", 1, 1, 1, 10.0, 0.5, 1, 10.0, 5.0, 4, 0, "4", "#"), ("d", "solo", 1, 1, 2, 20.0, 1.0, 2, 20.0, 5.0, 4, 0, "4", None),
         ("d", "solo", 1, 1, 2, 20.0, 1.0, 3, 20.0, 5.0, 6, -1, "6,", None), ("d", "solo", 1, 1, 3, 90.0, 1.0, 4, 90.0, 5.0, 4, 0, "4", None)]
    members = spark.createDataFrame(m, "doc string, clef string, line int, measure_no int, unit_id long, unit_x double, duration double, note_id long, x double, dy double, degree int, octave int, pitch string, sign string")
    rests = spark.createDataFrame([("d", "solo", 1, 1, 7, 50.0, 2.0)], "doc string, clef string, line int, measure_no int, rest_id long, x double, duration double")
    keys = spark.createDataFrame([("d", "b", [6])], "doc string, sign string, degrees array<int>")
    # the sharp carries on to the chord but not past the gap; the key signature flattens 6
    assert P.measures_to_text(members, rests, keys).first()["text"] == "#4/2 [b6, #4] 0- 4"


def test_staff_measures(spark):
    """Four measures of three beats: one right, one short of a rest, one whole, one filled."""
    u = [(1, 10.0, 1.0), (2, 20.0, 1.0), (3, 30.0, 1.0), (4, 45.0, 1.0), (5, 55.0, 0.5), (6, 75.0, 3.5), (7, 112.0, 0.5), (8, 115.0, 0.5)]
    units = spark.createDataFrame([(1, i, x, d, 1.0, [float(i * 10)], True) for i, x, d in u], "k long, unit_id long, x double, dur double, score double, ys array<double>, evidence boolean")
    # the second rest sits on a note and goes, the third is swallowed by the long note
    rests = spark.createDataFrame([(1, 1, 62.0, 1.0), (1, 2, 20.5, 1.0), (1, 3, 95.0, 1.0)], "k long, rest_id long, x double, duration double")
    bars = spark.createDataFrame([(1, 40.0), (1, 70.0), (1, 105.0), (1, 125.0)], "k long, x double")
    anchors = spark.createDataFrame([(1, 0.0, 3.0)], "k long, x double, bpm double")
    rows = P.staff_measures(units, rests, bars, anchors, ["k"], F.lit(False)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["measure_idx"], r["x"])):
        got.setdefault(r["measure_idx"], []).append((r["type"], r["duration"], r["source"]))
    assert got[0] == [("note_unit", 1.0, "beam")] * 3
    # 1.5 beats of notes and a rest of one: a rest of a half is missing before it
    assert [e[1] for e in got[1]] == [1.0, 0.5, 0.5, 1.0] and got[1][2][2] == "gap_insert"
    assert got[2] == [("note_unit", 3.5, "whole")]
    assert sum(e[1] for e in got[3]) == 3.0 and got[3][-1][2] in ("fill_to_measure", "beam_rescue")


def test_wide_space_and_digits(spark):
    """Wide blanks around lines, bars and heads, and full-width digits in heads, read like their ASCII kin."""
    from glyphline.functions import scalar as N
    from glyphline.sources import notation as T

    lines = ["---　第　２　行　---", "　|1 2|　3　|", "line　3　:", "|4　|", " --- 第4行 --- ", "|5|"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, n int, line string")
    got = sorted((r.line, r.measure_no, r.text) for r in T.read_truth(df).collect())
    assert got == [(2, 1, "1 2"), (2, 2, "3"), (3, 1, "4"), (4, 1, "5")]
    out = sorted((r.line, r.text) for r in T.read_output(df.filter("n < 2")).collect())
    assert out == [(2, "1 2"), (2, "3")]
    row = spark.range(1).select(N.split_event(F.lit("[1　3]/２")).alias("e"), N.strip(F.lit("　  a　b　")).alias("s")).first()
    assert row.e.notes == ["1", "3"] and row.s == "a　b"


def test_empty_measures_in_the_middle_are_filled(spark):
    """Bars 20, 40, 60, 100 with notes in measures 0 and 2: the second gets rests, the empty last one stays out."""
    units = spark.createDataFrame([(1, 1, 5.0, 2.0, 1.0, [0.0], True), (1, 2, 45.0, 2.0, 1.0, [0.0], True)],
                                  "k long, unit_id long, x double, dur double, score double, ys array<double>, evidence boolean")
    rests = spark.createDataFrame([], "k long, rest_id long, x double, duration double")
    bars = spark.createDataFrame([(1, b) for b in (20.0, 40.0, 60.0, 100.0)], "k long, x double")
    anchors = spark.createDataFrame([(1, 0.0, 2.0)], "k long, x double, bpm double")
    rows = P.staff_measures(units, rests, bars, anchors, ["k"], F.lit(False)).collect()
    got = sorted((r.measure_idx, r.x, r.type, r.duration, r.source) for r in rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(0, "note_unit", 2.0), (1, "rest", 1.0), (1, "rest", 1.0), (2, "note_unit", 2.0)]
    assert all(20.0 < r[1] < 40.0 for r in got if r[0] == 1)


def test_dotted_lengths_become_plain_ones(spark):
    """Three beats shared evenly by four notes: 0.75 each is put as plain lengths their beams speak for."""
    rows = [(1, i, 10.0 * i, 40.0, 3.0, [d]) for i, d in enumerate([1.0, 0.5, 1.0, 0.5])]
    df = spark.createDataFrame(rows, "k long, id long, x double, edge double, rem double, own array<double>")
    got = sorted((r.id, r.duration, r.source) for r in R.proportional_alloc(df, ["k"], "x", "id", "rem", "edge", idurs="own").collect())
    assert [g[1] for g in got] == [1.0, 0.5, 1.0, 0.5] and {g[2] for g in got} == {"proportional_dotted_decomposed"}


def test_measure_lines(spark):
    m = spark.createDataFrame([("d", "solo", 1, i, n) for i, n in ((1, None), (2, None), (3, 8), (4, None))], "doc string, clef string, line int, measure_no int, n long")
    t = spark.createDataFrame([("d", "solo", 1, 1, "1 2"), ("d", "solo", 1, 3, "0 0"), ("d", "solo", 1, 4, "0 0")], "doc string, clef string, line int, measure_no int, text string")
    read = lambda d: [r.text for r in sorted(d.collect(), key=lambda r: r.measure_no)]
    assert read(P.measure_lines(m, t)) == ["|1 2|", "|0 0|", "|0 0 ×8|", "|0 0|"]
    assert read(P.measure_lines(m, t, skip_empty=True)) == ["|1 2|", "|0 0 ×8|"]


def test_report(spark, tmp_path):
    rows = [("treble", 0, 1, "1", 0.9, ["x"], 2.0, 2.0), ("treble", 0, 2, "2", 0.5, ["weak"], 2.0, 2.0), ("treble", 1, 1, "3/2", 0.8, [], 1.5, 2.0)]
    d = spark.createDataFrame(rows, "s string, m int, pos int, t string, adjusted double, reasons array<string>, beats double, cap double")
    d = d.withColumns({"off": F.abs(F.col("beats") - F.col("cap")) > 0.1, "low": F.col("adjusted") < 0.75})
    lines = [r.text for r in sorted(C.report_lines(d, "s", "m", "pos", "t", "cap").collect(), key=lambda r: (r.staff, r.measure, r.part, r.pos))]
    assert lines == ["--- treble: 3 events, 1 low-conf (33.3%) ---", "  M01: |1 [!]2|", '         pos 2 "2" conf=0.50: weak', "  M02: |3/2|", "         measure: beat sum 1.50 != 2.0"]
    C.write_report(C.flag_summary(d, "s"), C.flag_details(d, ["s", "m"], "pos", "t"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "details")).first().why == "weak"
    assert {r.s: r.low for r in spark.read.parquet(str(tmp_path / "r" / "summary")).collect()} == {"treble": 1, None: 1}


UNIT = "k long, unit_id long, x double, dur double, score double, ys array<double>, evidence boolean, pitch string"


def staff(spark, units, bars, beats, rests=()):
    u = spark.createDataFrame([(1, i, x, d, 1.0, [float(i * 10)], True, str(i % 7 + 1)) for i, (x, d) in enumerate(units)], UNIT)
    r = spark.createDataFrame([(1, i, x, d) for i, (x, d) in enumerate(rests)], "k long, rest_id long, x double, duration double")
    return u, r, spark.createDataFrame([(1, b) for b in bars], "k long, x double"), spark.createDataFrame([(1, 0.0, beats)], "k long, x double, bpm double")


def by_measure(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.measure_idx, r.x)):
        out.setdefault(r.measure_idx, []).append((r.type, round(r.duration, 4), r.source))
    return out


def test_an_empty_first_measure_is_filled(spark):
    """Bars 20, 40, 60 and one note in the second measure: the first, from the page's edge on, gets its rests."""
    parts = staff(spark, [(30.0, 2.0)], [20.0, 40.0, 60.0], 2.0)
    got = by_measure(P.staff_measures(*parts, ["k"], F.lit(False)).collect())
    assert [e[:2] for e in got[0]] == [("rest", 1.0), ("rest", 1.0)] and got[1][0][:2] == ("note_unit", 2.0) and 2 not in got
    narrow = staff(spark, [(30.0, 2.0)], [4.0, 40.0], 2.0)
    assert 0 not in by_measure(P.staff_measures(*narrow, ["k"], F.lit(False)).collect())


def test_a_triplet_in_a_staff(spark):
    """Three quavers under a 3 in a measure of two beats take a third each, the crotchet beside them the beat that is left."""
    notes = [(5.0, 0.5), (10.0, 0.5), (15.0, 0.5), (25.0, 1.0), (45.0, 1.0), (55.0, 1.0)]
    parts = staff(spark, notes, [40.0, 70.0], 2.0)
    markers = spark.createDataFrame([(1, 7, 10.5, 3)], "k long, marker_id long, x double, n int")
    got = by_measure(P.staff_measures(*parts, ["k"], F.lit(False), markers=markers).collect())
    assert [e[1] for e in got[0]] == [0.3333, 0.3333, 0.3333, 1.0]
    assert [e[2] for e in got[0]] == ["tuplet"] * 3 + ["tuplet_leftover"]
    assert [e[1] for e in got[1]] == [1.0, 1.0]
    plain = by_measure(P.staff_measures(*parts, ["k"], F.lit(False)).collect())
    assert got[1] == plain[1] and got[0] != plain[0]


def test_lines_of_a_staff(spark):
    parts = staff(spark, [(5.0, 1.0), (10.0, 1.0), (45.0, 0.5), (50.0, 0.5), (55.0, 1.0)], [20.0, 40.0, 70.0], 2.0)
    assert P.staff_lines(*parts, ["k"], F.lit(False), skip_empty=False).collect()[0].text == "|1 2|0 0|3/2 4/2 5|"
    assert P.staff_lines(*parts, ["k"], F.lit(False)).collect()[0].text == "|1 2|3/2 4/2 5|"


def test_detection_tables_are_read_with_their_types(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 4, 10, 0.5), ("s", 2, 4, 30, None)], "score_id string, page int, system int, x int, score double")
    rows.write.parquet(str(tmp_path / "barlines"))
    got = B.read_detections(spark, str(tmp_path), "barlines")
    assert got.dtypes == rows.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert set(B.SCHEMAS) >= {"noteheads", "rests", "barlines", "ink_runs"}


def test_reports_are_text_files_by_score(spark, tmp_path):
    rows = [(s, m, p, 0, f"{s} {m} {p}") for s in ("a", "b") for m in range(3) for p in range(4)]
    lines = spark.createDataFrame([("one", *r) for r in rows] + [("two", *r) for r in rows[:5]], "score string, staff string, measure long, part int, pos long, text string")
    none = spark.createDataFrame([], "x int")
    C.write_report(none, none, str(tmp_path), lines.repartition(7), "score")
    for name, want in (("one", rows), ("two", rows[:5])):
        files = list((tmp_path / "text" / f"score={name}").glob("*.txt"))
        assert len(files) == 1 and files[0].read_text().split("\n")[:-1] == [r[-1] for r in want]


def test_notation_files_are_read_back_as_written(spark, tmp_path):
    """Read, write, read: a grand and a single staff, a labelled file first, then what was written of it."""
    grand = [(c, line, no, f"{line} {no}' [1 3]/2 {c[0]}") for c in ("treble", "bass") for line in (1, 2, 11) for no in range(1, 13)]
    solo = [("solo", line, no, f"5, 0/4 {no}") for line in range(1, 30) for no in range(1, 4)]
    rows = [("g", *r) for r in grand] + [("s", *r) for r in solo]
    df = spark.createDataFrame(rows, "doc string, clef string, line int, measure_no int, text string")
    T.write_notation(df.repartition(5), str(tmp_path / "a"))
    got = T.read_notation(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(rows)
    (tmp_path / "labelled.md").write_text("line 1:\n|1 2|3-|\n|空两拍|\n--- 第3行 ---\n|5/2 6|\n", encoding="utf-8")
    truth = T.read_truth(T.read_lines(spark, str(tmp_path / "labelled.md"))).withColumn("doc", F.lit("t"))
    T.write_notation(truth, str(tmp_path / "b"))
    again = T.read_notation(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, again.select(*truth.columns).collect())) == sorted(map(tuple, truth.collect())) and truth.count() >= 4
