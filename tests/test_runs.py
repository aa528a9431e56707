"""Ink runs against pictures held pixel by pixel."""

import numpy as np
import pytest

from glyphline.core.components import components
from glyphline.operators import runs as R

NAMES = "page string, y int, x0 int, x1 int"


def runs_of(picture, page="p"):
    out = []
    for y, row in enumerate(picture):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(int), [0]))))
        out += [(page, y, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, NAMES)


def ink_of(rows, shape):
    out = np.zeros(shape, bool)
    for r in rows:
        out[r.y, r.x0 : r.x1] = True
    return out


def picture(seed, shape=(30, 70), share=0.35):
    rng = np.random.default_rng(seed)
    p = rng.random(shape) < share
    p[5, 3:60] = p[6, 3:60] = p[20, 10:70] = True
    p[2:25, 40:42] = True
    return p


def opened(p, n, axis):
    """Pixels in an unbroken stretch of n or more along an axis."""
    p = p.T if axis == 0 else p
    out = np.zeros_like(p)
    for y, row in enumerate(p):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(int), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            out[y, a:b] = b - a >= n
    return out.T if axis == 0 else out


def flood(p):
    """(box, ink, mean place) of each 8-connected part, by flooding."""
    seen, out = np.zeros_like(p), []
    for y, x in zip(*np.nonzero(p)):
        if seen[y, x]:
            continue
        todo, own = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.append((a, b))
            for c in range(max(a - 1, 0), min(a + 2, p.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, p.shape[1])):
                    if p[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        own = np.array(own)
        (y0, x0), (y1, x1) = own.min(axis=0), own.max(axis=0)
        out.append((int(x0), int(y0), int(x1 - x0 + 1), int(y1 - y0 + 1), len(own), round(own[:, 1].mean(), 6), round(own[:, 0].mean(), 6)))
    return sorted(out)


def boxes_of(rows):
    return sorted((r.x, r.y, r.w, r.h, r.area, round(r.cx, 6), round(r.cy, 6)) for r in rows)


@pytest.mark.parametrize("band", [8, 256])
def test_transposing_twice_gives_the_picture_back(spark, band):
    p = picture(1)
    rows = runs_of(p) + [("p", 3, 9, 9), ("p", 3, None, 4), (None, 3, 1, 5), ("p", 5, 10, 30)]  # empty, null, another page, overlapping
    down = R.transpose_runs(frame(spark, rows), ["page"], band=band)
    got = sorted((r.y0, r.x, r.y1) for r in down.collect() if r.page == "p")
    assert got == sorted((y, x0, x1) for _, x0, y, x1 in runs_of(p.T))
    back = R.transpose_runs(down, ["page"], "x", "y0", "y1", out=("y", "x0", "x1"), band=band)
    assert sorted(tuple(r) for r in back.collect() if r.page) == sorted(runs_of(p))


def test_sets_of_ink(spark):
    a, b = picture(2), picture(3)
    fa, fb = frame(spark, runs_of(a)), frame(spark, runs_of(b))
    assert (ink_of(R.subtract_runs(fa, fb, ["page"]).collect(), a.shape) == (a & ~b)).all()
    rows = R.unite_runs(fa, fb, ["page"]).collect()
    assert (ink_of(rows, a.shape) == (a | b)).all() and len(rows) == len(runs_of(a | b))


def test_opening_and_line_erasure(spark):
    p = picture(4)
    f = frame(spark, runs_of(p))
    assert (ink_of(R.open_runs(f, ["page"], 6).collect(), p.shape) == opened(p, 6, 1)).all()
    assert (ink_of(R.open_runs(f, ["page"], 4, across=True).collect(), p.shape) == opened(p, 4, 0)).all()
    lines, symbols = R.erase_lines(f, ["page"], 300)
    level = opened(p, 3, 1)
    gone = opened(p, 19, 1) | (level & ~opened(level, 4, 0))
    assert (ink_of(lines.collect(), p.shape) == gone).all()
    assert (ink_of(symbols.collect(), p.shape) == (p & ~gone)).all()


def test_components_of_noise(spark):
    p = picture(5, share=0.3)
    assert boxes_of(R.run_components(frame(spark, runs_of(p)), ["page"]).collect()) == flood(p)


def test_components_of_a_spiral_and_a_comb(spark):
    n = 41
    spiral = np.zeros((n, n), bool)
    y, x, dy, dx, steps = n // 2, n // 2, 0, 1, 1
    while 0 <= y < n and 0 <= x < n:
        for _ in range(2):
            for _ in range(2 * steps):
                if not (0 <= y < n and 0 <= x < n):
                    break
                spiral[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        steps += 1
    comb = np.zeros((12, 80), bool)
    comb[11] = True
    comb[:, ::2] = True
    for p in (spiral, comb):
        got = R.run_components(frame(spark, runs_of(p)), ["page"]).collect()
        assert len(got) == 1 and boxes_of(got) == flood(p)


def test_rounds_of_components_are_logarithmic(spark, monkeypatch):
    import glyphline.core.components as C

    written = []
    real = C.checkpoint
    monkeypatch.setattr(C, "checkpoint", lambda df: written.append(1) or real(df))
    n = 3000
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    assert components(edges).select("root").distinct().collect()[0].root == 0
    assert len(written) <= 5 * np.log2(n)
    star = spark.range(1, 500).selectExpr("500 AS a", "id AS b")
    assert {r.root for r in components(star).collect()} == {1}


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (7, 9), (9, 8)], "a long, b long")
    assert sorted(tuple(r) for r in components(edges).collect()) == [(1, 1), (2, 1), (7, 7), (8, 7), (9, 7)]
    assert components(edges.filter("a = 100")).collect() == []


def test_ink_of_boxes_of_every_size(spark):
    p = picture(6, shape=(90, 70))
    rng = np.random.default_rng(7)
    rows = [("p", i, *map(int, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(rng.integers(-5, 70, 200), rng.integers(-9, 95, 200), rng.integers(0, 80, 200), rng.integers(0, 100, 200)))]
    rows.append(("elsewhere", 900, 0, 0, 9, 9))
    boxes = spark.createDataFrame(rows, "page string, id int, x1 int, y1 int, x2 int, y2 int")
    got = {r.id: r.ink for r in R.box_ink(frame(spark, runs_of(p)), boxes, ["page"], "id").collect()}
    cut = lambda v: max(v, 0)
    assert got == {i: int(p[cut(y1) : cut(y2), cut(x1) : cut(x2)].sum()) if page == "p" else 0 for page, i, x1, y1, x2, y2 in rows}


def test_stems_of_a_drawn_page(spark):
    p = np.zeros((60, 60), bool)
    p[30:34, 10:16] = True  # a head with a stem upwards that has a gap of one row
    p[12:30, 15] = True
    p[20, 15] = False
    p[30:34, 40:46] = True  # a head with a stem down, cut at the limit
    p[34:58, 40] = True
    p[5:8, 25:30] = True  # a head without a stem
    notes = [("p", 1, 10, 30, 6, 4), ("p", 2, 40, 30, 6, 4), ("p", 3, 25, 5, 5, 3)]
    boxes = spark.createDataFrame(notes, "page string, id int, x int, y int, w int, h int")
    columns = R.transpose_runs(frame(spark, runs_of(p)), ["page"])
    got = {r.id: (r.stem_x, r.stem_dir, r.stem_tip_y, r.stem_length) for r in R.trace_stems(columns, boxes, ["page"], "id", 4, 3, 20, 8).collect()}
    assert got[1] == (15, "up", 12, 20.0)
    assert got[2] == (40, "down", 53, 21.0)
    assert got[3][1:] == (None, 6, 0.0)


def test_stabs_and_bands(spark):
    p = np.zeros((60, 40), bool)
    p[10:13, 5:35] = p[16:19, 5:35] = True  # two beams
    p[30:42, 5:35] = True  # too thick
    p[50, 5:35] = True  # a staff line
    columns = R.transpose_runs(frame(spark, runs_of(p)), ["page"])
    probes = spark.createDataFrame([("p", 20, 1, 0, 60), ("p", 20, 2, 11, 17), ("p", 20, 3, 13, 16), ("p", 2, 4, 0, 60), ("p", 20, 5, 9, 9)], "page string, x int, id int, p0 int, p1 int")
    got = {r.id: r.stabs for r in R.stab_count(columns, probes, ["page", "x"], "id", least=2, most=4).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0}
    areas = spark.createDataFrame([("p", 1, 10, 0, 30, 60), ("p", 2, 10, 12, 30, 17), ("p", 3, 36, 0, 39, 60)], "page string, id int, x1 int, y1 int, x2 int, y2 int")
    staff = spark.createDataFrame([("p", 50)], "page string, y int")
    got = {r.id: r.bands for r in R.count_bands(frame(spark, runs_of(p)), areas, ["page"], "id", 0.25, 1, 4, hidden=staff).collect()}
    assert got == {1: 2, 2: 2, 3: 0}


def test_peaks_of_a_chord_and_what_is_none(spark):
    heads = [0, 2, 6, 9, 9, 6, 2, 1, 1, 2, 6, 9, 10, 6, 2, 0]
    rows = [("chord", y, v) for y, v in enumerate(heads)] + [("weak", y, v) for y, v in enumerate([9, 10, 9, 4, 6, 7, 6, 4, 9, 10, 9])] + [("flat", 0, 0)]
    got = {}
    for r in R.profile_peaks(spark.createDataFrame(rows, "k string, y int, ink int"), ["k"], 3, 3).collect():
        got.setdefault(r.k, []).append((r.peak, round(r.centre, 2)))
    assert [p for p, _ in sorted(got["chord"])] == [3, 11] and "flat" not in got
    assert all(abs(c - p) < 1 for p, c in got["chord"])


def test_empty_tables(spark):
    none = frame(spark, [])
    assert R.transpose_runs(none, ["page"]).collect() == []
    assert R.run_components(none, ["page"]).collect() == []
    boxes = spark.createDataFrame([("p", 1, 0, 0, 5, 5)], "page string, id int, x1 int, y1 int, x2 int, y2 int")
    assert R.box_ink(none, boxes, ["page"], "id").collect()[0].ink == 0


def test_rows_in_boxes_from_a_point_to_a_page(spark):
    from pyspark.sql import functions as F

    from glyphline.operators import joins as J

    rng = np.random.default_rng(8)
    points = [("p", i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(0, 400, 600), rng.integers(0, 900, 600)))] + [("q", 900, 5.0, 5.0), ("p", 901, None, 5.0), (None, 902, 5.0, 5.0)]
    boxes = [("p", float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(rng.integers(0, 400, 40), rng.integers(0, 900, 40), rng.choice([0, 1, 7, 60], 40), rng.choice([0, 3, 20, 200], 40))]
    boxes += [("q", 0.0, 0.0, 1e5, 1e5), ("p", 9.0, 9.0, 1.0, 1.0), ("p", None, 1.0, 2.0, 3.0), ("p", 0.0, 500.0, 400.0, 504.0)]
    df = spark.createDataFrame(points, "k string, id int, x double, y double")
    bx = spark.createDataFrame(boxes, "k string, x1 double, y1 double, x2 double, y2 double")
    inside = lambda p, b: p[0] == b[0] and None not in b and p[2] is not None and b[1] - 1 <= p[2] <= b[3] + 1 and b[2] - 1 <= p[3] <= b[4] + 1
    got = sorted(r.id for r in J.box_anti(df, bx, ["k"], "x", "y", 1.0).collect())
    assert got == sorted(p[1] for p in points if not any(inside(p, b) for b in boxes))
    # a page-wide box is a few cells, however many rows there are
    plan = J.box_anti(spark.range(100_000).select(F.lit("p").alias("k"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")), bx.filter("x2 = 1e5"), ["k"], "x", "y", 0.0)
    assert plan.count() == 100_000
