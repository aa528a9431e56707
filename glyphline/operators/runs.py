"""Operators on ink given as runs: row ``y`` of a page is inked from ``x0`` up to, not including, ``x1``.

The same table with the roles changed holds columns: column ``x`` is inked from ``y0`` to ``y1``. Nothing here works
per pixel. Rows of a page meet by sweeps over run ends inside a line, or inside a band of ``BAND`` columns, so that a
page of any number of runs spreads over lines and bands; only what a result lists column by column (``transpose_runs``)
has as many rows as the result. Runs of no length and runs with a null end or line count as no ink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import scan as S
from ..core.components import components
from ..core.skew import deal
from ..session import checkpoint

BAND = 256
# a box is cut into blocks of these many rows, each a look-up in a prefix table of its own
BLOCK, LEVELS = 8, 4
# bytes of runs, by the optimizer's estimate, whose ends are one task's
PART_BYTES = 1 << 19


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if not isinstance(c, Column) else c


def _inked(runs, keys, line="y", lo="x0", hi="x1") -> DataFrame:
    named = [F.col(line).cast("long").alias("__line"), F.col(lo).cast("long").alias("__lo"), F.col(hi).cast("long").alias("__hi")]
    return runs.select(*keys, *named).filter(F.col("__line").isNotNull() & (F.col("__hi") > F.col("__lo")))


def _joined(rows, part, out) -> DataFrame:
    """Overlapping and touching intervals [__lo, __hi) of a line as one."""
    w = W.partitionBy(*part).orderBy("__lo", "__hi")
    reach = F.max("__hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = rows.withColumn("__new", (reach.isNull() | (F.col("__lo") > reach)).cast("int"))
    island = new.withColumn("__i", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    line, lo, hi = out
    one = island.groupBy(*part, "__i").agg(F.min("__lo").alias("__a"), F.max("__hi").alias("__b"))
    return one.select(*part[:-1], F.col(part[-1]).alias(line), F.col("__a").alias(lo), F.col("__b").alias(hi))


def merge_runs(runs, keys, line="y", lo="x0", hi="x1") -> DataFrame:
    """(keys, line, lo, hi): overlapping and touching runs of a line become one. One exchange."""
    part = [*keys, "__line"]
    return _joined(deal(_inked(runs, keys, line, lo, hi), part, needed=False), part, (line, lo, hi))


def combine_runs(first, second, keys, keep, line="y", lo="x0", hi="x1") -> DataFrame:
    """Runs of what ``keep(in_first, in_second)`` takes of each line, as ``merge_runs`` gives them. One exchange.

    ``keep`` gets two boolean columns; it must be false where both are.
    """
    ends = []
    for n, runs in enumerate((first, second)):
        marks = F.explode(F.array(F.struct(F.col("__lo").alias("x"), F.lit(1).alias("d")), F.struct(F.col("__hi").alias("x"), F.lit(-1).alias("d"))))
        e = _inked(runs, keys, line, lo, hi).select(*keys, "__line", marks.alias("e"))
        ends.append(e.select(*keys, "__line", F.col("e.x").alias("__lo"), *[(F.col("e.d") if n == k else F.lit(0)).alias(f"__d{k}") for k in (0, 1)]))
    w = W.partitionBy(*keys, "__line").orderBy("__lo")
    # rows at one place share the frame, so each sees all that starts or ends there
    depth = [F.sum(f"__d{k}").over(w) for k in (0, 1)]
    both = deal(ends[0].unionByName(ends[1]), [*keys, "__line"], PART_BYTES, needed=False)
    steps = both.select(*keys, "__line", "__lo", F.lead("__lo").over(w).alias("__hi"), *[d.alias(f"__n{k}") for k, d in enumerate(depth)])
    taken = steps.filter((F.col("__hi") > F.col("__lo")) & keep(F.col("__n0") > 0, F.col("__n1") > 0)).select(*keys, "__line", "__lo", "__hi")
    return _joined(taken, [*keys, "__line"], (line, lo, hi))


def subtract_runs(first, second, keys, **names) -> DataFrame:
    """Ink of ``first`` that is not in ``second``."""
    return combine_runs(first, second, keys, lambda a, b: a & ~b, **names)


def unite_runs(first, second, keys, **names) -> DataFrame:
    """Ink of either table."""
    return combine_runs(first, second, keys, lambda a, b: a | b, **names)


def transpose_runs(runs, keys, line="y", lo="x0", hi="x1", out=("x", "y0", "y1"), band=BAND) -> DataFrame:
    """(keys, *out): the ink of a page by columns, a row for every maximal run down a column.

    Where a line is inked and the one before is not, runs of columns begin; where it is the other way round, they end.
    Both are found as stretches by one sweep along the line, and a column's begins and ends alternate. Runs are cut at
    bands of ``band`` columns and all sorts happen inside a band of a page: one exchange. Rows given by columns turn into
    rows by lines in the same way.
    """
    cut = _inked(runs, keys, line, lo, hi).withColumn("__band", F.explode(F.sequence(_div("__lo", band), _div(F.col("__hi") - 1, band))))
    cut = cut.select(*keys, "__band", "__line", F.greatest("__lo", F.col("__band") * band).alias("__lo"), F.least("__hi", (F.col("__band") + 1) * band).alias("__hi"))
    mark = lambda x, here, before, by: F.struct((F.col("__line") + by).alias("line"), F.col(x).alias("x"), F.lit(here).alias("here"), F.lit(before).alias("before"))
    marks = F.explode(F.array(mark("__lo", 1, 0, 0), mark("__hi", -1, 0, 0), mark("__lo", 0, 1, 1), mark("__hi", 0, -1, 1)))
    part = [*keys, "__band"]
    ends = deal(cut.select(*part, marks.alias("m")).select(*part, "m.*"), part, PART_BYTES)
    w = W.partitionBy(*part, "line").orderBy("x")
    steps = ends.select(*part, "line", "x", F.lead("x").over(w).alias("x_end"), F.sum("here").over(w).alias("here"), F.sum("before").over(w).alias("before"))
    change = steps.filter((F.col("x_end") > F.col("x")) & ((F.col("here") > 0) != (F.col("before") > 0)))
    cells = change.select(*part, "line", (F.col("here") > 0).alias("begins"), F.explode(F.sequence("x", F.col("x_end") - 1)).alias("x"))
    down = W.partitionBy(*part, "x").orderBy("line")
    whole = cells.select(*keys, F.col("x").alias(out[0]), F.col("line").alias(out[1]), F.lead("line").over(down).alias(out[2]), "begins")
    return whole.filter("begins").drop("begins")


def _div(x, by: int) -> Column:
    """Whole-number division that rounds down."""
    x = _c(x)
    return F.floor((x - F.pmod(x, F.lit(by))) / by).cast("long")


def open_runs(runs, keys, length, across=False, line="y", lo="x0", hi="x1") -> DataFrame:
    """Morphological opening by a line of ``length``: what lies in an unbroken stretch that long.

    Along the rows, or with ``across`` down the columns (by turning the runs round and back). ``length`` may be a column
    of the keys' table. Outside the given runs there is no ink.
    """
    if not across:
        return merge_runs(runs, keys, line, lo, hi).filter(F.col(hi) - F.col(lo) >= length)
    down = transpose_runs(runs, keys, line, lo, hi, out=("__col", "__a", "__b")).filter(F.col("__b") - F.col("__a") >= length)
    back = transpose_runs(down, keys, "__col", "__a", "__b", out=(line, lo, hi))
    return back


def erase_lines(runs, keys, width: int, thick: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lines, symbols): staff and ledger lines of pages ``width`` wide, and the ink without them.

    Staff lines are opened twice by a thirtieth of the width; ledger lines are stretches of a hundredth of it that are
    less than ``thick`` high.
    """
    long, short = width // 30, width // 100
    ink = checkpoint(merge_runs(runs, keys))
    # runs that are merged already are whole stretches
    staff = ink.filter(F.col("x1") - F.col("x0") >= 2 * long - 1)
    level = ink.filter(F.col("x1") - F.col("x0") >= short)
    ledger = subtract_runs(level, open_runs(level, keys, thick, across=True), keys)
    lines = checkpoint(unite_runs(staff, ledger, keys))
    return lines, subtract_runs(ink, lines, keys)


def run_components(runs, keys, connectivity: int = 8) -> DataFrame:
    """(keys, first_y, first_x, x, y, w, h, area, cx, cy) of every connected component of ink.

    first_y, first_x: its first run's place in reading order, which names it; then its box, its ink and the mean place of
    that. Runs of neighbouring rows are linked by one sweep along both: of the runs of the other row that start no later,
    only the last can reach a run, so there are two links a run at most. Corners connect if ``connectivity`` is 8.
    """
    ink = merge_runs(runs, keys).withColumn("__id", F.monotonically_increasing_id())
    ink = checkpoint(ink)
    side = F.explode(F.array(F.struct(F.col("y").alias("line"), F.lit(0).alias("side")), F.struct((F.col("y") + 1).alias("line"), F.lit(1).alias("side"))))
    twice = ink.select(*keys, "x0", "x1", "__id", side.alias("s")).select(*keys, "s.line", "s.side", "x0", "x1", "__id")
    w = W.partitionBy(*keys, "line").orderBy("x0", "side").rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("side") == n, F.struct(F.col("x1").alias("end"), F.col("__id").alias("id"))), True).over(w) for n in (0, 1)]
    seen = twice.select("x0", "__id", F.when(F.col("side") == 0, last[1]).otherwise(last[0]).alias("o"))
    reaches = F.col("o.end") >= F.col("x0") if connectivity == 8 else F.col("o.end") > F.col("x0")
    tree = components(seen.filter(reaches).select(F.col("__id").alias("a"), F.col("o.id").alias("b")))
    named = ink.join(tree, ink["__id"] == tree["node"], "left").withColumn("__root", F.coalesce("root", "__id"))
    n = F.col("x1") - F.col("x0")
    one = named.groupBy(*keys, "__root").agg(
        F.min(F.struct("y", "x0")).alias("__first"),
        F.min("x0").alias("x"),
        F.min("y").alias("y"),
        F.max("x1").alias("__x1"),
        F.max("y").alias("__y1"),
        F.sum(n).alias("area"),
        F.sum((F.col("x0") + F.col("x1") - 1) * n).alias("__sx"),
        F.sum(F.col("y") * n).alias("__sy"),
    )
    return one.select(
        *keys, F.col("__first.y").alias("first_y"), F.col("__first.x0").alias("first_x"), "x", "y", (F.col("__x1") - F.col("x")).alias("w"),
        (F.col("__y1") + 1 - F.col("y")).alias("h"), "area", (F.col("__sx") / (2 * F.col("area"))).alias("cx"), (F.col("__sy") / F.col("area")).alias("cy"),
    )


def chains(columns, keys, gap) -> DataFrame:
    """``columns`` with ``top`` and ``bottom`` of the chain each run belongs to: runs of a column less than ``gap`` apart."""
    w = W.partitionBy(*keys, "x").orderBy("y0", "y1")
    reach = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = columns.withColumn("__new", (reach.isNull() | (F.col("y0") - reach >= gap)).cast("int"))
    island = new.withColumn("__i", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(*keys, "x", "__i")
    return island.withColumns({"top": F.min("y0").over(whole), "bottom": F.max("y1").over(whole)}).drop("__new", "__i")


def trace_stems(columns, boxes, keys, box_id, reach, gap, limit, least) -> DataFrame:
    """``boxes`` with stem_x, stem_dir, stem_tip_y, stem_length: the longest chain of ink that goes on from a box.

    ``columns``: (keys, x, y0, y1), the ink by columns. ``boxes``: keys, id, x, y, w, h. Within ``reach`` columns of the
    box's middle, a chain counts upward if it comes within ``gap`` rows of the box's top, downward at its bottom; it is
    followed for ``limit`` rows at most. The longest wins in each direction, then the nearest to the middle, then the
    left one. The stem goes the way that is longer, measured from the middle of the height (up if equal); one shorter than
    ``least`` is none (null direction, tip at the middle, length 0). ``reach``, ``gap``, ``limit`` and ``least`` are numbers
    or, for reach, limit and least, columns of ``boxes``. One sweep down the columns finds the chains for all boxes.
    """
    ink = chains(columns.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("x", "y0", "y1")]), keys, gap)
    runs = ink.select(*keys, "x", F.col("y0").alias("__at"), F.lit(1).alias("__side"), F.struct("y0", "y1", "top", "bottom").alias("__run"))
    box = boxes.select(*keys, box_id, *[F.col(c).cast("long").alias(c) for c in "xywh"], _c(reach).cast("long").alias("__r"), _c(limit).cast("long").alias("__m"), _c(least).cast("double").alias("__least"))
    box = box.withColumn("__mid", F.col("x") + _div("w", 2))
    ends = F.array(F.struct(F.col("y").alias("at"), F.lit(0).alias("side")), F.struct((F.col("y") + F.col("h")).alias("at"), F.lit(2).alias("side")))
    asked = box.select(*keys, box_id, "__mid", "__m", F.explode(F.sequence(F.col("__mid") - F.col("__r"), F.col("__mid") + F.col("__r"))).alias("x"), ends.alias("e"))
    asked = asked.select(*keys, "x", F.struct(box_id, F.col("__mid").alias("mid"), F.col("__m").alias("limit")).alias("__ask"), F.explode("e").alias("e"))
    asked = asked.select(*keys, "x", F.col("e.at").alias("__at"), F.col("e.side").alias("__side"), "__ask")
    both = runs.unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy(*keys, "x").orderBy("__at", "__side")
    back = W.partitionBy(*keys, "x").orderBy(F.col("__at").desc(), F.col("__side").desc())
    met = both.select("*", F.last("__run", True).over(w).alias("__prev"), F.last("__run", True).over(back).alias("__next")).filter(F.col("__side") != 1)
    at, limit_ = F.col("__at"), F.col("__ask.limit")
    up = F.when((F.col("__prev.y1") > at - gap), at - F.greatest(F.col("__prev.top"), at - limit_))
    covers = F.col("__prev.y1") > at
    down = F.when(covers, F.least(F.col("__prev.bottom"), at + limit_) - at).when(F.col("__next.y0") < at + gap, F.least(F.col("__next.bottom"), at + limit_) - at)
    long = met.select(*keys, F.col(f"__ask.{box_id}").alias(box_id), "x", F.abs(F.col("x") - F.col("__ask.mid")).alias("far"), (F.col("__side") == 0).alias("up"),
                      F.coalesce(F.when(F.col("__side") == 0, up).otherwise(down), F.lit(0)).alias("n"))
    pick = lambda up: F.max(F.when(F.col("up") == up, F.struct("n", (-F.col("far")).alias("near"), (-F.col("x")).alias("left"))))
    best = long.groupBy(*keys, box_id).agg(pick(True).alias("__u"), pick(False).alias("__d"))
    out = boxes.join(best, [*keys, box_id]).join(box.select(*keys, box_id, "__least", "__mid"), [*keys, box_id])
    middle = F.col("y").cast("long") + _div("h", 2)
    top, bottom = F.col("y") - F.col("__u.n"), F.col("y") + F.col("h") + F.col("__d.n")
    rise, fall = middle - top, bottom - 1 - middle
    goes_up = rise >= fall
    length = F.when(goes_up, rise).otherwise(fall).cast("double")
    none = length < F.col("__least")
    chosen = F.when(goes_up, -F.col("__u.left")).otherwise(-F.col("__d.left"))
    return out.select(
        *[boxes[c] for c in boxes.columns],
        chosen.alias("stem_x"),
        F.when(~none, F.when(goes_up, "up").otherwise("down")).alias("stem_dir"),
        F.when(none, middle).when(goes_up, top).otherwise(bottom - 1).alias("stem_tip_y"),
        F.when(none, F.lit(0.0)).otherwise(length).alias("stem_length"),
    )


def stab_count(runs, probes, keys, probe_id, lo="y0", hi="y1", least=1, most=None, name="stabs") -> DataFrame:
    """``probes`` with the number of runs of a thickness between ``least`` and ``most`` that they cross.

    ``probes``: keys, id, p0, p1; a run [lo, hi) of the same keys (a page's column, say) is crossed if it meets [p0, p1).
    What starts before p1 less what ends up to p0: one sweep counts starts and ends for all probes, and no pair is made.
    Probes at one place are counted once.
    """
    at = ["p0", "p1"]
    places = probes.filter(F.col("p1") > F.col("p0")).select(*keys, *[F.col(c).cast("double").alias(c) for c in at]).distinct()
    size = F.col(hi) - F.col(lo)
    fits = (size >= least) & (F.lit(True) if most is None else size <= most) & (size > 0)
    mark = lambda at, side, of=None: F.struct(F.col(at).cast("double").alias("at"), F.lit(side).alias("side"))
    place = lambda p0, p1: F.struct(F.col(p0).alias("p0"), F.col(p1).alias("p1")) if p0 else F.lit(None).cast("struct<p0:double,p1:double>")
    ends = runs.filter(fits).select(*keys, F.explode(F.array(mark(lo, 3), mark(hi, 0))).alias("m"), place(None, None).alias("__place"))
    asks = places.select(*keys, F.explode(F.array(mark("p0", 1), mark("p1", 2))).alias("m"), place(*at).alias("__place"))
    both = ends.unionByName(asks).select(*keys, "__place", F.col("m.at").alias("__at"), F.col("m.side").alias("__side"), F.xxhash64("__place").alias("__t"))
    one = lambda side: F.when(F.col("__side") == side, 1).otherwise(0).cast("long")
    seen = S.scan(both, keys, ["__at", "__side", "__t"], __starts=S.run_sum(one(3)), __ends=S.run_sum(one(0)))
    value = F.when(F.col("__side") == 2, F.col("__starts")).otherwise(-F.col("__ends"))
    count = seen.filter(F.col("__side").isin(1, 2)).groupBy(*keys, "__place").agg(F.sum(value).alias(name))
    count = count.select(*keys, F.col("__place.p0").alias("__p0"), F.col("__place.p1").alias("__p1"), name)
    return _at_places(probes, count, keys, at, "double").withColumn(name, F.coalesce(name, F.lit(0)))


def _at_level(numbers: Column, level: int) -> Column:
    return F.transform(numbers, lambda n: F.struct(F.lit(level), n)).cast("array<struct<level:int,block:bigint>>")


def _blocks(lo: Column, hi: Column) -> Column:
    """Blocks (level, number) that make up the rows [lo, hi): few, whatever the height, as large ones go in the middle."""
    parts = []
    a, b = lo, hi
    for level in range(LEVELS):
        up = BLOCK ** (level + 1)
        if level == LEVELS - 1:
            runs = [(a, b)]
        else:
            na, nb = _div(lo + (up - 1), up), _div(hi, up)
            inside = na < nb
            runs = [(a, F.when(inside, na * BLOCK).otherwise(b)), (F.when(inside, nb * BLOCK).otherwise(b), b)]
        for x, y in runs:
            numbers = F.when(y > x, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(_at_level(numbers, level))
        if level < LEVELS - 1:
            a, b = F.when(inside, na).otherwise(F.lit(0)), F.when(inside, nb).otherwise(F.lit(0))
    return F.flatten(F.array(*parts))


def _places(rows, keys, at: list[str]) -> DataFrame:
    """The distinct places of ``rows``: boxes at one place have one answer, which is found once."""
    return rows.select(*keys, *[F.col(c).cast("long").alias(f"__{c}") for c in at]).distinct()


def _at_places(rows, found, keys, at: list[str], kind="long") -> DataFrame:
    """``rows`` with the further columns of ``found``, (keys, place, ...), where there is such a place."""
    named = found.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {f"__{c}": f"__found_{c}" for c in at})
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(c).cast(kind) == F.col(f"__found_{c}") for c in at]
    return rows.join(named, same, "left").drop(*[f"__k_{k}" for k in keys], *[f"__found_{c}" for c in at])


def box_ink(runs, boxes, keys, box_id, x1="x1", y1="y1", x2="x2", y2="y2", name="ink") -> DataFrame:
    """``boxes`` with the ink in [x1, x2) x [y1, y2), in pixels. Runs of a row must not overlap (``merge_runs``).

    A prefix table over run ends: ink left of X in a block of rows is the sum, over run ends before X, of their distance
    to X, added where runs start and taken off where they end. Blocks are rows, and 8, 64, 512 of them; a box is
    two look-ups in each block it is made of. Runs and look-ups meet in one exchange on the largest block, where a run is
    one row and is dropped if no box asks for that block, and the table is one running sum. Boxes at one place are looked up
    once. Empty boxes have no ink.
    """
    at = [x1, y1, x2, y2]
    found = _place_ink(runs, _places(boxes, keys, at).toDF(*keys, "x1", "y1", "x2", "y2"), keys, name)
    found = found.toDF(*keys, *[f"__{c}" for c in at], name)
    return _at_places(boxes, found, keys, at).withColumn(name, F.coalesce(name, F.lit(0)))


def _place_ink(runs, places, keys, name="ink") -> DataFrame:
    """(keys, x1, y1, x2, y2, ink) of distinct places that are not empty."""
    at = ["x1", "y1", "x2", "y2"]
    top = LEVELS - 1
    ink = _inked(runs, keys).select(*keys, _div("__line", BLOCK**top).alias("__band"), "__line", "__lo", "__hi")
    asks = places.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    asks = asks.select(*keys, F.struct(*at).alias("__place"), F.explode(_blocks(F.col("y1"), F.col("y2"))).alias("b"))
    band = F.coalesce(*[F.when(F.col("b.level") == n, _div("b.block", BLOCK ** (top - n))) for n in range(LEVELS)])
    looks = F.array(*[F.struct(F.col("__place")[x].alias("at"), F.lit(k).alias("by")) for x, k in (("x1", -1), ("x2", 1))])
    asks = asks.select(*keys, band.alias("__band"), "__place", "b", F.explode(looks).alias("q")).select(*keys, "__band", "__place", "b.level", "b.block", "q.at", "q.by")
    # a band is a block of the highest level: a run goes there once, and becomes ends in blocks only where a box asks for some
    part = [*keys, "__band"]
    met = deal(ink.unionByName(asks, allowMissingColumns=True), part)
    met = met.withColumn("__asked", F.max("by").over(W.partitionBy(*part))).filter(F.col("__asked").isNotNull())
    cell = lambda level, block, at, s: F.struct(level.cast("int").alias("level"), block.alias("block"), at.cast("long").alias("at"), F.lit(s).cast("int").alias("s"), (at * F.lit(s)).cast("long").alias("t"))
    ends = F.array(*[cell(F.lit(n), _div("__line", BLOCK**n), F.col(x), s) for n in range(LEVELS) for x, s in (("__lo", 1), ("__hi", -1))])
    rows = F.when(F.col("by").isNull(), ends).otherwise(F.array(cell(F.col("level"), F.col("block"), F.col("at"), None)))
    met = met.select(*part, "__place", "by", F.explode(rows).alias("e")).select(*part, "__place", "by", "e.*")
    w = W.partitionBy(*part, "level", "block").orderBy("at")
    seen = met.select("*", F.sum("s").over(w).alias("__s"), F.sum("t").over(w).alias("__t"))
    value = F.col("by") * (F.col("at") * F.coalesce("__s", F.lit(0)) - F.coalesce("__t", F.lit(0)))
    found = seen.filter(F.col("by").isNotNull()).groupBy(*keys, "__place").agg(F.sum(value).alias(name))
    return found.select(*keys, *[F.col("__place")[c].alias(c) for c in at], name)


def bar_score(runs, bars, keys, bar_id, half_width: int = 2) -> DataFrame:
    """``bars`` with density and half_score of a vertical line at ``x`` from row ``top`` to ``bottom``.

    density: the fullest of the columns within ``half_width``; half_score: the lesser of the two halves' fullest
    columns. A barline fills both halves of a staff, a stem only one. Bars at one place are judged once, and a column's two
    halves make up its whole.
    """
    at = ["x", "top", "bottom"]
    places = _places(bars, keys, at)
    middle = F.col("__top") + _div(F.col("__bottom") - F.col("__top"), 2)
    part = lambda n, a, z: F.struct(F.lit(n).alias("half"), a.alias("y1"), z.alias("y2"))
    halves = F.explode(F.array(part(1, F.col("__top"), middle), part(2, middle, F.col("__bottom"))))
    columns = F.explode(F.sequence(F.greatest(F.col("__x") - half_width, F.lit(0)), F.col("__x") + half_width))
    strips = places.select(*keys, "__x", "__top", "__bottom", columns.alias("x1"), halves.alias("p"))
    strips = strips.select(*keys, "__x", "__top", "__bottom", "x1", (F.col("x1") + 1).alias("x2"), "p.half", "p.y1", "p.y2")
    ink = box_ink(runs, strips, keys, None)
    of = lambda n: F.sum(F.when(F.col("half") == n, F.col("ink")))
    rows = lambda n: F.max(F.when(F.col("half") == n, F.col("y2") - F.col("y1")))
    column = ink.groupBy(*keys, "__x", "__top", "__bottom", "x1").agg(of(1).alias("i1"), of(2).alias("i2"), rows(1).alias("n1"), rows(2).alias("n2"))
    most = lambda i, n: F.coalesce(F.max(i / F.nullif(n, F.lit(0))), F.lit(0.0))
    up, down = most(F.col("i1"), F.col("n1")), most(F.col("i2"), F.col("n2"))
    whole = most(F.col("i1") + F.col("i2"), F.col("n1") + F.col("n2"))
    found = column.groupBy(*keys, "__x", "__top", "__bottom").agg(whole.alias("density"), F.least(up, down).alias("half_score"))
    return _at_places(bars, found, keys, at).filter(F.col("density").isNotNull())


def solid_boxes(runs, boxes, keys, box_id, least: float) -> DataFrame:
    """``boxes`` whose share of ink is at least ``least``, with that share as ``fill``; an empty box is not solid."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    empty = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    fill = F.when(~empty, F.col("ink") / area)
    return box_ink(runs, boxes, keys, box_id).withColumn("fill", fill).drop("ink").filter(F.col("fill") >= least)


def count_bands(runs, probes, keys, probe_id, share, least, most, hidden=None) -> DataFrame:
    """``probes`` with bands: how many bands of rows, ``least`` to ``most`` rows thick, are inked over ``share`` of a box's width.

    ``probes``: keys, id, x1, y1, x2, y2 around a stem's tip; beams are such bands. ``hidden`` (keys, y) lists rows that
    count as empty, those of staff lines. A box's rows are look-ups of one row each; boxes at one place are judged once.
    """
    at = ["x1", "y1", "x2", "y2"]
    places = _places(probes, keys, at).filter((F.col("__x2") > F.col("__x1")) & (F.col("__y2") > F.col("__y1")))
    rows = places.select(*keys, *[f"__{c}" for c in at], F.col("__x1").alias("x1"), F.col("__x2").alias("x2"), F.explode(F.sequence(F.col("__y1"), F.col("__y2") - 1)).alias("y1"))
    rows = rows.withColumn("y2", F.col("y1") + 1)
    if hidden is not None:
        dark = hidden.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("y").cast("long").alias("__h_y")).distinct()
        same = F.col("y1") == F.col("__h_y")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        rows = rows.join(dark, same, "left_anti")
    full = box_ink(runs, rows, keys, None).filter(F.col("ink") > share * (F.col("x2") - F.col("x1"))).withColumnRenamed("y1", "y")
    place = [*keys, *[f"__{c}" for c in at]]
    w = W.partitionBy(*place).orderBy("y")
    islands = full.withColumn("__i", F.col("y") - F.row_number().over(w)).groupBy(*place, "__i").agg(F.count(F.lit(1)).alias("__n"))
    count = islands.filter(F.col("__n").between(least, most)).groupBy(*place).agg(F.count(F.lit(1)).alias("bands"))
    return _at_places(probes, count, keys, at).withColumn("bands", F.coalesce("bands", F.lit(0)))


def profile_peaks(profile, keys, near: float, half: int, y="y", value="ink", least=0.65, local=0.95, floor=0.25, weak=0.80) -> DataFrame:
    """(keys, peak, height, centre) of the peaks of a step profile (a value per row), at least ``near`` apart.

    The profile is smoothed over three rows. Rows that are within ``local`` of the highest of two rows to either side
    and above ``floor`` of the whole height are candidates; candidates less than ``near`` apart are one peak at their highest
    (the first of equals); peaks under ``least`` of the highest go, and so do those under ``weak`` of both neighbours.
    ``centre`` is the mean row within ``half`` rows, weighted by the profile. Rows not listed are empty; all windows have
    one order, so the profile is sorted once.
    """
    order = W.partitionBy(*keys).orderBy("__y")
    given = profile.select(*keys, F.col(y).cast("long").alias("__y"), F.col(value).cast("double").alias("__v"))
    # an empty row beside ink is not empty any more once smoothed
    spread = given.select(*keys, F.explode(F.array(*[F.struct((F.col("__y") + d).alias("y"), F.when(F.lit(d == 0), F.col("__v")).otherwise(0.0).alias("v"), (F.col("__v") / 3).alias("s")) for d in (-1, 0, 1)])).alias("r"))
    dense = spread.groupBy(*keys, F.col("r.y").alias("__y")).agg(F.sum("r.v").alias("__v"), F.sum(F.col("r.s")).alias("__s"))
    bounds = W.partitionBy(*keys)
    inner = F.when(F.col("__v") > 0, F.col("__y"))
    dense = dense.withColumns({"__lo": F.min(inner).over(bounds), "__hi": F.max(inner).over(bounds)}).filter(F.col("__y").between(F.col("__lo"), F.col("__hi")))
    around = order.rangeBetween(-half, half)
    seen = dense.withColumns({
        "__near": F.max("__s").over(order.rangeBetween(-2, 2)), "__top": F.max("__s").over(bounds),
        "__w": F.sum("__s").over(around), "__wy": F.sum(F.col("__s") * F.col("__y")).over(around),
    })
    inside = F.col("__y").between(F.col("__lo") + 2, F.col("__hi") - 2)
    some = seen.filter(inside & (F.col("__s") >= local * F.col("__near")) & (F.col("__s") > floor * F.col("__top")))
    step = F.col("__y") - F.lag("__y").over(order)
    group = some.withColumn("__new", (step.isNull() | (step >= near)).cast("int")).withColumn("__g", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    best = group.groupBy(*keys, "__g").agg(F.max_by(F.struct("__y", "__s", "__top", (F.col("__wy") / F.col("__w")).alias("c")), F.struct("__s", -F.col("__y"))).alias("b")).select(*keys, "b.*")
    best = best.filter(F.col("__s") >= least * F.col("__top"))
    before, after = F.lag("__s").over(order), F.lead("__s").over(order)
    clean = best.withColumn("__weak", F.coalesce((F.col("__s") < weak * before) & (F.col("__s") < weak * after), F.lit(False)))
    return clean.filter(~F.col("__weak")).select(*keys, F.col("__y").alias("peak"), F.col("__s").alias("height"), F.col("c").alias("centre"))
