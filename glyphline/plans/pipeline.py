"""Whole pipelines: detections to measures, text and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..core import scan as S
from ..functions import scalar as N
from ..core.skew import PART_ROWS, probed, spread
from ..operators import aggregates as A
from ..operators import budget as R
from ..operators import confidence as C
from ..operators import dedupe as D
from ..operators import filters as P
from ..operators import groups as G
from ..operators import joins as J
from ..operators import sequences as Q
from ..operators import sets as U
from ..session import checkpoint
from .registry import ev


def event_budget_report(spark, sf) -> DataFrame:
    """The flagship query: per session, values of de-duplicated events against a budget."""
    e = D.nms_center(ev(spark, sf), ["k"], "x", None, "y", "id", 0.5)
    purchases = e.filter("typ = 'purchase'")
    rows = J.segment_by_boundary(e.filter("typ <> 'purchase'"), purchases, ["k"], "x", "x", "id")
    rows = Q.gap_cluster(rows, ["k"], "x", "id", 24.0)
    b = A.budget_check(rows, ["k", "measure_idx"], F.col("y"), F.lit(100.0), tolerance=50.0)
    return A.rollup_totals(b.withColumns({"bad": F.col("off").cast("long"), "one": F.lit(1).cast("long")}), ["measure_idx"], "bad", "one")


def page_pitches(notes: DataFrame, systems: DataFrame, pages: DataFrame) -> DataFrame:
    """Noteheads with the staff they belong to and their pitch.

    ``notes``: score_id, page, note_id, x, y_center, score, ...; ``systems``: score_id,
    page, system, y (five lines); ``pages``: score_id, page, dy, img_w.
    """
    page = ["score_id", "page"]
    s = systems.select(*page, "system", "y", ((F.element_at("y", 1) + F.element_at("y", 5)) / 2.0).alias("centre"))
    n = J.nearest_assign(notes, s, page, "y_center", "centre", "system", "note_id")
    # a page's staves and its spacing are a few values: these joins do not grow a row
    n = n.join(s.drop("centre"), [*page, "system"]).join(pages.select(*page, "dy"), page)
    n = n.filter(F.col("dist") < F.col("dy") * 8).withColumn("clef", F.coalesce("clef", F.lit("treble")))
    n = P.tier_filter(n, "y_center", F.element_at("y", 1), F.element_at("y", 5), "score", "dy", "clef")
    idx = N.nearest_index("y_center", N.grid("y", 10), 10)
    n = n.withColumn("p", N.pitch_parts(idx, "clef"))
    return n.withColumns({"degree": F.col("p.degree"), "octave": F.col("p.octave"), "pitch": N.pitch_text("p.degree", "p.octave")}).drop("p", "dist")


def staff_measures(units, rests, barlines, anchors, keys, first_staff, default_beats=2.0, slack=0.05, fill=True, markers=None) -> DataFrame:
    """Events of every measure with reconciled durations.

    All positions are in units of the page's line spacing, so one set of distances serves
    pages of any size. ``keys`` name a staff.
    ``units``: keys, unit_id, x, dur, score, ys ARRAY, evidence. ``rests``: keys, rest_id,
    x, duration. ``barlines``: keys, x. ``anchors``: keys, x, bpm. ``first_staff`` is a
    Column on the keys telling where a pickup measure may stand. ``markers`` (keys, marker_id, x, n) are tuplet figures:
    each belongs to the measure whose notes it stands over, and the measure takes the reading that fills it best; units
    may bring ``idurs``, the durations of their members.
    Result: keys, measure_idx, event_id, x, type, duration, source; an event id is twice the
    unit id, twice the rest id plus one, or null for events put in.
    """
    mk = [*keys, "measure_idx"]
    with probed(units, keys):
        kept = R.clean_then_dedupe(rests, units, keys, "x", "rest_id", 1.0).select(*keys, "rest_id")
        r = rests.join(kept, [*keys, "rest_id"], "left_semi")
        ev = U.typed_union({
            "note_unit": units.withColumn("event_id", F.col("unit_id") * 2),
            "rest": r.withColumnRenamed("duration", "dur").withColumn("event_id", F.col("rest_id") * 2 + 1)})
        ev = ev.withColumns({"x": F.col("x").cast("double"), "ys": F.coalesce("ys", F.array().cast("array<double>"))}).drop("unit_id", "rest_id")
        bars = barlines.select(*keys, F.col("x").cast("double").alias("bx")).distinct()
        n_bars = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"), F.min("bx").alias("first_bar"))
        ev = J.segment_by_boundary(ev, bars, keys, "x", "bx", "event_id")
        ev = J.neighbours(ev, bars, keys, "x", "bx", "event_id").withColumn("edge", F.col("__next.at")).drop("__prev", "__next")
        ev = Q.tail_merge(ev.join(n_bars, keys), keys, "measure_idx", "n_bars", "x", "event_id", 1.0, F.col("type") == "rest", "ys")
        starts = ev.groupBy(*mk).agg(F.min("x").alias("x"))
        caps = J.asof_backward(starts, anchors, keys, "x", "x", "bpm", "measure_idx", default_beats, slack).select(*mk, F.col("bpm").alias("cap"))
        # the stages below read their input several times: each is written once
        ev = checkpoint(ev.join(caps, mk))
        caps = ev.select(*mk, "cap").distinct()
        rest = F.col("type") == "rest"
        ev = S.scan(ev, mk, ["x", "event_id"], rb=S.total("sum", F.when(rest, F.coalesce("dur", F.lit(1.0))).otherwise(0.0)),
                    n=S.total("sum", (~rest).cast("long")))
        notes = ev.filter(~rest).withColumn("duration", F.col("dur"))
        first = first_staff & (F.col("measure_idx") == 0)
        p = R.pickup_group(notes.drop("type"), mk, "first_bar", "x", first, ["x", "event_id"])
        out = ["event_id", "x", "type", "duration", "source", "score"]
        pick = p.filter("pickup").withColumn("source", F.lit("pickup")).select(*mk, *out)
        notes = p.filter("NOT pickup")
        notes = checkpoint(R.evidence_leads(notes, mk, ["x", "event_id"], "dur", "cap", "rb"))
        one = R.single_fill(notes.filter("n = 1"), mk, ["x", "event_id"], "dur", "cap", "rb", F.col("evidence")).select(*mk, *out)
        # some twenty sorts follow one exchange: its parts are held to a number of rows
        led = spread(notes.filter("leads AND n >= 2").drop("duration"), mk, part_rows=PART_ROWS)
        led = R.measure_budget(led, mk, "x", "event_id", "dur", "cap", "rb", "edge", F.col("evidence"))
        led = led.withColumnRenamed("dur", "duration").select(*mk, *out)
        free = notes.filter("NOT leads AND n >= 2").drop("duration", "source").withColumn("rem", F.greatest(F.lit(0.25), F.col("cap") - F.col("rb")))
        free = R.proportional_alloc(free, mk, "x", "event_id", "rem", "edge", F.col("dur") >= 2.0, "dur", F.array("dur")).select(*mk, *out)
        notes = pick.unionByName(one).unionByName(led).unionByName(free)
        notes = notes.join(caps, mk)
        if markers is not None:
            notes = read_tuplets(notes, ev, markers, keys)
        notes = checkpoint(notes)
        # one put-in rest per pickup measure has no id; ids stay unique inside a measure
        notes = notes.withColumn("rid", F.coalesce("event_id", F.lit(-1).cast("long")))
        suspect = F.abs(F.coalesce("score", F.lit(1.0)) - 0.80) < 0.02
        ok = R.overflow_prune(notes, mk, ["x", "rid"], "rid", "duration", suspect & (F.col("type") == "note_unit"), "cap")
        notes = notes.join(ok, [*mk, "rid"], "left_semi").drop("rid")
        lone = ev.filter(rest).select(*mk, "event_id", "x", "type", F.coalesce("dur", F.lit(1.0)).alias("duration"), F.lit("rest_detected").alias("source"),
                                      F.lit(None).cast("double").alias("score"), "cap", "edge")
        d = notes.withColumn("edge", F.lit(None).cast("double")).unionByName(lone)
        # pickup rests are part of the measure's beats, not rests to adjust
        is_rest = (F.col("type") == "rest") & F.col("event_id").isNotNull()
        d = R.dominant_drop(d, mk, ["x", "event_id"], "duration", is_rest)
        d = checkpoint(d.withColumn("fixed", ~is_rest))
        adj = checkpoint(R.rest_adjust(d, mk, "x", "event_id", ~F.col("fixed"), "duration", "cap", "edge", 1.0))
        # measures without room keep their rests as detected
        full = d.filter(~F.col("fixed")).join(adj.select(*mk).distinct(), mk, "left_anti")
        events = d.filter("fixed").select(*mk, *out).unionByName(
            adj.select(*mk, "event_id", "x", F.lit("rest").alias("type"), "duration", "source", F.lit(None).cast("double").alias("score"))).unionByName(
            full.select(*mk, *out))
        if fill:
            m = events.groupBy(*mk).agg(F.sum("duration").alias("beats"), F.max("x").alias("hi")).join(caps, mk)
            m = m.withColumns({"gap": F.col("cap") - F.col("beats"), "anchor": F.col("hi") + slack})
            f = R.gap_fill(m, mk, "beats", "gap", "anchor", F.lit(1e9), "cap", F.lit(False), 1.0)
            events = events.unionByName(f.select(*mk, F.lit(None).cast("long").alias("event_id"), (F.col("x") + (slack - 1) * F.col("i")).alias("x"),
                                                 F.lit("rest").alias("type"), "duration", F.lit("fill_to_measure").alias("source"), F.lit(None).cast("double").alias("score")))
            events = events.unionByName(empty_measures(events, bars, anchors, keys, default_beats, slack))
    return events


def read_tuplets(notes, ev, markers, keys) -> DataFrame:
    """``notes`` of measures with estimated durations, those under and beside tuplet markers read as tuplets.

    ``ev``: the events of the measures with dur and rb (beats of detected rests), and idurs where units have them.
    """
    mk = [*keys, "measure_idx"]
    units = ev.filter(F.col("type") == "note_unit")
    own = F.array(F.coalesce("dur", F.lit(0.25)))
    if "idurs" in ev.columns:
        own = F.when(F.size("idurs") > 0, F.col("idurs")).otherwise(own)
    pool = units.select(*mk, "event_id", "x", own.alias("idurs"), "rb", "cap")
    marks = J.midpoint_bind(markers.withColumn("x", F.col("x").cast("double")), pool, keys, "measure_idx", "x", "x", "marker_id")
    # of the markers as read: looking it up in those bound to measures would bind them twice
    longest = markers.agg(F.max("n")).first()[0] or 0
    read = R.choose_interpretation(pool, marks.withColumnRenamed("x", "mx"), mk, "x", "event_id", "idurs", "rb", "cap", "mx", "n", "marker_id", longest)
    read = read.select(*[F.col(c).alias(f"__t_{c}") for c in [*mk, "event_id", "duration", "source"]])
    same = [F.col(c) == F.col(f"__t_{c}") for c in [*mk, "event_id"]]
    both = notes.join(read, reduce(lambda a, b: a & b, same), "left")
    kept = [F.coalesce(f"__t_{c}", c).alias(c) if c in ("duration", "source") else F.col(c) for c in notes.columns]
    return both.select(*kept)


def empty_measures(events, bars, anchors, keys, default_beats, slack) -> DataFrame:
    """Rests for measures without an event before measures that have some; those at the end stay out.

    ``bars``: keys, bx. The first measure goes from 0 to the first bar. A narrow one (under 3 line spacings a beat) stays empty.
    """
    mk = [*keys, "measure_idx"]
    # the page's edge opens measure 0
    edges = bars.withColumn("__edge", F.lit(1)).unionByName(bars.select(*keys).distinct().withColumns({"bx": F.lit(0.0), "__edge": F.lit(0)}))
    m = S.scan(edges, keys, ["__edge", "bx"], measure_idx=S.row_number(), right=S.lead("bx")).drop("__edge")
    m = m.withColumn("measure_idx", F.col("measure_idx") - 1)
    last = events.groupBy(*keys).agg(F.max("measure_idx").alias("last"))
    m = m.join(last, keys).filter(F.col("measure_idx") < F.col("last")).join(events.select(*mk).distinct(), mk, "left_anti")
    m = m.select(*mk, F.col("bx").alias("x"), (F.col("right") - F.col("bx")).alias("width"))
    m = J.asof_backward(m, anchors, keys, "x", "x", "bpm", "measure_idx", default_beats, slack)
    f = R.gap_fill(m, mk, F.lit(0.0), "bpm", "x", "width", "bpm", F.lit(True), 1.0)
    return f.select(*mk, F.lit(None).cast("long").alias("event_id"), (F.col("x") + slack + (slack - 1) * F.col("i")).alias("x"), F.lit("rest").alias("type"),
                    "duration", F.lit("fill_to_measure").alias("source"), F.lit(None).cast("double").alias("score"))


def measures_to_text(members: DataFrame, rests: DataFrame, keysigs: DataFrame) -> DataFrame:
    """Measures as text.

    ``members``: doc, clef, line, measure_no, unit_id, unit_x, duration, note_id, x, dy,
    degree, octave, pitch, sign (nullable). ``rests``: doc, clef, line, measure_no, rest_id, x,
    duration. ``keysigs``: doc, sign, degrees.
    """
    m = ["doc", "clef", "line", "measure_no"]
    d = members.join(keysigs.select("doc", F.col("sign").alias("ks"), "degrees"), "doc", "left")
    key_sign = F.when(F.array_contains("degrees", F.col("degree").cast("int")), F.col("ks"))
    d = Q.gap_expiring_fill(d, [*m, "pitch"], "x", "note_id", "sign", key_sign, F.col("dy") * 5.0)
    text = F.concat("shown", "pitch")
    # members from low to high
    d = d.withColumn("__step", F.col("degree") + F.col("octave") * 7)
    u = A.chord_text(d, [*m, "unit_id", "unit_x"], ["__step", "note_id"], text, "duration")
    u = u.select(*m, F.col("unit_x").cast("double").alias("x"), F.col("unit_id").alias("i"), F.col("text").alias("t"))
    r = rests.select(*m, F.col("x").cast("double").alias("x"), F.col("rest_id").alias("i"), N.rest_text("duration").alias("t"))
    return A.ordered_concat(u.unionByName(r), m, ["x", "i"], "t", " ")


def measure_lines(measures: DataFrame, texts: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Lines of ``measures`` (doc, clef, line, measure_no, n): text between bars.

    ``texts`` is what ``measures_to_text`` gives. A measure without events is ``0 0``; one that stands for ``n`` measures of
    rest (null otherwise) ends in ``×n``. With ``skip_empty`` measures that read ``0 0`` are left out.
    """
    m = ["doc", "clef", "line", "measure_no"]
    text = F.coalesce("text", F.lit("0 0"))
    d = measures.join(texts.select(*m, "text"), m, "left").withColumn("text", F.concat(text, F.when(F.col("n").isNotNull(), F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise("")))
    if skip_empty:
        d = d.filter(F.col("text") != "0 0")
    return d.select(*m, F.concat(F.lit("|"), "text", F.lit("|")).alias("text"))


def staff_lines(units, rests, barlines, anchors, keys, first_staff, skip_empty=True, **how) -> DataFrame:
    """(keys, text): the measures of a staff from detections to text, as one line between bars.

    Takes what ``staff_measures`` takes, with a column ``pitch`` (the chord's text) on units. Measures read ``0 0`` where
    they hold nothing; with ``skip_empty`` such measures are left out.
    """
    mk = [*keys, "measure_idx"]
    events = staff_measures(units, rests, barlines, anchors, keys, first_staff, **how)
    names = units.select(*keys, (F.col("unit_id") * 2).alias("event_id"), "pitch")
    events = checkpoint(events.join(names, [*keys, "event_id"], "left"))
    note = F.concat(F.coalesce("pitch", F.lit("0")), N.duration_suffix("duration"))
    text = F.when(F.col("type") == "note_unit", note).otherwise(N.rest_text("duration"))
    order = F.coalesce("event_id", F.lit(-1).cast("long"))
    one = A.ordered_concat(events.select(*mk, "x", order.alias("i"), text.alias("t")), mk, ["x", "i", "t"], "t", " ")
    last = one.groupBy(*keys).agg(F.max("measure_idx").alias("last"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("measure_idx"))
    one = every.join(one.withColumn("measure_idx", F.col("measure_idx").cast("long")), mk, "left").withColumn("text", F.coalesce("text", F.lit("0 0")))
    if skip_empty:
        one = one.filter(F.col("text") != "0 0")
    lined = A.ordered_concat(one, keys, ["measure_idx"], "text", "|")
    return lined.select(*keys, F.concat(F.lit("|"), "text", F.lit("|")).alias("text"))
