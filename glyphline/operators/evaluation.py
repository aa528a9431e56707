"""Positional comparison of two notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import scan as S
from ..functions import scalar as N
from .aggregates import rollup_totals

SECTION = ["doc", "clef", "line"]
METRICS = ["n_events", "events_ok", "n_notes", "pitch_ok", "duration_ok"]


def zip_measures(truth: DataFrame, found: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Measures of both sides by position, in sections the truth has and the output filled.

    Missing measures are empty text.
    """
    side = lambda df, gt, out, want: df.select(
        *SECTION, F.col("measure_no").cast("long").alias("measure_no"), gt.alias("gt"), out.alias("out"), F.lit(want).alias("__want"))
    none = F.lit(None).cast("string")
    rows = side(truth, F.col("text"), none, 1).unionByName(side(found, none, F.col("text"), 0))
    if sections is not None:
        rows = rows.unionByName(side(sections.withColumn("measure_no", F.lit(None)), none, none, 1))
    # both sides meet in one shuffle on the section, and each is read once; the output's measure
    # comes just before the truth's of that number
    d = S.scan(rows, SECTION, ["measure_no", "__want"], __t=S.total("max", "__want"), __f=S.total("count", "out"),
               __next=S.lead(F.struct("measure_no", "gt")), __before=S.lag("measure_no"))
    d = d.filter((F.col("__t") == 1) & (F.col("__f") > 0) & F.col("measure_no").isNotNull())
    d = d.filter((F.col("__want") == 0) | ~F.col("__before").eqNullSafe(F.col("measure_no")))
    gt = F.coalesce("gt", F.when(F.col("__next.measure_no") == F.col("measure_no"), F.col("__next.gt")), F.lit(""))
    return d.select(*SECTION, "measure_no", gt.alias("gt"), F.coalesce("out", F.lit("")).alias("out"))


EVENTS = "array<struct<text:string,own:struct<notes:array<string>,duration:string>>>"


def _plain(text) -> Column:
    """Without brackets, and without white space but for the space: each of its words is an event of one note at most."""
    return ~F.rlike(text, F.lit(r"(?U)[\[\]\s" + N.WHITE + "&&[^ ]]"))


def _words(text) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _read(text) -> Column:
    """Events of a measure as array of (text, notes, duration)."""
    one = lambda e: F.struct(e.alias("text"), N.split_event(e).alias("own"))
    return F.transform(N.tokenize_events(text), one).cast(EVENTS)


def _read_plain(text) -> Column:
    """``_read`` of a plain text, with no pattern but for the words with a stroke."""

    def one(e):
        duration = F.when(F.contains(e, F.lit("/")), F.regexp_extract(e, N.DURATION_AT_END, 0)).otherwise("")
        note = F.substring(e, F.lit(1), F.length(e) - F.length(duration))
        notes = F.when(note == "", F.array().cast("array<string>")).otherwise(F.array(note))
        return F.struct(e.alias("text"), F.struct(notes.alias("notes"), duration.alias("duration")).alias("own"))

    return F.transform(_words(text), one).cast(EVENTS)


def _compared(gt: Column, out: Column) -> Column:
    """Sums over the events of a measure by position, and over their notes by position inside the event.

    Only positions both sides have can be right, and those past an end compare to null.
    """

    def pair(a: Column, b: Column) -> Column:
        notes = F.zip_with(a["own"]["notes"], b["own"]["notes"], lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
        hits = F.coalesce(F.aggregate(notes, F.lit(0), lambda n, v: n + v), F.lit(0))
        size = lambda e: F.coalesce(F.size(e["own"]["notes"]), F.lit(0))
        yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return F.struct(
            F.lit(1).alias("n_events"), yes(a["text"] == b["text"]).alias("events_ok"), F.greatest(size(a), size(b), F.lit(0)).alias("n_notes"),
            hits.alias("pitch_ok"), yes(a["own"]["duration"] == b["own"]["duration"]).alias("duration_ok"))

    zero = F.struct(*[F.lit(0).alias(m) for m in METRICS])
    add = lambda t, v: F.struct(*[(t[m] + v[m]).alias(m) for m in METRICS])
    return F.aggregate(F.zip_with(gt, out, pair), zero, add)


def _right(gt: Column) -> Column:
    """What ``_compared`` gives of a measure and itself."""
    notes = F.aggregate(gt, F.lit(0), lambda n, e: n + F.size(e["own"]["notes"]))
    n = F.size(gt)
    return F.struct(n.alias("n_events"), n.alias("events_ok"), notes.alias("n_notes"), notes.alias("pitch_ok"), n.alias("duration_ok"))


def _right_words(words: Column, stroke: Column) -> Column:
    """``_right`` of a plain measure: a word that is but a duration has no note."""
    n = F.size(words)
    notes = F.when(stroke, F.size(F.filter(words, lambda e: ~F.rlike(e, F.lit("^" + N.DURATION_AT_END))))).otherwise(n)
    return F.struct(n.alias("n_events"), n.alias("events_ok"), notes.alias("n_notes"), notes.alias("pitch_ok"), n.alias("duration_ok"))


def _compared_words(gt: Column, out: Column) -> Column:
    """``_compared`` of plain measures without a stroke: a word is a note, and none has a duration of its own."""
    n, hits = F.greatest(F.size(gt), F.size(out)), F.size(F.filter(F.zip_with(gt, out, lambda a, b: a == b), lambda v: v))
    return F.struct(n.alias("n_events"), hits.alias("events_ok"), n.alias("n_notes"), hits.alias("pitch_ok"), F.least(F.size(gt), F.size(out)).alias("duration_ok"))


def measure_scores(z: DataFrame) -> DataFrame:
    """One row per measure: whether it is right as a whole, and METRICS over its events.

    Each text is read once; where both sides are the same, only one of them. Measures of plain words, which most are, need
    no reading of their events.
    """
    d = z.select(*SECTION, (F.col("gt") == F.col("out")).alias("same"), "gt", "out")
    d = d.select("*", _plain("gt").alias("gp"), F.when(F.col("same"), _plain("gt")).otherwise(_plain("out")).alias("op"))
    d = d.withColumn("stroke", F.contains("gt", F.lit("/")) | F.contains("out", F.lit("/")))
    d = d.withColumn("words", F.col("gp") & F.col("op") & (F.col("same") | ~F.col("stroke")))
    same, words = F.col("same"), F.col("words")
    side = lambda c, p: F.when(F.col(p), _read_plain(c)).otherwise(_read(c))
    read = d.select(
        *SECTION, "same", "words", "stroke", F.when(words, _words("gt")).alias("gw"), F.when(words & ~same, _words("out")).alias("ow"),
        F.when(~words, side("gt", "gp")).alias("g"), F.when(~words & ~same, side("out", "op")).alias("o"))
    sums = (F.when(words & same, _right_words(F.col("gw"), F.col("stroke"))).when(words, _compared_words(F.col("gw"), F.col("ow")))
            .when(same, _right(F.col("g"))).otherwise(_compared(F.col("g"), F.col("o"))))
    return read.select(*SECTION, "same", sums.alias("s")).select(*SECTION, "same", "s.*")


def accuracy_metrics(truth, found, sections=None) -> DataFrame:
    """Totals per section."""
    s = measure_scores(zip_measures(truth, found, sections))
    return s.groupBy(*SECTION).agg(
        F.count(F.lit(1)).alias("n_measures"), F.count_if("same").alias("measures_ok"), *[F.sum(m).alias(m) for m in METRICS])


def diff_rows(truth, found, sections=None) -> DataFrame:
    """Measures that differ: (section, measure_no, gt, out)."""
    return zip_measures(truth, found, sections).filter(F.col("gt") != F.col("out"))


def top_diffs(diffs: DataFrame, n: int = 10) -> DataFrame:
    """First n differences per section; the rest is dropped before the shuffle."""
    w = W.partitionBy(*SECTION).orderBy("measure_no")
    return diffs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def accuracy_report(metrics: DataFrame) -> DataFrame:
    """Rounded percentages per section and overall (null section), one row per level compared."""
    levels = [("measures", "measures_ok", "n_measures"), ("events", "events_ok", "n_events"), ("pitch", "pitch_ok", "n_notes")]
    rows = F.array(*[F.struct(F.lit(n).alias("level"), F.col(h).cast("long").alias("h"), F.col(t).cast("long").alias("t")) for n, h, t in levels])
    long = metrics.select(F.struct(*SECTION).alias("section"), F.explode(rows).alias("r")).select("section", "r.*")
    r = rollup_totals(long, ["level", "section"], "h", "t")
    return r.filter(F.col("level").isNotNull()).select("section.*", "level", "hits", "total", "pct")
