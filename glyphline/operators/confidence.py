"""Confidence of notes, events and measures, and the review report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import scan as S
from ..functions import scalar as N

LOW = 0.75
# Confidence of a duration by where it came from; others score 0.70.
SOURCE_CONF = {
    "beam": 1.00, "whole": 1.00, "tuplet": 0.95, "pickup": 0.90, "rest_detected": 0.90, "single_fill": 0.80,
    "tuplet_leftover": 0.78, "proportional": 0.70, "proportional_dotted_decomposed": 0.72,
    "proportional_uniform": 0.60, "beam_rescue": 0.78, "unknown": 0.55,
}
OTHER_SOURCE = 0.70
UNTAGGED = 0.55


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def note_confidence(score) -> Column:
    """struct(conf, reason); a missing score counts as 0.70."""
    s = F.coalesce(_c(score), F.lit(0.70))
    return F.struct(N.rescale(s).alias("conf"),
                    F.when(s < 0.70, F.concat(F.lit("notehead match="), F.format_string("%.2f", F.bround(s, 2)))).alias("reason"))


def source_confidence(source) -> Column:
    out = F.lit(OTHER_SOURCE)
    for name, v in SOURCE_CONF.items():
        out = F.when(_c(source) == name, v).otherwise(out)
    return out


def event_confidence(typ, source, scores) -> Column:
    """struct(conf, reasons) of an event with member scores (an array, null for rests)."""
    src, tag = _c(source), F.coalesce(_c(source), F.lit("unknown"))
    members = F.transform(_c(scores), note_confidence)
    confs = F.transform(members, lambda m: m["conf"])
    lo, hi = F.array_min(confs), F.array_max(confs)
    rest = F.when(src.isNull(), UNTAGGED).otherwise(source_confidence(src))
    unit = F.least(lo, source_confidence(tag))
    empty = F.coalesce(F.size(_c(scores)), F.lit(0)) <= 0
    # reasons of the members, of the duration, of the spread
    unit_why = F.concat(
        F.array_compact(F.transform(members, lambda m: m["reason"])),
        F.array_compact(F.array(
            F.when(source_confidence(tag) < 0.90, F.concat(F.lit("duration source: "), tag)),
            F.when((F.size(_c(scores)) >= 2) & (hi - lo > 0.15), F.lit("chord member score spread")))))
    rest_why = F.array_compact(F.array(
        F.when(src.isNull(), "untagged rest (likely injected)").when(rest < 0.90, F.concat(F.lit("rest dur: "), src))))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(_c(typ) == "rest", rest).when(_c(typ) == "multi_rest_count", 1.0).when(empty, 0.5).otherwise(unit).alias("conf"),
        F.when(_c(typ) == "rest", rest_why).when(_c(typ) == "multi_rest_count", none).when(empty, F.array(F.lit("empty unit")))
        .otherwise(unit_why).alias("reasons"))


def adjusted_confidence(df, keys, order, typ, duration, capacity, conf="conf") -> DataFrame:
    """Multiply by 0.70 where the measure's beats miss its capacity by more than 0.1."""
    beats = F.when(_c(typ).isin("rest", "note_unit"), F.coalesce(_c(duration), F.lit(1.0))).otherwise(0.0)
    d = S.scan(df, keys, order, beats=S.total("sum", beats))
    off = F.abs(F.col("beats") - _c(capacity)) > 0.1
    d = d.withColumns({"adjusted": F.col(conf) * F.when(off, 0.70).otherwise(1.0), "off": off})
    return d.withColumn("low", F.col("adjusted") < LOW)


def flag_summary(df, staff: str) -> DataFrame:
    """Events, flagged events and percentage per staff and overall (null staff)."""
    out = df.rollup(staff).agg(F.count(F.lit(1)).alias("total"), F.count_if("low").alias("low"))
    return out.withColumn("pct", F.round(F.col("low") * 100.0 / F.col("total"), 1))


def flag_details(df, keys, pos, text, reasons="reasons") -> DataFrame:
    """One row per flagged event: position, text, confidence and why."""
    why = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("(aggregate low)")
    return df.filter("low").select(*keys, pos, _c(text).alias("text"), F.round("adjusted", 2).alias("conf"), why.alias("why"))


def _fixed(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast(f"decimal(18,{digits})").cast("string")


def report_lines(df, staff: str, measure: str, pos: str, text, capacity, reasons="reasons") -> DataFrame:
    """The report as lines (staff, measure, part, pos, text), in that order.

    Per staff a head with its counts; per measure its events with ``[!]`` before the flagged ones, the reason
    why its beats do not add up, and a line for each flagged event. ``df`` is what
    ``adjusted_confidence`` gives; measures count from 0.
    """
    shown = F.concat(F.when(F.col("low"), "[!]").otherwise(""), _c(text))
    items = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), shown.alias("t"))))
    m = df.groupBy(staff, measure).agg(
        F.array_join(F.transform(items, lambda i: i["t"]), " ").alias("t"), F.first("beats").alias("beats"), F.first("off").alias("off"), F.first(_c(capacity)).alias("cap"))
    line = lambda part, t: F.struct(F.lit(part).alias("part"), t.alias("text"))
    body = line(1, F.concat(F.lit("  M"), F.lpad((F.col(measure) + 1).cast("int").cast("string"), 2, "0"), F.lit(": |"), "t", F.lit("|")))
    why = line(2, F.concat(F.lit("         measure: beat sum "), _fixed(F.col("beats"), 2), F.lit(" != "), F.col("cap").cast("double").cast("string")))
    m = m.select(F.col(staff).alias("staff"), F.col(measure).cast("long").alias("measure"), F.explode(F.array_compact(F.array(body, F.when(F.col("off"), why)))).alias("l"))
    m = m.select("staff", "measure", "l.part", F.lit(0).cast("long").alias("pos"), "l.text")
    d = flag_details(df, [staff, measure], pos, text, reasons)
    told = F.concat(F.lit("         pos "), F.col(pos).cast("string"), F.lit(' "'), "text", F.lit('" conf='), _fixed(F.col("conf"), 2), F.lit(": "), "why")
    d = d.select(F.col(staff).alias("staff"), F.col(measure).cast("long").alias("measure"), F.lit(3).alias("part"), F.col(pos).cast("long").alias("pos"), told.alias("text"))
    h = df.groupBy(F.col(staff).alias("staff")).agg(F.count(F.lit(1)).alias("n"), F.count_if("low").alias("low"))
    head = F.concat(F.lit("--- "), F.col("staff").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" events, "), F.col("low").cast("string"),
                    F.lit(" low-conf ("), _fixed(F.col("low") * 100.0 / F.col("n"), 1), F.lit("%) ---"))
    h = h.select("staff", F.lit(-1).cast("long").alias("measure"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), head.alias("text"))
    return h.unionByName(m).unionByName(d)


def write_report(summary: DataFrame, details: DataFrame, path: str, lines: DataFrame | None = None, score: str | None = None) -> None:
    """The summary and the flagged events as Parquet tables under ``path``; ``lines`` as text under ``path/text``.

    ``lines`` is what ``report_lines`` gives, for several scores with a column ``score`` naming them. Each score is one file
    in a folder of its own name, its lines in order: all lines of a score meet in one task, no two scores in one file.
    """
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    details.write.mode("overwrite").parquet(f"{path}/details")
    if lines is None:
        return
    order = ["staff", "measure", "part", "pos"]
    if score is None:
        lines.repartition(1).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(f"{path}/text")
    else:
        laid = lines.repartition(score).sortWithinPartitions(score, *order)
        laid.select(score, "text").write.mode("overwrite").partitionBy(score).text(f"{path}/text")
