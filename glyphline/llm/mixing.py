"""Mixing sources to target weights along a curriculum that changes over training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import checkpoint
from .common import WORD, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
# a source's weight over training time: straight lines through (time, weight), time from 0 to 1
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
# a source's stream is ordered by a digest; its first hexadecimal digits cut it into 4096 stretches
DIGITS = 3


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """Pieces of a schedule scaled to integral 1, each with the integral before it."""
    pairs = list(zip(knots, knots[1:]))
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots) or any(a[0] >= b[0] for a, b in pairs):
        raise ValueError("a schedule runs from time 0 to 1 through weights that are not negative")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairs]
    whole, before, out = sum(areas), 0.0, []
    if whole <= 0:
        raise ValueError("a schedule needs some weight")
    for ((t0, w0), (t1, w1)), area in zip(pairs, areas):
        part = {"begin": t0, "width": t1 - t0, "w0": w0 / whole, "w1": w1 / whole, "before": before, "area": area / whole}
        if area > 0:
            out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in part.items()]))
        before += area / whole
    return F.array(*out)


def _when(segments: Column, share: Column) -> Column:
    """The time at which the integral of a schedule reaches ``share``: the inverse of a piecewise quadratic."""
    piece = F.element_at(F.filter(segments, lambda s: s["before"] <= share), -1)

    def solve(s: Column) -> Column:
        y = F.least(F.greatest(share - s["before"], F.lit(0.0)), s["area"])
        slope = (s["w1"] - s["w0"]) / s["width"]
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * y, F.lit(0.0)))
        return s["begin"] + F.when(y > 0, F.least(2 * y / (s["w0"] + root), s["width"])).otherwise(F.lit(0.0))

    return F.transform(F.array(piece), solve)[0]


def targets(stats: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(sk, source_size, place, target) from (sk, source_size): shares by weight, none above ``cap`` times its size.

    Sources in order of the ratio of cap to weight fill up one after the other; before each, what is left is dealt by
    weight to those from it on. The first that stays below its cap fixes the level for the rest, which
    is where sharing the excess again and again ends. Works on one row per source.
    """
    everything = W.partitionBy()
    by_name = W.orderBy("sk")
    place = F.row_number().over(by_name) - 1
    df = stats.withColumn("place", place)
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))) + 1))
    df = df.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    fill = W.orderBy("ratio", "sk")
    upto = fill.rowsBetween(W.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("weight").over(onward)).withColumn("order", F.row_number().over(fill))
    full = F.col("level") >= F.col("ratio")
    df = df.withColumn("final", F.min(F.when(~full, F.struct("order", "level"))).over(everything)["level"])
    return df.select("sk", "source_size", "place", F.when(full, F.col("most")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    schedules: Sequence = SCHEDULES,
    seed: int = 0,
) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it, in training order.

    Columns: id, source, size (words), source_size, target, taken (words, repeats counted), positions (one time
    from 0 to 1 for every copy taken), position (the first of them), and the ``carry`` columns.

    Method: a source's documents stand in a stream ordered by a digest of seed and id, repeated as often as
    needed. The mix takes the first ``target`` words of the stream, rounded to whole words, so a source
    misses its target by less than a word; the one document at the end of it may be taken in part. The middle of
    a copy, as a share of the target, is put through the inverse of the source's
    cumulated schedule, which gives its time; rows are range-sorted by it. Sources by code point, null last,
    take ``weights`` and ``schedules`` in turn.

    A stream is summed in stretches, so no task holds a source. Reruns agree. Null text: size 0, never
    taken. Texts of any length are counted whole. Null or repeated ids: rows of their own, equal ones next to each other in
    the stream. Carried columns with a result's name are left out.
    An empty table gives an empty result. Sources number fewer rows than one task sorts with ease.
    """
    results = [id, source, "size", "source_size", "target", "taken", "positions", "position"]
    carry = [c for c in carry if c not in results]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")).cast("binary"))
    rows = docs.select(
        F.col(id).alias("r_id"),
        F.col(source).alias("r_source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~")).alias("sk"),
        digest.alias("digest"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    ).withColumn("stretch", F.substring("digest", 1, DIGITS))
    parts = checkpoint(rows.groupBy("sk", "stretch").agg(F.sum("size").alias("stretch_size")))
    goals = targets(parts.groupBy("sk").agg(F.sum("stretch_size").alias("source_size")), weights, share, cap)
    in_order = W.partitionBy("sk").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("stretch_size").over(in_order), F.lit(0).cast("long")))
    # at most 4096 rows a source; written so that the join below starts from true sizes
    parts = checkpoint(parts.join(goals, "sk").drop("stretch_size"))

    within = W.partitionBy("sk", "stretch").orderBy("digest", "r_id", "size").rowsBetween(W.unboundedPreceding, -1)
    df = rows.join(parts, ["sk", "stretch"])
    df = df.withColumn("begin", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    goal = F.round("target").cast("long")
    zero = F.lit(0).cast("long")

    def copy(e: Column) -> Column:
        at = F.col("begin") + e * F.col("source_size")
        return F.struct(at.alias("at"), F.least(F.greatest(goal - at, zero), F.col("size")).alias("n"))

    df = df.withColumn("copies", F.filter(F.array(*[copy(F.lit(e).cast("long")) for e in range(cap)]), lambda c: c["n"] > 0))
    df = df.withColumn("taken", F.aggregate("copies", zero, lambda acc, c: acc + c["n"]))
    plans = F.element_at(F.array(*[_segments(s) for s in schedules]), F.pmod("place", F.lit(len(schedules))) + 1)
    df = df.withColumn("plan", plans)
    times = F.transform("copies", lambda c: _when(F.col("plan"), (c["at"] + c["n"] / F.lit(2.0)) / F.col("target")))
    df = df.withColumn("positions", times).withColumn("position", F.try_element_at("positions", F.lit(1)))
    df = df.orderBy(F.col("position").asc_nulls_last(), "digest", "r_id")
    return df.select(
        F.col("r_id").alias(id), F.col("r_source").alias(source), *results[2:], *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    )


SQL = """WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    coalesce('=' || source, '~') AS sk, md5(concat_ws(':', '0', doc_id::VARCHAR)) AS digest FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
w AS (SELECT sk, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
-- the level at which dealing by weight uses up all that is to be dealt, no source above twice its size
level AS (SELECT arg_min(l, r) AS l FROM (
  SELECT (1.5 * (SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(2.0 * b.source_size), 0) FROM w b WHERE 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight))
    / (SELECT sum(b.weight) FROM w b WHERE 2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight) AS l, 2.0 * a.source_size / a.weight AS r
  FROM w a) WHERE l < r),
t AS (SELECT sk, source_size, least(2.0 * source_size, coalesce((SELECT l FROM level) * weight, 2.0 * source_size))::DOUBLE AS target FROM w),
o AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM d JOIN t USING (sk))
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (least(greatest(round(target)::BIGINT - begin, 0), size) + least(greatest(round(target)::BIGINT - begin - source_size, 0), size))::BIGINT AS taken FROM o"""
