"""Unions and differences of detection sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def typed_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of sets with a ``type`` tag; columns a set lacks become null."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("type", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def union_dedupe(passes: list[DataFrame], keys, x, y, score, row_id, radius) -> DataFrame:
    """Union of detection passes without duplicates nearer than ``radius``, best score first."""
    from .dedupe import nms_center

    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return nms_center(out, keys, x, y, score, row_id, radius)


def removed_rows(df: DataFrame, keep: Column) -> DataFrame:
    """Rows a filter drops, rows on which it is null included: one pass, no difference join."""
    return df.filter(~F.coalesce(keep, F.lit(False)))
