"""Row-local projections and filters over detections. None of them shuffles.

Distances are given in multiples of the page's line spacing ``dy``, which is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import scan as S

# Fixed values: (side, distance in dy, score below which the row is dropped).
TREBLE_TIERS = [("below", 0.5, 0.90), ("below", 2.0, 0.95), ("above", 1.0, 0.65), ("above", 3.0, 0.98)]
TREBLE_MIN_SCORE = 0.58
BASS_TIERS = [("above", 1.0, 0.80), ("below", 4.0, 0.65), ("below", 1.5, 0.70), ("below", 0.3, 0.65)]
BASS_MIN_SCORE = 0.60
# below this distance and score a bass row passes only near one of the trusted scores
BASS_TRUSTED = (0.5, 0.90, (0.95, 1.0), 0.02)
SCORE_FLOOR = 0.80


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box_center(df: DataFrame, x="x", y="y", w="w", h="h") -> DataFrame:
    """Integer centre of a box: ``x + w // 2`` and ``y + h // 2``."""
    half = lambda c: F.floor(_c(c) / 2)
    return df.withColumns({"cx": _c(x) + half(w), "y_center": _c(y) + half(h)})


def shape_filter(df, area, w, h, area_range=None, aspect_range=None, min_fill=None, min_height=None) -> DataFrame:
    """Keep boxes whose area, width/height, area/(w*h) and height are in range."""
    aspect = F.try_divide(_c(w), _c(h))
    fill = F.try_divide(_c(area), _c(w) * _c(h))
    ok = F.lit(True)
    if area_range:
        ok &= _c(area).between(*area_range)
    if aspect_range:
        ok &= aspect.between(*aspect_range)
    if min_fill is not None:
        ok &= fill >= min_fill
    if min_height is not None:
        ok &= _c(h) >= min_height
    return df.filter(ok)


def tier_filter(df, y, top, bottom, score, dy, clef) -> DataFrame:
    """Drop rows outside the staff whose score is too low for how far out they are.

    Rows without a staff (null ``top``) pass; a missing score counts as 1.0.
    """
    s = F.coalesce(_c(score), F.lit(1.0))
    away = {"above": _c(top) - _c(y), "below": _c(y) - _c(bottom)}

    def bad(tiers, floor):
        out = s < floor
        for side, k, limit in tiers:
            out |= (away[side] > _c(dy) * k) & (s < limit)
        return out

    k, limit, trusted, tol = BASS_TRUSTED
    near = F.lit(False)
    for v in trusted:
        near |= F.abs(s - v) <= tol
    bass = bad(BASS_TIERS, BASS_MIN_SCORE) | ((away["below"] > _c(dy) * k) & (s < limit) & ~near)
    drop = F.when(_c(clef) == "bass", bass).when(_c(clef) == "treble", bad(TREBLE_TIERS, TREBLE_MIN_SCORE)).otherwise(False)
    return df.filter(_c(top).isNull() | ~drop)


def score_floor(df, score="score", floor: float = SCORE_FLOOR) -> DataFrame:
    return df.withColumn(score, F.greatest(F.lit(floor), F.col(score)))


def boundary_filter(df, bounds: DataFrame, keys: list[str], x: str, bound: str, default) -> DataFrame:
    """Keep rows right of their group's boundary; groups without one use ``default``."""
    b = bounds.select(*keys, F.col(bound).alias("__b"))
    return df.join(b, keys, "left").filter(F.col(x) > F.coalesce("__b", _c(default) if isinstance(default, str) else F.lit(default))).drop("__b")


def edge_filter(df, x, width, left_ratio=0.10, right_ratio=0.96) -> DataFrame:
    """Keep rows strictly between two fractions of the page width."""
    return df.filter((_c(x) > F.floor(_c(width) * left_ratio)) & (_c(x) < F.floor(_c(width) * right_ratio)))


def above_staff_filter(df, x, y, top, bound, score, dy, has_meter) -> DataFrame:
    """Drop marks above the staff: far ones always, nearer ones depending on the page."""
    above = _c(top) - _c(y)
    small_mark = (_c(x) < _c(bound) + _c(dy)) & (_c(y) < _c(top) - _c(dy) * 0.3) & (_c(score) < 0.70)
    too_far = F.when(above > _c(dy) * 5.0, True).when(above > _c(dy) * 2.5, _c(has_meter) | (_c(score) < 0.95)).otherwise(False)
    return df.filter(~small_mark & ~too_far)


def typed_threshold(df, typ, score, limits: dict[str, float], default: float) -> DataFrame:
    """Keep rows whose score reaches the threshold of their type."""
    limit = F.lit(default)
    for name, v in limits.items():
        limit = F.when(_c(typ) == name, v).otherwise(limit)
    return df.filter(_c(score) >= limit)


def ledger_threshold(df, y, top, bottom, score, dy, strict=0.42, loose=0.35) -> DataFrame:
    """The looser threshold holds only between 0.5 and 2.5 dy outside the staff."""
    out = F.greatest(_c(top) - _c(y), _c(y) - _c(bottom)) / _c(dy)
    limit = F.when((out > 0.5) & (out <= 2.5), loose).otherwise(strict)
    return df.filter(_c(score) >= limit)


def score_band(score) -> Column:
    """Which of the four hollow-note score bands a score is in, narrowest first."""
    s = _c(score)
    return (
        F.when(s == 0.80, "floor")
        .when(F.abs(s - 0.80) < 0.02, "near_floor")
        .when(s <= 0.81, "low")
        .when((s >= 0.78) & (s < 0.85), "template")
        .otherwise("other")
    )


def parity_split(df, idx, n_pairs) -> DataFrame:
    """Even index: treble of its pair; odd: bass. Rows beyond the last pair are dropped."""
    pair = F.floor(_c(idx) / 2)
    return df.withColumns(
        {"pair_idx": pair, "clef": F.when(_c(idx) % 2 == 0, "treble").otherwise("bass")}
    ).filter(F.col("pair_idx") < n_pairs)


def scaled_thresholds(params: DataFrame, pages: DataFrame, dy: str = "dy") -> DataFrame:
    """Every parameter (name, mult), a fixed short table, scaled by each page's spacing."""
    return pages.crossJoin(F.broadcast(params)).withColumn("threshold", F.col("mult") * F.col(dy))
