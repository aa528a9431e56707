"""Nulls in keys, integers beyond 2^53 and payloads of any type pass through the Python steps unchanged."""

import datetime as dt

import pytest

from glyphline.core.skew import use_limits
from glyphline.operators import budget as B, dedupe as D, groups as G, joins as J, sequences as Q

BIG = 9007199254740993


@pytest.fixture(params=[False, True], ids=["plain", "split"])
def plan(request):
    if request.param:
        with use_limits(min_rows=2, shares=3, probe_bytes=0, component_rows=3):
            yield
    else:
        yield


@pytest.fixture
def dots(spark):
    """Two groups, one with a null key, one with a key that a double cannot hold."""
    rows = [(k, BIG + i, float(i), 0.0, 0.5 + i / 100, dt.datetime(2020, 1, 1), [i]) for k in (None, BIG) for i in range(5)]
    return spark.createDataFrame(rows, "k long, id long, x double, y double, score double, at timestamp, arr array<int>")


def test_sweeps_see_a_null_key_as_one_group(dots, plan):
    got = sorted(map(str, D.sweep_keep_first(dots, ["k"], "x", "id", 10.0).collect()))
    assert len(got) == 2 and all(str(BIG) in g for g in got)
    assert {(r.k, r.id) for r in D.sweep_keep_best(dots, ["k"], "x", "score", "id", 10.0).collect()} == {(None, BIG + 4), (BIG, BIG + 4)}
    assert {(r.k, r.n) for r in D.sweep_average(dots, ["k"], "x", "id", 10.0).collect()} == {(None, 5), (BIG, 5)}


def test_suppression_hands_the_payload_on(dots, plan):
    got = D.nms_center(dots, ["k"], "x", "y", "score", "id", 10.0)
    assert got.schema == dots.schema
    assert {(r.k, r.id, r.at, tuple(r.arr)) for r in got.collect()} == {(k, BIG + 4, dt.datetime(2020, 1, 1), (4,)) for k in (None, BIG)}


def test_pairs_clusters_lines(dots, plan):
    pairs = J.greedy_pair(dots, dots, ["k"], "x", "id", 0.5).collect()
    assert {(r.k, r.left_id, r.right_id) for r in pairs} == {(k, BIG + i, BIG + i) for k in (None, BIG) for i in range(5)}
    seeds = G.seed_cluster(dots.selectExpr("*", "x as sx", "'up' as stem"), ["k"], "x", "sx", "stem", "y", "id", 100.0).collect()
    assert {(r.k, r.seed_id) for r in seeds} == {(None, BIG), (BIG, BIG)} and len(seeds) == 10
    lines = Q.line_pack(dots, ["k"], ["x", "id"], "id", "score", 1.2, 0.1).collect()
    assert sorted((str(r.k), r.id, r.line) for r in lines) == sorted((str(k), BIG + i, 1 + i // 2) for k in (None, BIG) for i in range(5))


def test_prune_keeps_null_groups(dots, plan):
    from pyspark.sql import functions as F

    d = dots.withColumns({"dur": F.lit(1.0), "cap": F.lit(4.0)})
    kept = B.overflow_prune(d, ["k"], ["x", "id"], "id", "dur", F.col("x") == 4, "cap").collect()
    assert sorted((str(r.k), r.id) for r in kept) == sorted((str(k), BIG + i) for k in (None, BIG) for i in range(4))
