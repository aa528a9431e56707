"""Suppression of long components in rounds, against the plain walk from the best row on."""

import random

import pytest

import glyphline.core.greedy as G
from glyphline.core.skew import use_limits
from glyphline.operators import dedupe as D

CENTRE = "k string, id long, x double, y double, score double, extra string"
BOX = "k string, id long, x1 int, y1 int, x2 int, y2 int, score double"


def best_first(rows, hits):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["id"])):
        if not any(r["k"] == q["k"] and hits(q, r) for q in kept):
            kept.append(r)
    return sorted(r["id"] for r in kept)


def near(r):
    return lambda a, b: abs(a["x"] - b["x"]) < r and abs(a["y"] - b["y"]) < r


def centre_rows(kind, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = {"chain": (i * 0.4, rng.random() * 3), "worse": (i * 0.6, 0.0), "pile": (rng.random() * 3, rng.random() * 3)}[kind]
        score = {"chain": rng.random(), "worse": 1.0 - i / n, "pile": rng.randrange(5) / 5}[kind]
        rows.append({"k": "a" if i % 50 else None, "id": i, "x": x, "y": y, "score": score, "extra": f"e{i}"})
    return [r | {"k": "a"} for r in rows] if kind == "worse" else rows


@pytest.mark.parametrize("kind,n", [("chain", 1500), ("worse", 400), ("pile", 1500)])
def test_rounds_give_what_the_walk_gives(spark, kind, n, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 100)
    rows = centre_rows(kind, n)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CENTRE)
    with use_limits(component_rows=50, probe_bytes=0):
        got = D.nms_center(df, ["k"], "x", "y", "score", "id", 1.0).collect()
    assert sorted(r.id for r in got) == best_first(rows, near(1.0))
    assert all(r.extra == f"e{r.id}" for r in got)


@pytest.mark.parametrize("relative", ["other", "min"])
def test_boxes_of_all_sizes(spark, relative):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        w, h = rng.choice([(2, 2), (5, 3), (20, 8), (90, 60), (3, 40)])
        x, y = rng.randrange(300), rng.randrange(60)
        rows.append({"k": "p", "id": i, "x1": x, "y1": y, "x2": x + w, "y2": y + h, "score": rng.randrange(50) / 50})

    def hits(a, b):
        w = max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) + 1)
        h = max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]) + 1)
        size = lambda r: (r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)
        return w * h / (size(b) if relative == "other" else min(size(a), size(b))) > 0.3

    df = spark.createDataFrame([tuple(r.values()) for r in rows], BOX)
    with use_limits(component_rows=40, probe_bytes=0):
        got = D.nms_overlap(df, ["k"], "x1", "y1", "x2", "y2", "score", "id", relative_to=relative).collect()
    assert sorted(r.id for r in got) == best_first(rows, hits)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real, block = G._round, G._block
    monkeypatch.setattr(G, "_round", lambda *a: rounds.append("round") or real(*a))
    monkeypatch.setattr(G, "_block", lambda *a: rounds.append("block") or block(*a))
    rows = centre_rows("chain", 12_000)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CENTRE)
    plain = sorted(r.id for r in D.nms_center(df, ["k"], "x", "y", "score", "id", 1.0).collect())
    with use_limits(component_rows=300, probe_bytes=0):
        got = sorted(r.id for r in D.nms_center(df, ["k"], "x", "y", "score", "id", 1.0).collect())
    assert got == plain and 0 < len(rounds) <= 7 and "block" not in rounds
