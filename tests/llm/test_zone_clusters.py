import hashlib
import math

import numpy as np
import pytest

from glyphline.llm import zone_clusters as Z

DIMS = 4


def plain(rows, k, rounds, dims=DIMS, scale=64):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [q for _, q in order[:k]]
    pick = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        who = [(pick(q)[1], q) for _, q in kept]
        cs = [[sum(x) // len(own) for x in zip(*own)] if (own := [q for n, q in who if n == c]) else cs[c] for c in range(len(cs))]
    out = [(i, *pick(q)[::-1]) for i, q in kept]
    part = {c: sum(d for _, n, d in out if n == c) for c in range(len(cs))}
    return sorted(((i, c, d, part[c], sum(part.values()), cs[c]) for i, c, d in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, place string")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(rng.integers(0, 3), 0.2, DIMS)]) for i in rng.permutation(400)]
    rows += [(900, [0.25] * DIMS)] * 150 + [(None, [0.25] * DIMS)] * 3  # repeated rows and null ids
    rows += [(901, None), (902, []), (903, [1.0] * 3), (904, [1.0, None, 1.0, 1.0]), (905, [math.nan] * 4), (906, [math.inf] * 4)]
    got = result(Z.cluster_vectors(frame(spark, rows), k=5, rounds=2, dims=DIMS))
    assert got == plain(rows, 5, 2)


def test_ties_take_the_smaller_number_and_few_vectors_make_few_clusters(spark):
    rows = [(1, [1.0] * DIMS), (2, [1.0] * DIMS), (3, [-1.0] * DIMS)]
    got = result(Z.cluster_vectors(frame(spark, rows), k=8, rounds=1, dims=DIMS))
    assert got == plain(rows, 8, 1)
    assert {r[1] for r in got if r[0] in (1, 2)} == {min(r[1] for r in got if r[0] in (1, 2))}


def test_empty_table(spark):
    assert Z.cluster_vectors(frame(spark, []), dims=DIMS).collect() == []


def test_large_components_are_exact_and_larger_ones_refused(spark):
    big = float(1 << 20)
    rows = [(i, [big + i, -big, big, i / 3]) for i in range(40)]
    assert result(Z.cluster_vectors(frame(spark, rows), k=3, rounds=2, dims=DIMS)) == plain(rows, 3, 2)
    with pytest.raises(Exception, match="is not under"):
        Z.cluster_vectors(frame(spark, [(1, [1e30] * DIMS)]), dims=DIMS).collect()


def test_the_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = Z.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_boxes_rule_out_only_what_cannot_win():
    rng = np.random.default_rng(3)
    cs = rng.integers(-40, 40, (16, 6))
    spared = 0
    for _ in range(200):
        block = rng.integers(-40, 40, 6) + rng.integers(-3, 4, (20, 6))
        some = Z.candidates(block, cs)
        spared += 16 - len(some)
        dist = ((block[:, None] - cs) ** 2).sum(axis=2)
        assert set(dist.argmin(axis=1)) <= set(some)
        who, d = Z.nearest(block, cs)
        assert (who == dist.argmin(axis=1)).all() and (d == dist.min(axis=1)).all()
    assert spared > 1000
