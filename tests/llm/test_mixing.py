import random

import pytest

from glyphline.llm import mixing as M


def filled(sizes, weights, share, cap):
    """Deal by weight, cut at the cap, deal the excess again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        total = sum(w[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] += left * w[s] / total
        left = 0.0
        for s in order:
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


def docs_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(200):
        src = rng.choice(["hot"] * 6 + ["a", "B", "é", "tiny", None])
        n = 1 if src == "tiny" else rng.choice([0, 1, 7, 40, 90])
        rows.append((i, " \n".join(["w"] * n), src, 7))
    rows += [(5, "x y z", "hot", 7), (5, "x y z", "hot", 7), (None, "n u l l", "a", 7), (None, None, None, 7), (999, "", "empty", 7)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_takes(spark, seed):
    rows = docs_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = M.mix(df, carry=["text", "size"]).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes, M.WEIGHTS, M.SHARE, M.CAP)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(abs(r.target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.5 + 1e-9
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert sum(0 < r.taken % r.size for r in own if r.size) <= 1  # one document at most is cut
    assert all(r.size == len((r.text or "").split()) for r in got)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for r in got for p in r.positions)
    assert [r.doc_id for r in got] == [r.doc_id for r in M.mix(df.repartition(7)).collect()]


def test_positions_follow_the_schedule(spark):
    """Taken words up to a time are the schedule's integral up to it."""
    df = spark.createDataFrame([(i, "w " * 10, "s") for i in range(400)], "doc_id long, text string, source string")
    plan = ((0.0, 0.0), (0.5, 2.0), (1.0, 2.0))
    got = M.mix(df, schedules=[plan], share=1.0).collect()
    for time, part in [(0.25, 0.125 / 1.5), (0.5, 0.5 / 1.5), (0.75, 1.0 / 1.5)]:
        words = sum(r.taken for r in got if r.position <= time)
        assert abs(words / 4000 - part) < 0.01


def test_empty_and_bad_schedule(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(none).collect() == []
    with pytest.raises(ValueError):
        M.mix(none, schedules=[((0.0, 1.0), (0.5, 1.0))])
