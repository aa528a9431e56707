"""Cases of the fourth round's findings."""

import random

from glyphline.core.skew import use_limits
from glyphline.operators import budget as R

NOTES = "k long, id long, x double, idurs array<double>, cap double, rb double"
MARKS = "k long, mid long, mx double, n int"
NAMES = (["k"], "x", "id", "idurs", "mx", "n", "mid")


def measures(seed, count, longest):
    """Measures with several notes at a place, chords, notes without a length, and markers before, between, on and behind notes."""
    rng = random.Random(seed)
    notes, marks = [], []
    for k in [*range(count), None]:
        cap, rb = rng.choice([1.0, 2.0, 4.0]), rng.choice([0.0, 0.5])
        for i in range(rng.randint(1, 9)):
            own = [rng.choice([0.25, 0.5, 1.0, 2.0]) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
            notes.append((k, i, float(rng.randint(0, 6)), own, cap, rb))
        for m in range(rng.choice([0, 1, 1, 2, 3])):
            marks.append((k, m, rng.randint(-2, 16) / 2, rng.choice([0, 1, 2, 3, 3, longest, None])))
    marks += [(count + 1, 0, 1.0, 3), marks[0]]
    return notes, marks


def test_markers_cover_the_same_notes_near_and_far(spark):
    notes, marks = measures(1, 120, 6)
    marks = [m for m in marks if m[3] != 0]
    notes, marks = spark.createDataFrame(notes, NOTES).cache(), spark.createDataFrame(marks, MARKS).cache()
    told = lambda d: {(r.k, r.reading, r.id) for r in d.filter("__in = 1").collect()}
    far = told(R._covered_far(notes, marks, *NAMES, 6))
    assert len({k for k, *_ in far}) > 60 and {r for _, r, _ in far} == {0, 1}
    assert told(R._covered_near(notes, marks, *NAMES, 6)) == far
    # room for longer windows than there are changes nothing
    assert told(R._covered_near(notes, marks, *NAMES, 9)) == far


def test_readings_of_split_measures(spark):
    notes, marks = measures(2, 3, 4)
    notes += [(9, i, float(i // 2 % 70), [0.5] if i % 3 else [0.5, 0.25], 4.0, 0.0) for i in range(300)]
    marks += [(9, i, i * 6.7, 2 + i % 3) for i in range(10)]
    notes, marks = spark.createDataFrame(notes, NOTES).cache(), spark.createDataFrame(marks, MARKS).cache()

    def read():
        out = R.choose_interpretation(notes, marks, ["k"], "x", "id", "idurs", "rb", "cap", "mx", "n", "mid")
        return {(r.k, r.id, r.duration, r.source) for r in out.collect()}

    whole = read()
    with use_limits(min_rows=60, probe_bytes=0):
        assert read() == whole
    assert sum(k == 9 for k, *_ in whole) == 300


def test_notes_of_readings_are_shuffled_once(spark):
    from glyphline.plans import q_budget as Q

    plan = Q.choose_interpretation(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    # the notes once; the markers by measure, and to where the notes are
    assert plan.count("Exchange") <= 3
