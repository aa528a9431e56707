"""Oversized groups: the split plans must give what the plain plans give."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from glyphline.core import scan as S
from glyphline.core.skew import find_split, use_limits
from glyphline.plans.check import compare

TINY = dict(probe_bytes=0, min_rows=20, shares=10**6, component_rows=3)

WITH_SQL = [
    "asof_backward", "gap_cluster", "pattern_rewrite", "carry_first", "gap_expiring_fill", "upper_median", "true_median", "greedy_pair",
    "line_pack", "nms_center", "nms_overlap", "sweep_keep_best", "sweep_average", "densest_window", "renumber_global", "ordered_concat",
    "overlap_propagate", "pair_dedupe", "seed_cluster", "seed_cluster_single", "orphan_merge",
]
@pytest.mark.parametrize("name", WITH_SQL)
def test_split_plan_equals_sql(spark, duck, name):
    with use_limits(**TINY):
        verdict, detail = compare(spark, duck, name, SF)
    assert verdict == "ok", detail


def _one_big_group(spark, n=4000):
    d = spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1))
    # many equal positions: only the id tells rows apart
    return d.withColumn("x", F.floor(F.col("id") / 400).cast("double"))


def test_segments_are_even_and_complete(spark):
    d = _one_big_group(spark)
    with use_limits(probe_bytes=0, min_rows=100, shares=10**6):
        split = find_split(d, ["k"], ["x", "id"])
    assert list(split.last) == [(-1,)]
    sizes = split.tag(d).groupBy("k", "__seg").count().collect()
    assert sum(r["count"] for r in sizes) == d.count()
    big = [r["count"] for r in sizes if r["__seg"] is not None]
    assert len(big) > 10 and max(big) < 500
    # cold groups are left alone
    assert all(r["__seg"] is None for r in sizes if r["k"] != -1)


def test_segments_do_not_depend_on_partitioning(spark):
    d = _one_big_group(spark)
    with use_limits(probe_bytes=0, min_rows=100, shares=10**6):
        a = find_split(d.repartition(3), ["k"], ["x", "id"]).ranges.collect()
        b = find_split(d.repartition(11), ["k"], ["x", "id"]).ranges.collect()
    assert a == b


def test_scan_kinds_agree(spark):
    d = _one_big_group(spark).withColumn("v", F.when(F.col("id") % 5 != 0, F.col("id") % 17))
    specs = dict(
        rn=S.row_number(), s=S.run_sum("v", inclusive=False), b=S.run_sum("id", back=True), mx=S.run_max("v"), mn=S.run_min("v", back=True),
        la=S.last_value("v", inclusive=False), nx=S.next_value("v"), fi=S.first_value("v"), l1=S.lag("v"), l7=S.lag("id", 7), d3=S.lead("v", 3),
        c=S.total("count", "v"), hi=S.total("max", "v"), av=S.total("avg", "v"))
    plain = S.scan(d, ["k"], ["x", "id"], **specs).orderBy("id").collect()
    for rows in (500, 40):
        with use_limits(probe_bytes=0, min_rows=rows, shares=10**6):
            assert S.scan(d, ["k"], ["x", "id"], **specs).orderBy("id").collect() == plain


def test_small_inputs_start_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("probe", "probe")
    S.scan(_one_big_group(spark), ["k"], ["x", "id"], rn=S.row_number())
    assert len(tracker.getJobIdsForGroup("probe")) == 0


def test_budget_rule_on_split_groups(spark):
    from glyphline.operators import budget as R
    from test_bruteforce import SCHEMA, measures

    df = spark.createDataFrame(measures(21, 25), SCHEMA)

    def run():
        out = R.deficit_alloc(df, ["k"], "x", "id", "dur", "cap", "rb", "edge")
        return sorted(map(tuple, out.select("k", "id", "dur").collect()))

    plain = run()
    with use_limits(probe_bytes=0, min_rows=5, shares=10**6):
        assert run() == plain


def test_line_numbers_do_not_travel_segment_by_segment(spark):
    """One long group in 20 segments of some 30 lines: only the width used is folded again, and it is soon forgotten."""
    from glyphline.operators import sequences as Q

    parts = 20
    df = spark.range(4000).select(F.lit(1).alias("k"), "id", (F.pmod(F.xxhash64("id"), F.lit(90)) / 10.0 + 1).alias("w"))
    plain = sorted(map(tuple, Q.line_pack(df, ["k"], ["id"], "id", "w", 40.0, 0.5).collect()))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"pack-{parts}", "line packing")
    with use_limits(probe_bytes=0, min_rows=10, shares=parts):
        split = sorted(map(tuple, Q.line_pack(df, ["k"], ["id"], "id", "w", 40.0, 0.5).collect()))
    jobs = len(tracker.getJobIdsForGroup(f"pack-{parts}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert split == plain and plain[-1][2] > 300
    assert jobs <= 40, jobs
