import random

import pytest
from helpers import epoch, frame

from contrail.operators.qualify import sdecimate


def brute(rows, count, seconds):
    kept, first, seen = [], {}, {}
    for k, t, n in sorted(rows):
        bucket = k, int((t - first.setdefault(k, t)) // seconds)
        seen[bucket] = seen.get(bucket, 0) + 1
        if seen[bucket] <= count:
            kept.append((k, t, n))
    return kept


@pytest.mark.parametrize("width", [2.0, 10.0, 1000.0])
@pytest.mark.parametrize("count,seconds", [(1, 7.0), (3, 25.0), (2, 400.0)])
def test_buckets_over_slice_borders(spark, width, count, seconds):
    rng = random.Random(count)
    rows = [(f"k{rng.randrange(4)}", float(rng.randrange(300)), n) for n in range(300)]
    df = frame(spark, rows, "k string, ts double, n int")
    got = epoch(sdecimate(df, ["k"], "ts", count, seconds, ["n"], width), "ts")
    assert sorted((r.k, r.ts, r.n) for r in got.collect()) == brute(rows, count, seconds)


def test_rows_without_key_or_time_are_left_out(spark):
    rows = [("a", 1.0, 1), ("a", None, 2), (None, 1.0, 3)]
    got = sdecimate(frame(spark, rows, "k string, ts double, n int"), ["k"], "ts", 5, 10, ["n"])
    assert [r.n for r in got.collect()] == [1]


def test_rows_are_not_shuffled_again_for_their_bucket(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = frame(spark, [("a", float(t), t) for t in range(5)], "k string, ts double, n int")
        plan = sdecimate(df, ["k"], "ts", 2, 3, ["n"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and not any("_in_nth" in line or "_bucket" in line for line in joins)
