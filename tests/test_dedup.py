import random

import pytest
from helpers import epoch, frame

from contrail.operators import frames as fr


def brute(rows, n):
    kept, last = [], {}
    for k, t in sorted(set(rows), key=lambda r: (r[0], r[1])):
        if k not in last or round(10 * t) > round(10 * last[k]) + 10 * n:
            kept.append((k, t))
            last[k] = t
    return sorted(kept)


@pytest.mark.parametrize("width", [1.0, 3.0, 20.0, 3600.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sequential(spark, width, seed, monkeypatch):
    monkeypatch.setattr(fr, "BLOCK", 4)
    rng = random.Random(seed)
    rows = [("hot", round(rng.uniform(0, 400), 1)) for _ in range(600)]
    rows += [("even", float(t)) for t in range(0, 300)]
    rows += [("rare", float(t)) for t in (0, 5, 5.5, 11, 400)]
    rows += [(f"k{rng.randrange(20)}", round(rng.uniform(0, 400), 1)) for _ in range(200)]
    got = fr.dedup_within(frame(spark, rows, "k string, ts double"), "k", "ts", 5, slice_seconds=width)
    assert sorted(map(tuple, epoch(got, "ts").collect())) == brute(rows, 5)


def test_interval_edges(spark):
    rows = [("a", 0.0), ("a", 4.0), ("a", 5.0), ("b", 0.0), ("b", 6.0)]
    got = fr.dedup_within(frame(spark, rows, "k string, ts double"), "k", "ts", 5)
    assert sorted(map(tuple, epoch(got, "ts").collect())) == [("a", 0.0), ("b", 0.0), ("b", 6.0)]


def test_new_message_is_kept_not_the_old_one(spark):
    rows = [("r1", 0.0, "h"), ("r2", 0.0, "h"), ("r3", 6.0, "h")]
    df = frame(spark, rows, "receiver string, ts double, hex string")
    got = fr.dedup_within(df, "hex", "ts", 5, tie=["receiver"])
    assert sorted(r.receiver for r in got.collect()) == ["r1", "r3"]
