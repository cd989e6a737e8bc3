"""Keyed state without a stream: what is read and written for one aircraft."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from contrail.streaming.processors import KeepAfter, Share, TrackState

MICROS = 1_000_000


class Handle:
    """State of one key in memory; counts what is asked of it."""

    def __init__(self):
        self.calls, self.one, self.map, self.timers = Counter(), [None], {}, set()

    def counted(self, name, fn):
        def call(*args):
            self.calls[name] += 1
            return fn(*args)

        return call

    def getValueState(self, *_):
        put = lambda v: self.one.__setitem__(0, v)
        return SimpleNamespace(get=self.counted("get", lambda: self.one[0]), update=self.counted("update", put),
                               exists=self.counted("exists", lambda: self.one[0] is not None), clear=lambda: put(None))

    def getMapState(self, *_):
        return SimpleNamespace(getValue=self.counted("chunk", self.map.__getitem__), removeKey=self.counted("drop", self.map.pop),
                               updateValue=self.counted("hold", self.map.__setitem__))

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)


def run(processor, batches, late, columns=("at_us", "id")):
    """Feed micro-batches of (time, id) as Spark does: the watermark follows the batch before, fired timers come after the rows."""
    handle, out, mark = Handle(), [], 0
    processor.init(handle)
    for batch in batches:
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda now=mark: now)
        if batch:
            out += processor.handleInputRows(("a",), (Row(*columns)(*r) for r in batch), times)
        for at in sorted(t for t in handle.timers if t <= mark):
            out += processor.handleExpiredTimer(("a",), times, SimpleNamespace(getExpiryTimeInMs=lambda now=at: now))
            handle.timers.discard(at)
        mark = max([mark, *((r[0] - late * MICROS) // 1000 for r in batch if r[0] is not None)])
    return handle, [tuple(r) for r in out]


def kept(rows, hop):
    found, last = [], None
    for r in sorted(rows):
        if last is None or r[0] > last + hop:
            found.append(r)
            last = r[0]
    return found


def test_few_rows_far_apart_cost_one_read_and_one_write_a_batch():
    rows = [(n * 3600 * MICROS, n) for n in range(1, 301)]
    batches = [rows[:150], rows[150:], [(10**7 * MICROS, 0)], []]
    handle, out = run(KeepAfter(60 * MICROS, ["at_us", "id"], ["at_us", "id"]), batches, 10)
    assert out == rows
    assert sum(handle.calls.values()) <= 2 * 2 * len(batches)


@pytest.mark.parametrize("tail,chunk,most", [(0, 1, 1), (3, 2, 7), (10, 4, 25), (500, 2000, 20000)])
@pytest.mark.parametrize("hop", [0, 3, 40])
def test_chunks_give_the_rows_in_order(tail, chunk, most, hop):
    rng = random.Random(tail + hop)
    rows = [(rng.randrange(1, 400) * MICROS // 2, n) for n in range(500)]
    order = sorted(rows, key=lambda r: r[0] + rng.randrange(20) * MICROS)
    processor = KeepAfter(hop * MICROS, ["at_us", "id"], ["at_us", "id"])
    processor.tail_rows, processor.chunk_rows, processor.most_rows = tail, chunk, most
    batches = [order[i : i + 37] for i in range(0, len(order), 37)] + [[(10**6 * MICROS, -1)], [], []]
    handle, out = run(processor, batches, 20)
    assert out == kept(rows, hop * MICROS)
    assert len(handle.map) <= 1  # the row behind the others is held


def test_rows_without_a_time_are_left_out():
    _, out = run(KeepAfter(0, ["at_us", "id"], ["at_us", "id"]), [[(None, 1), (MICROS, 2)], [(10**6 * MICROS, 3)], []], 0)
    assert (MICROS, 2) in out and all(r[0] is not None for r in out)


def test_many_keys_cost_one_read_and_one_write_a_batch():
    columns = ["at_us", "id", "key"]
    rows = [(n * MICROS, n, f"k{n % 400}") for n in range(1, 801)]
    batches = [rows[:400], rows[400:], [(10**7 * MICROS, 0, "k0")], []]
    processor = Share(KeepAfter(60 * MICROS, columns, ["at_us", "id"]), ["key"])
    processor.tail_rows = 1000
    handle, out = run(processor, batches, 10, columns)
    assert sorted(out) == rows
    assert sum(handle.calls.values()) <= 2 * 2 * len(batches)


@pytest.mark.parametrize("tail,chunk,most", [(0, 1, 1), (3, 2, 7), (500, 2000, 20000)])
@pytest.mark.parametrize("make,hop", [("keep", 0), ("keep", 3), ("keep", 40), ("track", 30)])
def test_keys_of_a_share_have_results_of_their_own(make, hop, tail, chunk, most):
    rng = random.Random(tail + hop)
    keys = ["a", "b", "c", None, ""]
    columns = ["at_us", "id", "key", "latitude", "longitude", "callsign"]
    rows = [
        (rng.randrange(1, 400) * MICROS // 2, n, rng.choice(keys), rng.choice([None, 1.0, 2.0]), 3.0, rng.choice([None, "X", "Y"])) for n in range(500)
    ]
    out = ["at_us", "id", "key", "flight_us", *[f"{c}_{p}" for c in ("cur", "back") for p in ("us", "lat", "lon")], "callsign_us", "callsign_value"]

    def one():
        if make == "keep":
            return KeepAfter(hop * MICROS, columns, ["at_us", "id"])
        return TrackState(3, hop * MICROS, ["callsign"], columns, ["at_us", "id"], out)

    def fed(processor, rows):
        processor.tail_rows, processor.chunk_rows, processor.most_rows = tail, chunk, most
        order = sorted(rows, key=lambda r: r[0] + r[1] % 20 * MICROS)
        last = (10**6 * MICROS, -1, order[0][2], None, None, None)
        handle, found = run(processor, [order[i : i + 37] for i in range(0, len(order), 37)] + [[last], [], []], 20, columns)
        return handle, [r for r in found if r[columns.index("id")] >= 0]

    handle, got = fed(Share(one(), ["key"]), rows)
    want = [r for k in keys for r in fed(one(), [r for r in rows if r[2] == k])[1]]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want
    assert len(handle.map) <= 1
