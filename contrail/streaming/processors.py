"""Keyed state for what Spark has no built-in streaming operator for.

Rows of an aircraft are held until the watermark has passed them and are then handled in event
time order, so the result does not depend on how they arrive, as long as they are not later than
the watermark allows. What is held is bounded by that lateness and by the rate limit of the
source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``); the rest of the state is a few values
per key, dropped by a timer once the aircraft has been silent long enough. Spark sends what one
aircraft (or one ``Share`` of all keys) puts out in one micro-batch as one Arrow batch, which the
same rate limit bounds.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("rows", T.BinaryType())])
_PLACE = T.StructType([T.StructField("chunk", T.LongType())])
_HELD = T.StructType([T.StructField("rows", T.BinaryType())])


def _missing(value: Any) -> bool:
    return value is None or value != value


class _Keyed(StatefulProcessor):
    """Rows held by event time, and one JSON value per key, forgotten ``keep_us`` after the last row.

    Up to ``tail_rows`` held rows lie in the value itself, so an aircraft with few rows costs one read
    and one write a micro-batch. More are sorted by time and cut into chunks of ``chunk_rows``; only
    chunks that the watermark has reached are read, and what it has not passed of them goes back. An
    index of the chunks (number and earliest row of each) is kept with the value.
    """

    keep_us: int
    columns: list[str]
    order: list[str]
    tail_rows: int = 500
    chunk_rows: int = 2_000
    most_rows: int = 20_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", _STATE)
        self.held = handle.getMapState("held", _PLACE, _HELD)
        self.at = self.columns.index("at_us")
        self.sorts = [self.columns.index(c) for c in self.order]

    def fold(self, state: dict[str, Any] | None, rows: list[tuple]) -> tuple[dict[str, Any], list[Row]]:
        """New state (with ``last``, the time it counts from) and output for rows in order."""
        raise NotImplementedError

    def ended(self, key: tuple, state: dict[str, Any]) -> list[Row]:
        """Output when the state is forgotten."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept, tail = self._read()
        for row in rows:
            if row[self.at] is not None:
                tail.append(tuple(row))
            if len(tail) >= self.most_rows:
                self._hold(kept, tail)
                tail = []
        return self._advance(key, kept, tail, timerValues, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, *self._read(), timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _read(self) -> tuple[dict[str, Any], list[tuple]]:
        found = self.value.get()
        if found is None:
            return {"state": None, "open": {}, "next": 0, "timer": None}, []
        return json.loads(found[0]), pickle.loads(found[1])

    def _write(self, kept: dict[str, Any], rows: list[tuple]) -> None:
        self.value.update((json.dumps(kept), pickle.dumps(rows)))

    def _rank(self, row: tuple) -> tuple:
        return tuple((row[i] is None, row[i]) for i in self.sorts)

    def _hold(self, kept: dict[str, Any], rows: list[tuple]) -> None:
        rows.sort(key=lambda r: r[self.at])
        for i in range(0, len(rows), self.chunk_rows):
            part = rows[i : i + self.chunk_rows]
            self.held.updateValue((kept["next"],), (pickle.dumps(part),))
            kept["open"][str(kept["next"])] = part[0][self.at]
            kept["next"] += 1

    def _due(self, kept: dict[str, Any], rows: list[tuple], passed: int) -> Iterator[list[tuple]]:
        """Rows up to ``passed`` in order, as far as the chunks read so far are complete; the others are left in ``rows``."""
        chunks = sorted((first, chunk) for chunk, first in kept["open"].items() if first <= passed)
        for n in range(len(chunks) + 1):
            before = min(chunks[n][0], passed + 1) if n < len(chunks) else passed + 1
            now = [r for r in rows if r[self.at] < before]
            if now:
                rows[:] = [r for r in rows if r[self.at] >= before]
                yield sorted(now, key=self._rank)
            if n < len(chunks):
                place = (int(chunks[n][1]),)
                rows += pickle.loads(self.held.getValue(place)[0])
                self.held.removeKey(place)
                del kept["open"][chunks[n][1]]

    def _advance(self, key, kept: dict[str, Any], rows: list[tuple], timerValues, fired: int | None) -> Iterator[Row]:
        """Handle what the watermark has passed, and set the timer for what comes next."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state = kept["state"]
        for now in self._due(kept, rows, passed):
            state, found = self.fold(state, now)
            yield from found
        if len(rows) > self.tail_rows:
            self._hold(kept, rows)
            rows = []
        due = [*kept["open"].values(), *(r[self.at] for r in rows)]
        if state is not None and state["last"] + self.keep_us < passed:
            yield from self.ended(key, state)
            state = None
        elif state is not None:
            due.append(state["last"] + self.keep_us + 1000)
        timer, old = -(-min(due) // 1000) if due else None, kept["timer"]
        if timer != old or old == fired:  # Spark itself removes a timer that has fired
            if old is not None and old != fired:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        if state is None and not due:
            self.value.clear()
        else:
            self._write(kept | {"state": state, "timer": timer}, rows)

    def close(self) -> None:
        pass


class KeepAfter(_Keyed):
    """Rows more than ``hop_us`` after the last row that was kept."""

    def __init__(self, hop_us: int, columns: Sequence[str], order: list[str]) -> None:
        self.keep_us = hop_us
        self.hop_us = hop_us
        self.columns = list(columns)
        self.order = order

    def fold(self, state, rows):
        last, keep, made = state["last"] if state else None, [], Row(*self.columns)
        for row in rows:
            if last is None or row[self.at] > last + self.hop_us:
                keep.append(made(*row))
                last = row[self.at]
        return {"last": last}, keep


class TrackState(_Keyed):
    """Current fix, the fix ``back_n`` distinct fixes ago and the last datums, per message."""

    def __init__(
        self, back_n: int, remember_us: int, carried: list[str], columns: Sequence[str], order: list[str], out: list[str]
    ) -> None:
        self.keep_us = remember_us
        self.back_n = back_n
        self.carried = carried
        self.columns = list(columns)
        self.order = order
        self.out = out

    def fold(self, state, rows):
        found, result = [], Row(*self.out)
        for values in rows:
            row = dict(zip(self.columns, values))
            us = row["at_us"]
            if state is None or us - state["last"] > self.keep_us:
                state = {"start": us, "fixes": [], "first": None, "seen": {}}
            state["last"] = us
            for c in self.carried:
                if not _missing(row[c]):
                    state["seen"][c] = [us, row[c]]
            lat, lon = row["latitude"], row["longitude"]
            fixes = state["fixes"]
            if not (_missing(lat) or _missing(lon)):
                if not fixes or fixes[-1][1:] != [lat, lon]:
                    fixes.append([us, lat, lon])
                    state["first"] = state["first"] or fixes[-1]
                    del fixes[: -self.back_n]
            if len(fixes) >= 2:
                back = fixes[0] if len(fixes) == self.back_n else state["first"]
                made = {c: row[c] for c in self.out if c in row}
                made["flight_us"] = state["start"]
                for name, fix in (("cur", fixes[-1]), ("back", back)):
                    made |= {f"{name}_us": fix[0], f"{name}_lat": fix[1], f"{name}_lon": fix[2]}
                for c in self.carried:
                    at, value = state["seen"].get(c, (None, None))
                    made |= {f"{c}_us": at, f"{c}_value": value}
                found.append(result(*[made[c] for c in self.out]))
        return state, found


class Share(_Keyed):
    """Many keys in one value: the rows of a share of all keys are held together, and each key has its state of ``one``.

    A key with a value of its own costs some calls of the state store and two timers, however few its
    rows are; a share costs as much for all its keys. A key's state is dropped with the first rows
    later than ``keep_us`` behind it, when it no longer counts. ``one`` puts out nothing when it is forgotten.
    """

    def __init__(self, one: _Keyed, keys: Sequence[str]) -> None:
        self.one = one
        self.keep_us, self.columns, self.order = one.keep_us, one.columns, one.order
        self.places = [self.columns.index(c) for c in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.one.at, self.one.sorts = self.at, self.sorts

    def _read(self) -> tuple[dict[str, Any], list[tuple]]:
        kept, held = super()._read()
        if not held:
            return kept, []
        rows, keys = held
        if kept["state"] is not None:
            kept["state"]["keys"] = keys
        return kept, rows

    def _write(self, kept, rows):
        state = kept["state"]
        if state is None:
            super()._write(kept, (rows, {}))
        else:
            super()._write(kept | {"state": {"last": state["last"]}}, (rows, state["keys"]))

    def fold(self, state, rows):
        keys, own, found = state["keys"] if state else {}, {}, []
        for row in rows:
            own.setdefault(tuple([row[i] for i in self.places]), []).append(row)
        for key, those in own.items():
            keys[key], made = self.one.fold(keys.get(key), those)
            found += made
        last = rows[-1][self.at]
        return {"last": last, "keys": {k: v for k, v in keys.items() if v["last"] + self.keep_us >= last}}, found


class LiveStatus(_Keyed):
    """What is known of an aircraft now, sent on whenever it changes; with no packets once it has been silent too long."""

    def __init__(self, remember_us: int, columns: Sequence[str], order: list[str], out: list[str]) -> None:
        self.keep_us = remember_us
        self.columns = list(columns)
        self.order = order
        self.out = out

    def fold(self, state, rows):
        place = [self.columns.index(c) for c in ("at_us", "type_cat", "callsign", "icao")]
        for us, kind, name, icao in ([row[i] for i in place] for row in rows):
            if state is None or us - state["last"] > self.keep_us:
                state = {"first": us, "packets": 0, "callsign": None, "kinds": {}}
            state["last"] = us
            state["packets"] += 1
            state["kinds"][str(int(kind))] = state["kinds"].get(str(int(kind)), 0) + 1
            if isinstance(name, str):
                state["callsign"] = name
        return state, [self._row(icao, state, state["packets"])]

    def ended(self, key, state):
        return [self._row(key[0], state, 0)]

    def _row(self, icao, state: dict[str, Any], packets: int) -> Row:
        row = {
            "icao": icao, "packets": packets, "callsign": state["callsign"], "first_us": state["first"], "last_us": state["last"],
            "kinds": json.dumps(dict(sorted(state["kinds"].items()))),
        }
        return Row(*self.out)(*[row[c] for c in self.out])


class LiveBoard(StatefulProcessor):
    """The live aircraft of one share of all: their number and the ``k`` with most packets, sent on when they change.

    What is known of a board is read at once, as its busiest are looked for among all of it anyway.
    """

    def __init__(self, k: int, names: list[str], kinds: T.StructType) -> None:
        self.k = k
        self.names = names
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", T.StructType([self.kinds["icao"]]), T.StructType([self.kinds[n] for n in self.names if n != "icao"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        others = [c for c in self.names if c != "icao"]
        latest: dict[Any, dict[str, Any]] = {}
        for part in rows:
            for row in part.to_dict("records"):
                # An aircraft that fell silent and came back in one micro-batch sends both; the later one counts.
                rank = (row["last_us"], row["packets"] == 0)
                if row["icao"] not in latest or rank >= (latest[row["icao"]]["last_us"], latest[row["icao"]]["packets"] == 0):
                    latest[row["icao"]] = row
        live = {icao[0]: tuple(value) for icao, value in self.live.iterator()}
        for icao, row in latest.items():
            if row["packets"]:
                live[icao] = tuple(row[c] for c in others)
                self.live.updateValue((icao,), live[icao])
            elif live.pop(icao, None) is not None:
                self.live.removeKey((icao,))
        packets, first = others.index("packets"), others.index("first_us")
        best = heapq.nsmallest(self.k, live.items(), key=lambda e: (-e[1][packets], e[1][first], e[0]))
        found = [dict(zip(others, value), icao=icao, board=key[0], live=len(live), place=i) for i, (icao, value) in enumerate(best)]
        yield pd.DataFrame(found or [{"board": key[0], "live": 0, "place": 0}], columns=["board", "live", "place", *self.names], dtype=object)

    def close(self) -> None:
        pass
