"""Time slices: ordered per-key work that does not put a whole key in one task.

A window over ``partitionBy(key).orderBy(ts)`` sends every row of a key to one task, which
fails once one key holds a large share of the data. Here the rows of a key are cut into
slices of equal duration and the windows run over ``(key, slice)``. What a slice needs from
its neighbours is a few values (a last row, a count, the last N fixes), so each operator

1. reduces every slice to one small row,
2. runs a window over those small rows only, to learn what enters each slice,
3. joins the result back on ``(key, slice)``, where the rows already are.

The full rows are shuffled once. Keys must not be null; times are TIMESTAMP columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

US = "_us"
SLICE = "_slice"
MICROS = 1_000_000

# Candidate slice widths in seconds, widest first: a day down to a hundredth of a second.
WIDTHS = (86_400.0, 21_600.0, 3_600.0, 600.0, 60.0, 10.0, 1.0, 0.1, 0.01)


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


@dataclass(frozen=True)
class Slices:
    """Slice widths by key: ``seconds`` for most, a width of its own for each heavy value of column ``key``.

    Stands wherever a width does. A heavy key is cut finely without cutting the others, so no key
    has more slices than its rows are worth. Values are compared as text.
    """

    key: str
    seconds: float
    heavy: tuple[tuple[str, float], ...] = ()

    def width(self) -> Column:
        """Width in microseconds for the row's key."""
        most = F.lit(round(self.seconds * MICROS)).cast("bigint")
        if not self.heavy:
            return most
        own = F.create_map(*[F.lit(x) for k, w in self.heavy for x in (k, round(w * MICROS))]).cast("map<string,bigint>")
        return F.coalesce(F.try_element_at(own, F.col(self.key).cast("string")), most)


Width = float | Slices


def widest(width: Width) -> float:
    """The width of most keys, in seconds."""
    return width.seconds if isinstance(width, Slices) else width


def at_least(width: Width, seconds: float) -> Width:
    """The same widths, none of them below ``seconds``."""
    if isinstance(width, Slices):
        return Slices(width.key, max(width.seconds, seconds), tuple((k, max(w, seconds)) for k, w in width.heavy))
    return max(width, seconds)


def slice_id(us: str | Column, slice_seconds: Width) -> Column:
    """Number of the slice that holds the microsecond column ``us``."""
    us = F.col(us) if isinstance(us, str) else us
    width = slice_seconds.width() if isinstance(slice_seconds, Slices) else F.lit(round(slice_seconds * MICROS)).cast("bigint")
    return F.floor((us - F.pmod(us, width)) / width)


def sliced(df: DataFrame, ts: str, slice_seconds: Width) -> DataFrame:
    """Add the time in microseconds and the slice number."""
    return df.withColumn(US, F.unix_micros(ts)).withColumn(SLICE, slice_id(US, slice_seconds))


def within(keys: Sequence[str], tie: Sequence[str] = ()) -> WindowSpec:
    """Rows of one slice in time order."""
    return Window.partitionBy(*keys, SLICE).orderBy(US, *tie)


def within_sql(keys: Sequence[str], tie: Sequence[str] = ()) -> str:
    """The same window as SQL text, for the functions that take IGNORE NULLS."""
    parts = ", ".join(f"`{c}`" for c in [*keys, SLICE])
    order = ", ".join(f"`{c}`" for c in [US, *tie])
    return f"(PARTITION BY {parts} ORDER BY {order})"


def so_far(keys: Sequence[str], tie: Sequence[str] = ()) -> WindowSpec:
    """From the start of the slice up to and including the current row."""
    return within(keys, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def across(keys: Sequence[str]) -> WindowSpec:
    """Slices of one key in order; only ever used on one row per slice."""
    return Window.partitionBy(*keys).orderBy(SLICE)


def earlier(keys: Sequence[str]) -> WindowSpec:
    """All slices of the key before the current one."""
    return across(keys).rowsBetween(Window.unboundedPreceding, -1)


def position(tie: Sequence[str] = ()) -> Column:
    """Sort position of a row within its key."""
    return F.struct(US, *tie)


def with_previous(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], tie: Sequence[str], name: str
) -> DataFrame:
    """Add ``name``: a struct of ``cols`` from the previous row of the key, over slice borders."""
    last = df.groupBy(*keys, SLICE).agg(
        F.max_by(F.struct(*cols), position(tie)).alias("_last")
    )
    entering = last.select(*keys, SLICE, F.lag("_last").over(across(keys)).alias("_entering"))
    return (
        df.withColumn("_local", F.lag(F.struct(*cols)).over(within(keys, tie)))
        .join(entering, [*keys, SLICE], "left")
        .withColumn(name, F.coalesce("_local", "_entering"))
        .drop("_local", "_entering")
    )


def with_row_number(
    df: DataFrame, keys: Sequence[str], tie: Sequence[str], name: str
) -> DataFrame:
    """Add ``name``: the 1-based number of the row within its key, over slice borders."""
    sizes = df.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    offset = F.coalesce(F.sum("_rows").over(earlier(keys)), F.lit(0))
    entering = sizes.select(*keys, SLICE, offset.alias("_offset"))
    return (
        df.withColumn("_local", F.row_number().over(within(keys, tie)))
        .join(entering, [*keys, SLICE], "left")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def fit_slice_seconds(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    target_rows: int = 500_000,
    widths: Sequence[float] = WIDTHS,
) -> float:
    """Widest width that keeps every ``(key, slice)`` at or below ``target_rows``.

    Each pass reads only the key and time columns, counts map-side and returns one number to
    the driver. The heaviest count found says which width to try next, so two or three
    passes are enough. Call it on a source table and hand the width to the operators.
    """
    keys = as_list(keys)
    us = df.select(*keys, F.unix_micros(ts).alias(US))
    width = widths[0]
    while True:
        counts = us.groupBy(*keys, slice_id(US, width).alias(SLICE)).count()
        heaviest = counts.agg(F.max("count")).first()[0] or 0
        finer = [w for w in widths if w < width]
        if heaviest <= target_rows or not finer:
            return width
        wanted = width * target_rows / heaviest
        width = next((w for w in finer if w <= wanted), finer[-1])


def fit_slices(
    df: DataFrame, keys: str | Sequence[str], ts: str, target_rows: int = 500_000, most_heavy: int = 1000,
    widths: Sequence[float] = WIDTHS,
) -> Slices:
    """Widths that keep every slice at or below ``target_rows``: a common one, and finer ones for up to ``most_heavy`` keys.

    The common width is the widest that leaves at most ``most_heavy`` values of the first key too
    heavy; these are brought to the driver by name. Each pass counts map-side, and a heavy key's
    count says which width to try next, so two or three passes are enough for each kind.
    """
    keys = as_list(keys)
    us = df.select(*keys, F.unix_micros(ts).alias(US))

    def heaviest(plan: Slices) -> DataFrame:
        counts = us.groupBy(*keys, slice_id(US, plan).alias(SLICE)).count()
        return counts.groupBy(F.col(keys[0]).cast("string").alias("k")).agg(F.max("count").alias("n")).filter(F.col("n") > target_rows)

    for common in widths:
        plan = Slices(keys[0], common)
        over = heaviest(plan).limit(most_heavy + 1).collect()
        if len(over) <= most_heavy:
            break
    else:
        return plan
    heavy: dict[str, float] = {}
    while True:
        finer = {}
        for row in over:
            now = heavy.get(row.k, plan.seconds)
            wanted = [w for w in widths if w < now]
            if wanted:
                finer[row.k] = next((w for w in wanted if w <= now * target_rows / row.n), wanted[-1])
        if not finer:
            return plan
        heavy |= finer
        plan = Slices(keys[0], plan.seconds, tuple(sorted(heavy.items())))
        over = heaviest(plan).collect()
