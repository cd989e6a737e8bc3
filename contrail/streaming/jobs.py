"""Streaming forms of the operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from contrail import schema
from contrail.operators.frames import decode_messages, with_fields
from contrail.operators.rules import Rules
from contrail.operators.slices import MICROS, SLICE, as_list, slice_id
from contrail.operators.track import (
    finish_motion,
    flight_bounds,
    status_lines,
)
from contrail.plans.archiving import archive_flights
from contrail.plans.live import state_alerts
from contrail.sources.archive import write_archive
from contrail.sources.scratch import materialize, new_path
from contrail.streaming.processors import KeepAfter, LiveBoard, LiveStatus, Share, TrackState

# Names that start with an underscore are lost on the way into a processor.
AT = "at_us"
SHARE = "share_of_keys"
SHARES = 1024  # shares of all keys whose rows and states are kept together
DAY = "staged_day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs this state store; call before a query with state is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def watermarked(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    """Set how late rows may be; without ``lateness`` the stream has its watermark from its source already."""
    return df if lateness is None else df.withWatermark(ts, lateness)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because they came after the watermark, as far as progress reports go back."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def _shared(rows: DataFrame, keys: list[str], shares: int | None) -> tuple[DataFrame, list[str]]:
    """Rows and the columns by which they share a state: their keys, or the number of a share of all keys."""
    if not shares:
        return rows, keys
    return rows.withColumn(SHARE, F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int")), [SHARE]


def stream_dedup(
    df: DataFrame, keys: str | Sequence[str], ts: str, seconds: float = schema.MERGE_SECONDS,
    tie: Sequence[str] = (), lateness: str | None = None, shares: int | None = None,
) -> DataFrame:
    """Streaming ``dedup_within``: the same rows in any micro-batches and any order within the lateness.

    Rows come out once the watermark has passed them, so the last ones wait for newer rows. Where
    there are many keys with few rows each, ``shares`` keeps those of each of so many shares together.
    """
    hop = round(seconds * MICROS)
    rows, group = _shared(watermarked(df, ts, lateness).withColumn(AT, F.unix_micros(ts)), as_list(keys), shares)
    one = KeepAfter(hop, rows.columns, [AT, *tie])
    kept = rows.groupBy(*group).transformWithState(
        statefulProcessor=Share(one, as_list(keys)) if shares else one,
        outputStructType=rows.schema,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName=ts,
    )
    return kept.drop(AT, SHARE)


def stream_dedup_coarse(
    df: DataFrame, keys: str | Sequence[str], ts: str, seconds: float = schema.MERGE_SECONDS
) -> DataFrame:
    """Built-in streaming duplicate removal: JVM only, state bounded by the watermark.

    It forgets a key only between micro-batches, so a repeat later than ``seconds`` in the
    same micro-batch is dropped too. Use it with short triggers.
    """
    return df.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(as_list(keys))


def stream_flights(
    messages: DataFrame, key: str = "icao", ts: str = "ts",
    gap_seconds: float = schema.REMEMBER_SECONDS, lateness: str | None = "0 seconds",
) -> DataFrame:
    """Flights that have closed: emitted once the watermark has passed their silence."""
    return flight_bounds(watermarked(messages, ts, lateness), key, ts, gap_seconds)


def stream_states(
    messages: DataFrame, back_n: int = schema.BACK_N, fresh_seconds: float | None = None,
    remember_seconds: float = schema.REMEMBER_SECONDS, key: str = "icao", ts: str = "ts",
    tie: Sequence[str] = (), lateness: str | None = None, shares: int | None = None,
) -> DataFrame:
    """Streaming ``motion``, in event time order. State finds the fixes; distances stay Spark columns.

    With ``shares`` the aircraft of each of so many shares are kept together, see ``stream_dedup``.
    """
    fresh = round((back_n if fresh_seconds is None else fresh_seconds) * MICROS)
    carried = [
        c
        for c in ("callsign", "altitude", "vertical_speed", "horizontal_speed", "direction")
        if c in messages.columns
    ]
    rows = (
        watermarked(messages, ts, lateness)
        .withColumn(AT, F.unix_micros(ts))
        .select(key, ts, AT, *tie, "latitude", "longitude", *carried)
    )
    rows, group = _shared(rows, [key], shares)
    types = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([
        T.StructField(key, types[key]),
        T.StructField(ts, types[ts]),
        *[T.StructField(c, types[c]) for c in tie],
        T.StructField("flight_us", T.LongType()),
        *[
            T.StructField(f"{name}_{part}", T.LongType() if part == "us" else T.DoubleType())
            for name in ("cur", "back")
            for part in ("us", "lat", "lon")
        ],
        *[
            field
            for c in carried
            for field in (
                T.StructField(f"{c}_us", T.LongType()), T.StructField(f"{c}_value", types[c])
            )
        ],
    ])
    one = TrackState(back_n, round(remember_seconds * MICROS), carried, rows.columns, [AT, *tie], [f.name for f in out])
    found = rows.groupBy(*group).transformWithState(
        statefulProcessor=Share(one, [key]) if shares else one,
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName=ts,
    )
    held = {
        f"_{name}": F.struct(*[F.col(f"{name}_{p}").alias(p) for p in ("us", "lat", "lon")])
        for name in ("cur", "back")
    }
    held |= {
        f"_{c}": F.struct(F.col(f"{c}_us").alias("us"), F.col(f"{c}_value").alias("value"))
        for c in carried
    }
    found = found.withColumns(held).withColumn("flight_start", F.timestamp_micros("flight_us"))
    return finish_motion(found, carried, fresh, [key, "flight_start", ts, *tie])


def stream_alerts(messages: DataFrame, rules: Rules, **options) -> DataFrame:
    """Alerts as messages arrive."""
    return state_alerts(stream_states(messages, **options), rules)


def stream_frame_alerts(
    frames: DataFrame, rules: Rules, lateness: str | None, home: tuple[float, float] = schema.HOME,
    merge_seconds: float = schema.MERGE_SECONDS, tie: Sequence[str] = ("hex",), keep: Sequence[str] = (),
    shares: int = SHARES, **options,
) -> DataFrame:
    """Raw frames to alerts in one query: duplicates merged, decoded, followed, tested against the rules.

    The watermark is set once, on the frames. ``keep`` names further columns of the frames that
    ``tie`` needs. Nearly every frame is a key of its own, so state is kept for ``shares`` of all keys.
    """
    merged = stream_dedup(frames, "hex", "ts", merge_seconds, ["receiver"], lateness, shares)
    messages = decode_messages(with_fields(merged), *home, keep=["hex", *keep])
    return stream_alerts(messages, rules, tie=tie, shares=shares, **options)


def start(
    df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append",
    once: bool = False, hz: float = schema.TICKS_PER_SECOND, checkpoint: str | None = None,
) -> StreamingQuery:
    """Run a stream into a batch function, ``hz`` times a second or over what there is now."""
    spark = df.sparkSession
    trigger = {"availableNow": True} if once else {"processingTime": f"{round(1000 / hz)} milliseconds"}
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or new_path(spark, "stream"))
        .foreachBatch(sink)
        .trigger(**trigger)
        .start()
    )


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write every micro-batch under its number, so that a retried one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stream_status(
    messages: DataFrame, show: Callable[[DataFrame, int], None], k: int = schema.TOP_PLANES,
    advanced: bool = True, tie: Sequence[str] = (), once: bool = False, checkpoint: str | None = None,
) -> StreamingQuery:
    """Running status: the k busiest aircraft after every micro-batch.

    The stream is aggregated to one row per aircraft and kind of message; the status of each
    tick is made from that small result.
    """
    at = F.struct("ts", *tie)
    counts = messages.groupBy("icao", "type_cat").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.max_by("callsign", F.when(F.col("callsign").isNotNull(), at)).alias("callsign"),
        F.max(F.when(F.col("callsign").isNotNull(), F.col("ts"))).alias("named"),
    )

    def tick(batch: DataFrame, number: int) -> None:
        entry = F.struct("type_cat", "n")
        stats = batch.groupBy("icao").agg(
            F.sum("n").alias("packets"), F.min("first").alias("first_packet"),
            F.max("last").alias("last_update"),
            F.max_by("callsign", "named").alias("callsign"),
            F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("packet_type"),
        )
        show(status_lines(stats, k, advanced), number)

    return start(counts, tick, "complete", once, checkpoint=checkpoint)


BOARDS = 64  # shares of all aircraft whose live ones are kept together
_STATUS = ["icao", "packets", "callsign", "first_us", "last_us", "kinds"]


def stream_live(
    messages: DataFrame, k: int = schema.TOP_PLANES, remember_seconds: float = schema.REMEMBER_SECONDS,
    key: str = "icao", ts: str = "ts", tie: Sequence[str] = (), lateness: str | None = None, boards: int = BOARDS,
) -> DataFrame:
    """The aircraft tracked now, as changes: for each board the number of live ones and its ``k`` busiest.

    An aircraft is live from a message until ``remember_seconds`` without one; its packets count
    from when it came. State is one small value for each live aircraft. Rows: board, live, place
    (from 0) and the status; a board without live aircraft has one row with place 0 and no key.
    ``live_status`` puts the newest rows of all boards together.
    """
    rows = watermarked(messages, ts, lateness).withColumn(AT, F.unix_micros(ts))
    rows = rows.select(F.col(key).alias("icao"), ts, AT, *tie, "type_cat", "callsign")
    kinds = T.StructType([rows.schema["icao"]])
    for name, kind in (("packets", "long"), ("callsign", "string"), ("first_us", "long"), ("last_us", "long"), ("kinds", "string")):
        kinds = kinds.add(name, kind)
    status = rows.groupBy("icao").transformWithState(
        statefulProcessor=LiveStatus(round(remember_seconds * MICROS), rows.columns, [AT, *tie], _STATUS),
        outputStructType=kinds, outputMode="Update", timeMode="EventTime",
    )
    out = T.StructType().add("board", "integer").add("live", "long").add("place", "integer")
    board = F.pmod(F.xxhash64("icao"), F.lit(boards)).cast("int")
    return status.withColumn("board", board).groupBy("board").transformWithStateInPandas(
        statefulProcessor=LiveBoard(k, _STATUS, kinds), outputStructType=T.StructType([*out.fields, *kinds.fields]),
        outputMode="Update", timeMode="None",
    )


def live_status(changes: DataFrame, order: str, k: int = schema.TOP_PLANES) -> tuple[DataFrame, DataFrame]:
    """Number of live aircraft (one row: live) and the k busiest (status columns), from the newest rows of ``stream_live``.

    ``order`` names the column that numbers the micro-batches.
    """
    newest = changes.groupBy("board").agg(F.max(order).alias(order))
    now = changes.join(newest, ["board", order])
    live = now.filter("place = 0").agg(F.coalesce(F.sum("live"), F.lit(0)).alias("live"))
    return live, now.filter("icao is not null").orderBy(F.desc("packets"), "first_us", "icao").limit(k).select(*_STATUS)


def stream_archive(
    messages: DataFrame, rules: Rules, staging: str, path: str, checkpoint: str,
    gap_seconds: float = schema.REMEMBER_SECONDS, lateness: str = "0 seconds",
    slice_seconds: float = schema.SLICE_SECONDS, once: bool = False, **options,
) -> list[StreamingQuery]:
    """Archive flights as they close.

    One query keeps the messages in a staging table by day; a second follows that table, finds
    closed flights and archives those that qualify from their staged messages. With ``once``
    the first has finished before the second starts. Started again with the same ``checkpoint``
    both go on where they stopped: a micro-batch that runs again replaces its own save, because
    the name of a save is made of the checkpoint and the number of the micro-batch. Old days of
    the staging table may be deleted once no flight can reach back to them.
    """
    spark = messages.sparkSession
    day = F.to_date("ts").alias(DAY)
    keep = (
        messages.select("*", day).writeStream.format("parquet").partitionBy(DAY)
        .option("path", staging)
        .option("checkpointLocation", f"{checkpoint}/staging")
        .trigger(**({"availableNow": True} if once else {"processingTime": "10 seconds"}))
        .start()
    )
    if once:
        keep.awaitTermination()
    layout = T.StructType([*messages.schema.fields, T.StructField(DAY, T.DateType())])
    staged = spark.readStream.schema(layout).parquet(staging).drop(DAY)
    closed = stream_flights(staged, "icao", "ts", gap_seconds, lateness)
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def save(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "closed_flights")
        first, last = batch.agg(F.to_date(F.min("flight_start")), F.to_date(F.max("flight_end"))).first()
        if first is None:
            return
        rows = spark.read.schema(layout).parquet(staging).filter(F.col(DAY).between(first, last)).drop(DAY)
        flown = materialize(messages_of(rows, batch, slice_seconds), "closed")
        archive = archive_flights(flown, rules, slice_seconds=slice_seconds, **options)
        write_archive(archive, path, f"{name}-{number}")

    return [keep, start(closed, save, "append", once, checkpoint=f"{checkpoint}/flights")]


def messages_of(
    messages: DataFrame, closed: DataFrame, slice_seconds: float = schema.SLICE_SECONDS
) -> DataFrame:
    """Messages of the given flights, matched slice by slice."""
    number = lambda c: slice_id(c, slice_seconds)
    spans = (
        closed.select(
            "icao", "flight_start", F.unix_micros("flight_start").alias("_lo"),
            F.unix_micros("flight_end").alias("_hi"),
        )
        .withColumn(SLICE, F.explode(F.sequence(number("_lo"), number("_hi"))))
    )
    rows = messages.withColumn(AT, F.unix_micros("ts")).withColumn(SLICE, number(AT))
    return (
        rows.join(spans, ["icao", SLICE])
        .filter(F.col(AT).between(F.col("_lo"), F.col("_hi")))
        .select(*messages.columns, "flight_start")
    )
