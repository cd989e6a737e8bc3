"""Alert rows and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alerts(hits: DataFrame, icao: str = "icao", ts: str = "ts") -> DataFrame:
    """One alert per update, zone and level that holds."""
    return hits.select(
        F.col(icao).alias("icao"),
        F.coalesce("callsign", F.lit("")).alias("callsign"),
        F.col("level").alias("type"),
        F.struct("altitude", "latitude", "longitude").alias("payload"),
        "zone",
        "eta",
        F.col(ts).alias("ts"),
        "alert_method",
        "arguments",
    )


def first_only(rows: DataFrame) -> DataFrame:
    """The earliest alert per aircraft, zone and level, for those who want no repeats."""
    cols = [c for c in rows.columns if c not in ("icao", "zone", "type")]
    return (
        rows.groupBy("icao", "zone", "type")
        .agg(F.min_by(F.struct(*cols), "ts").alias("_row"))
        .select("icao", "zone", "type", "_row.*")
        .select(*rows.columns)
    )


def per_tick(rows: DataFrame, tick: str = "500 milliseconds") -> DataFrame:
    """The last alert of each tick per aircraft, zone and level."""
    cols = [c for c in rows.columns if c not in ("icao", "zone", "type")]
    return (
        rows.groupBy("icao", "zone", "type", F.window("ts", tick).alias("_tick"))
        .agg(F.max_by(F.struct(*cols), "ts").alias("_row"))
        .select("icao", "zone", "type", "_row.*")
        .select(*rows.columns)
    )


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def alert_json(rows: DataFrame, with_icao: bool = True) -> Column:
    """Alert as JSON; an endless time to enter is null, and null fields stay visible."""
    fields = [
        F.col("callsign"), F.col("type"), F.col("payload"), F.col("zone"),
        _finite(F.col("eta")).alias("eta"),
    ]
    if with_icao:
        fields.insert(0, F.col("icao"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def to_kafka_rows(rows: DataFrame) -> DataFrame:
    """Rows for the Kafka sink: topic = level, key = aircraft, value = JSON without it."""
    return rows.select(
        F.col("type").alias("topic"),
        F.col("icao").alias("key"),
        alert_json(rows, with_icao=False).alias("value"),
    )


def to_text(rows: DataFrame) -> DataFrame:
    """Rows for the print sink."""
    return rows.select(F.col("type").alias("logger"), alert_json(rows).alias("value"))


def write_alerts(rows: DataFrame, method: str, server: str | None = None, path: str | None = None) -> None:
    """Send the alerts whose category uses ``method``; also usable inside foreachBatch.

    ``print`` appends them to text files in ``path``, or shows them on the driver's console by
    blocks. ``kafka`` sends each to the server its category names, or to ``server``, and needs
    Spark's Kafka package on the classpath.
    """
    chosen = rows.filter(F.col("alert_method") == method)
    if method == "print":
        lines = to_text(chosen).select(F.concat_ws(" ", "logger", "value").alias("value"))
        if path:
            lines.write.mode("append").text(path)
        else:
            for row in lines.toLocalIterator():
                print(row.value, flush=True)
    elif method == "kafka":
        for name, part in by_server(chosen, server).items():
            to_kafka_rows(part).write.format("kafka").option("kafka.bootstrap.servers", name).save()
    else:
        raise ValueError(f"unknown alert method {method!r}")


def by_server(rows: DataFrame, server: str | None = None) -> dict[str, DataFrame]:
    """Alerts by the server their category names; ``server`` takes those of categories that name none."""
    named = F.coalesce(F.try_element_at("arguments", F.lit("server")), F.lit(server))
    servers = [r.server for r in rows.select(named.alias("server")).distinct().collect()]
    if None in servers:
        raise ValueError("the kafka method needs a server")
    return {s: rows.filter(named == s) for s in sorted(servers)}
