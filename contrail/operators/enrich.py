"""Registry, callsign and category lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail import schema


def heavy_keys(df: DataFrame, on: str, rows_per_task: int, most: int = 1000) -> dict:
    """Keys with more rows than ``rows_per_task``, the heaviest ``most`` of them, and their number of rows.

    One pass that reads the key alone and counts map-side; the result is as small as the limit says.
    """
    counts = df.filter(F.col(on).isNotNull()).groupBy(on).count().filter(F.col("count") > rows_per_task)
    return {r[on]: r["count"] for r in counts.orderBy(F.desc("count"), on).limit(most).collect()}


def lookup(df: DataFrame, table: DataFrame, on: str, rows_per_task: int = 1_000_000, spread: int = 16) -> DataFrame:
    """Left join to a table with unique ``on``.

    One aircraft may own a large share of the rows. The keys that do are measured first: their rows
    are spread over as many buckets as they are worth, and their row of the table is repeated once
    per bucket; every other row of the table is sent once. A stream can't be measured, so all its
    rows are spread over ``spread`` buckets. Spark still broadcasts a table it knows to be below its
    threshold.
    """
    if df.isStreaming:
        heavy, buckets = None, spread
    else:
        heavy = heavy_keys(df, on, rows_per_task)
        if not heavy:
            return df.join(table, on, "left")
        buckets = min(1000, -(-max(heavy.values()) // rows_per_task))
    spreads = F.lit(True) if heavy is None else F.coalesce(F.col(on).isin(list(heavy)), F.lit(False))
    number = F.pmod(F.xxhash64(*df.columns), F.lit(buckets)).cast("int")
    salted = df.withColumn("_bucket", F.when(spreads, number).otherwise(0))
    last = F.when(spreads, buckets - 1).otherwise(0)
    copies = table.withColumn("_bucket", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copies, [on, "_bucket"], "left").drop("_bucket")


def first_match(registry: DataFrame, key: str = "icao", order: str = "line_no") -> DataFrame:
    """The first row of each aircraft, by file order."""
    cols = [c for c in registry.columns if c not in (key, order)]
    return (
        registry.groupBy(F.lower(key).alias(key))
        .agg(F.min_by(F.struct(*cols), order).alias("_row"))
        .select(key, "_row.*")
    )


def with_registry(
    df: DataFrame, registry: DataFrame, icao: str = "icao", order: str = "line_no",
    prefix: str = "reg_",
) -> DataFrame:
    """Add the registry columns of each aircraft, prefixed; NULL where it is not listed."""
    table = first_match(registry, order=order)
    table = table.select(
        F.col("icao").alias("_reg"),
        *[F.col(c).alias(prefix + c) for c in table.columns if c != "icao"],
    )
    return lookup(df.withColumn("_reg", F.lower(icao)), table, "_reg").drop("_reg")


def with_callsign(
    df: DataFrame, registrations: DataFrame, icao: str = "icao", callsign: str = "callsign"
) -> DataFrame:
    """Fill a missing callsign with the registration, else with an empty text.

    ``registrations`` has the columns icao and registration.
    """
    table = registrations.groupBy(F.upper("icao").alias("_reg")).agg(
        F.min("registration").alias("_registration")
    )
    found = lookup(df.withColumn("_reg", F.upper(icao)), table, "_reg")
    return found.withColumn(
        callsign, F.coalesce(callsign, "_registration", F.lit(""))
    ).drop("_reg", "_registration")


def with_category_label(
    df: DataFrame, tc: str = "cat_tc", ca: str = "cat_ca", name: str = "category_label"
) -> DataFrame:
    """Add the text of the emitter category."""
    entries = [
        F.lit(x) for (t, c), text in schema.CATEGORY_LABELS.items() for x in (f"{t}/{c}", text)
    ]
    key = F.concat_ws("/", F.col(tc).cast("string"), F.col(ca).cast("string"))
    return df.withColumn(name, F.try_element_at(F.create_map(*entries), key))


def known(df: DataFrame, archive: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys exist in the archive."""
    return df.join(archive.select(*keys).distinct(), list(keys), "left_semi")
