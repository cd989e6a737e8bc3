"""Column names, schemas and default parameters shared by the package."""

from __future__ import annotations

from pyspark.sql import types as T

# Datum vocabulary (fixed values).
RECEIVED = ("latitude", "altitude", "longitude", "vertical_speed", "horizontal_speed", "direction")
CALCULATED = ("horizontal_speed", "direction")
RULE_DATUMS = (
    "latitude", "longitude", "altitude", "vertical_speed",
    "horizontal_speed", "direction", "distance", "eta",
)

# Where a rule finds each datum on a track-state row: position, altitude and climb
# come from what was received, speed and direction from what was calculated.
RULE_COLUMN = {
    "latitude": "latitude", "longitude": "longitude", "altitude": "altitude",
    "vertical_speed": "vertical_speed", "horizontal_speed": "speed",
    "direction": "heading", "distance": "distance_km", "eta": "eta",
}

# Registry file columns in file order (fixed values).
REGISTRY_COLUMNS = (
    "icao", "timestamp", "acars", "adsb", "built", "description", "country", "engines",
    "first_flight_date", "first_seen", "icao_aircraft_class", "line_number",
    "manufacturer_icao", "manufacturer_name", "model", "modes", "next_registration",
    "operator", "operator_callsign", "operator_data", "operator_iata", "owner",
    "previous_registration", "registered_until", "registered", "callsign",
    "selective_calling_number", "serial_number", "status", "typecode", "vhf",
)

# Emitter category labels by (type code, category) (fixed values).
CATEGORY_LABELS = {
    (2, 1): "Surface Emergency Vehicle",
    (2, 3): "Surface Service Vehicle",
    (2, 4): "Ground Obstruction (4)",
    (2, 5): "Ground Obstruction (5)",
    (2, 6): "Ground Obstruction (6)",
    (2, 7): "Ground Obstruction (7)",
    (3, 1): "Glider/Sailplane",
    (3, 2): "Lighter-than-air",
    (3, 3): "Parachutist/Skydiver",
    (3, 4): "Ultralight/Hang-glider/paraglider",
    (3, 6): "UAV (unmanned aerial vehicle)",
    (3, 7): "Space/transatmospheric vehicle",
    (4, 1): "Light (<7000kg)",
    (4, 2): "Medium 1 (7000 to 34000kg)",
    (4, 3): "Medium 2 (34000 to 136000kg)",
    (4, 4): "High vortex aircraft",
    (4, 5): "Heavy (>13600kg)",
    (4, 6): "High performance (>5g) and high speed (>740km/h)",
    (4, 7): "Rotorcraft (helicopter)",
}

# Default parameters (fixed values).
BACK_N = 10
REMEMBER_SECONDS = 30
MERGE_SECONDS = 5
TOP_PLANES = 5
TICKS_PER_SECOND = 2
MAX_TIME_SECONDS = 10_000
HOME = (36.6810752, -78.8758528)

# Width of a time slice (see operators/slices.py).
SLICE_SECONDS = 3600.0

FRAMES = T.StructType([
    T.StructField("receiver", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("hex", T.StringType()),
])

MESSAGES = T.StructType([
    T.StructField("icao", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type_cat", T.IntegerType()),
    T.StructField("callsign", T.StringType()),
    T.StructField("cat_tc", T.IntegerType()),
    T.StructField("cat_ca", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude", T.DoubleType()),
    T.StructField("horizontal_speed", T.DoubleType()),
    T.StructField("direction", T.DoubleType()),
    T.StructField("vertical_speed", T.DoubleType()),
])

REGISTRY = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_COLUMNS])

RING = T.ArrayType(T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
]))
