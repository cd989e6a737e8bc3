"""Alert rules: zones, levels, components and categories from a configuration dict.

The configuration is checked and turned into Columns once on the driver. A requirement is a
boolean expression over component names; it is read with a small whitelist and handed to
Spark as an expression, never evaluated as code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail import schema
from contrail.functions import geo

_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*|[()])")
_OPERATORS = ("and", "or", "not")
_SAVE_METHOD = re.compile(
    r"\s*(?:(all|none)|(decimate)\(\s*(\d+)\s*\)|"
    r"(sdecimate)\(\s*(\d+)\s*,\s*(\d+(?:\.\d+)?)\s*\))\s*$"
)
ALERT_METHODS = ("print", "kafka")
_BOUNDS = {"minimum": ">=", "maximum": "<="}


class RuleError(ValueError):
    """The configuration cannot be used."""


@dataclass(frozen=True)
class SaveMethod:
    """Thinning of one series: all, none, every n-th, or x per y seconds."""

    kind: str
    count: int = 0
    seconds: float = 0.0


@dataclass(frozen=True)
class Zone:
    name: str
    ring: tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Level:
    zone: str
    name: str
    requirements: str
    seconds: float
    category: str | None
    alert_method: str
    arguments: Mapping[str, str] = field(default_factory=dict)
    telemetry: Mapping[str, SaveMethod] = field(default_factory=dict)
    calculated: Mapping[str, SaveMethod] = field(default_factory=dict)


@dataclass(frozen=True)
class Rules:
    zones: tuple[Zone, ...]
    levels: tuple[Level, ...]
    components: Mapping[str, Mapping[str, Mapping[str, float]]]

    @property
    def uses_distance(self) -> bool:
        return bool(self.distance_zones)

    @property
    def distance_zones(self) -> list[str]:
        """Zones with a level that asks for the distance to them."""
        found = (
            level.zone
            for level in self.levels
            for name in component_names(level.requirements)
            if "distance" in self.components[name]
        )
        return list(dict.fromkeys(found))

    def with_levels(self) -> Rules:
        """The rules without zones that have no level."""
        wanted = {level.zone for level in self.levels}
        return replace(self, zones=tuple(z for z in self.zones if z.name in wanted))


def tokens(requirements: str) -> list[str]:
    """Names, and/or/not and parentheses of a requirement; anything else is refused."""
    found, at = [], 0
    text = requirements.strip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise RuleError(f"unexpected text in requirement {requirements!r} at {at}")
        found.append(match.group(1))
        at = match.end()
    if not found:
        raise RuleError("empty requirement")
    return found


def _check_grammar(requirements: str) -> None:
    """A requirement is names joined by and/or, each behind any number of nots, or in parentheses."""
    words, wants, depth = tokens(requirements), True, 0  # wants: a name must still come
    for word in words:
        opens, closes, joins = word in ("(", "not"), word == ")", word in ("and", "or")
        if wants == (closes or joins) or (closes and not depth):
            raise RuleError(f"{word!r} is out of place in requirement {requirements!r}")
        depth += (word == "(") - closes
        wants = opens or joins
    if wants or depth:
        raise RuleError(f"requirement {requirements!r} is not complete")


def component_names(requirements: str) -> list[str]:
    names = [t for t in tokens(requirements) if t not in _OPERATORS and t not in "()"]
    return list(dict.fromkeys(names))


def component_sql(component: Mapping[str, Mapping[str, float]]) -> str:
    """All bounds of all datums hold; a missing datum fails."""
    tests = []
    for datum, bounds in component.items():
        column = schema.RULE_COLUMN[datum]
        tests.append(f"`{column}` IS NOT NULL")
        tests += [f"`{column}` {_BOUNDS[b]} {float(v)!r}D" for b, v in bounds.items()]
    return "coalesce(" + (" AND ".join(tests) or "true") + ", false)"


def requirement(requirements: str, components: Mapping[str, Mapping]) -> Column:
    """Requirement as a boolean Column over track-state columns."""
    words = [
        t if t in _OPERATORS or t in "()" else component_sql(components[t])
        for t in tokens(requirements)
    ]
    return F.expr(" ".join(words))


def save_method(text: str) -> SaveMethod:
    match = _SAVE_METHOD.match(text)
    if not match:
        raise RuleError(f"unknown save method {text!r}")
    plain, every, n, some, x, y = match.groups()
    if plain:
        return SaveMethod(plain)
    if every:
        method = SaveMethod("decimate", count=int(n))
    else:
        method = SaveMethod("sdecimate", count=int(x), seconds=float(y))
    if method.count < 1 or (some and method.seconds <= 0):
        raise RuleError(f"save method {text!r} needs positive numbers")
    return method


def _save_rules(save: Mapping, part: str, owner: str) -> dict[str, SaveMethod]:
    rules = save.get(part)
    if not isinstance(rules, Mapping) or "default" not in rules:
        raise RuleError(f"{owner}: save/{part} needs a default")
    allowed = schema.RECEIVED if part == "telemetry" else schema.CALCULATED
    unknown = set(rules) - {"default", *allowed}
    if unknown:
        raise RuleError(f"{owner}: unknown datum in save/{part}: {sorted(unknown)}")
    return {datum: save_method(text) for datum, text in rules.items()}


def _number(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise RuleError(f"{what} must be a number, not {value!r}")
    return float(value)


def load_rules(config: Mapping) -> Rules:
    """Check a configuration and resolve every level to its category."""
    for part in ("components", "zones", "categories"):
        if not isinstance(config.get(part), Mapping):
            raise RuleError(f"configuration has no {part}")
    components: dict[str, dict[str, dict[str, float]]] = {}
    for name, datums in config["components"].items():
        components[name] = {}
        for datum, bounds in datums.items():
            if datum not in schema.RULE_DATUMS:
                raise RuleError(f"component {name}: unknown datum {datum}")
            if set(bounds) - set(_BOUNDS):
                raise RuleError(f"component {name}: unknown bound in {sorted(bounds)}")
            components[name][datum] = {b: _number(v, f"component {name}") for b, v in bounds.items()}

    zones, levels = [], []
    for zone_name, zone in config["zones"].items():
        ring = tuple((_number(a, zone_name), _number(b, zone_name)) for a, b in zone["coordinates"])
        if len(ring) < 3:
            raise RuleError(f"zone {zone_name}: a ring needs three points")
        zones.append(Zone(zone_name, ring))
        for level_name, level in zone.get("levels", {}).items():
            owner = f"level {zone_name}/{level_name}"
            missing = {"category", "requirements", "seconds"} - set(level)
            if missing:
                raise RuleError(f"{owner}: missing {sorted(missing)}")
            _check_grammar(level["requirements"])
            unknown = set(component_names(level["requirements"])) - set(components)
            if unknown:
                raise RuleError(f"{owner}: unknown component {sorted(unknown)}")
            seconds = level["seconds"]
            if isinstance(seconds, bool) or not isinstance(seconds, int) or seconds < 1:
                raise RuleError(f"{owner}: seconds must be a positive whole number")
            category = level["category"]
            body = category if isinstance(category, Mapping) else config["categories"].get(category)
            if body is None:
                raise RuleError(f"{owner}: unknown category {category!r}")
            method = body.get("alert_method")
            if method not in ALERT_METHODS:
                raise RuleError(f"{owner}: unknown alert method {method!r}")
            save = body.get("save", {})
            levels.append(
                Level(
                    zone=zone_name,
                    name=level_name,
                    requirements=level["requirements"],
                    seconds=float(seconds),
                    category=category if isinstance(category, str) else None,
                    alert_method=method,
                    arguments=dict(body.get("arguments") or {}),
                    telemetry=_save_rules(save, "telemetry", owner),
                    calculated=_save_rules(save, "calculated", owner),
                )
            )
    return Rules(tuple(zones), tuple(levels), components)


def _text(method: SaveMethod) -> str:
    if method.kind == "decimate":
        return f"decimate({method.count})"
    if method.kind == "sdecimate":
        return f"sdecimate({method.count},{method.seconds:g})"
    return method.kind


def rule_tables(spark: SparkSession, config: Mapping) -> dict[str, DataFrame]:
    """The rules as tables: zones, levels (with their category folded in) and components."""
    rules = load_rules(config)
    texts = T.MapType(T.StringType(), T.StringType())
    level_type = T.StructType([
        T.StructField("zone", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("requirements", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("alert_method", T.StringType()),
        T.StructField("arguments", texts),
        T.StructField("telemetry", texts),
        T.StructField("calculated", texts),
    ])
    return {
        "zones": spark.createDataFrame(
            [(z.name, [tuple(p) for p in z.ring]) for z in rules.zones],
            T.StructType([T.StructField("zone", T.StringType()), T.StructField("ring", schema.RING)]),
        ),
        "levels": spark.createDataFrame(
            [
                (
                    v.zone, v.name, v.category, v.requirements, v.seconds, v.alert_method,
                    {k: str(a) for k, a in v.arguments.items()},
                    {k: _text(m) for k, m in v.telemetry.items()},
                    {k: _text(m) for k, m in v.calculated.items()},
                )
                for v in rules.levels
            ],
            level_type,
        ),
        "components": spark.createDataFrame(
            [
                (name, datum, bounds.get("minimum"), bounds.get("maximum"))
                for name, datums in rules.components.items()
                for datum, bounds in datums.items()
            ],
            "component string, datum string, minimum double, maximum double",
        ),
    }


def component_columns(rules: Rules, prefix: str = "") -> dict[str, Column]:
    """One boolean Column per component."""
    return {f"{prefix}{n}": F.expr(component_sql(c)) for n, c in rules.components.items()}


def zone_edges(z: Zone) -> list[dict[str, float]]:
    """Edges of the zone's ring without those of zero length."""
    ends = zip(z.ring, z.ring[1:] + z.ring[:1], strict=True)
    # A ring that is a single point keeps one edge, to measure distances from.
    return [geo.edge(*a, *b) for a, b in ends if a != b] or [geo.edge(*z.ring[0], *z.ring[0])]


def zone_literal(zones: tuple[Zone, ...]) -> Column:
    """Zones as one constant array: name, bounding box and edges without zero length."""
    rows = []
    for z in zones:
        lats, lons = zip(*z.ring, strict=True)
        rows.append({
            "zone": z.name,
            "south": min(lats), "north": max(lats), "west": min(lons), "east": max(lons),
            "edges": zone_edges(z),
        })
    kind = (
        "array<struct<zone:string,south:double,north:double,west:double,east:double,"
        f"edges:array<{geo.EDGE}>>>"
    )
    return F.from_json(F.lit(json.dumps(rows)), kind)


def level_hits(states: DataFrame, rules: Rules) -> DataFrame:
    """Rows of ``zone_eta`` times the levels of their own zone whose requirement holds."""
    label = T.StructType([
        T.StructField("level", T.StringType()),
        T.StructField("alert_method", T.StringType()),
        T.StructField("arguments", T.MapType(T.StringType(), T.StringType())),
    ])
    hits = F.lit(None).cast(T.ArrayType(label))
    for zone in dict.fromkeys(v.zone for v in rules.levels):
        tests = [
            F.when(
                requirement(v.requirements, rules.components),
                F.from_json(
                    F.lit(json.dumps({
                        "level": v.name, "alert_method": v.alert_method,
                        "arguments": {k: str(x) for k, x in v.arguments.items()},
                    })), label,
                ),
            )
            for v in rules.levels
            if v.zone == zone
        ]
        hits = F.when(F.col("zone") == zone, F.array_compact(F.array(*tests))).otherwise(hits)
    return states.select("*", F.inline(hits))
