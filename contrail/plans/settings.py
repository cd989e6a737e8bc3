"""Settings of a run, from the ``general`` and ``home`` parts of a configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from contrail import schema
from contrail.operators.rules import RuleError


@dataclass(frozen=True)
class Settings:
    """What the plans and streams take as options, with their defaults."""

    home: tuple[float, float] = schema.HOME
    back_n: int = schema.BACK_N
    remember_seconds: float = schema.REMEMBER_SECONDS
    merge_seconds: float = schema.MERGE_SECONDS
    top_planes: int = schema.TOP_PLANES
    advanced: bool = True
    hz: float = schema.TICKS_PER_SECOND


# Names in a configuration (fixed values), the option each one is, its kind and the least allowed.
_GENERAL = {
    "backdate_packets": ("back_n", int, 2),
    "remember_planes": ("remember_seconds", float, 0),
    "duplicate_packet_merging": ("merge_seconds", float, 0),
    "status_message_top_planes": ("top_planes", int, -1),
    "hz": ("hz", float, 1e-6),
}


def _number(name: str, value: Any, kind: type, least: float, most: float = float("inf")) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not least <= value <= most or kind(value) != value:
        raise RuleError(f"{name} is {value!r}; it is a number of {least} or more" + (f", {most} at most" if most < float("inf") else ""))
    return kind(value)


def load_settings(config: Mapping[str, Any]) -> Settings:
    """Settings of ``config``; what it leaves out has its default, and parts that aren't settings are passed over."""
    general, found = config.get("general") or {}, {}
    for name, (option, kind, least) in _GENERAL.items():
        if name in general:
            found[option] = _number(name, general[name], kind, least)
    if "advanced_status" in general:
        if not isinstance(general["advanced_status"], bool):
            raise RuleError(f"advanced_status is {general['advanced_status']!r}; it is true or false")
        found["advanced"] = general["advanced_status"]
    if config.get("home"):
        home = config["home"]
        found["home"] = (
            _number("latitude", home.get("latitude"), float, -90, 90), _number("longitude", home.get("longitude"), float, -180, 180)
        )
    return Settings(**found)
