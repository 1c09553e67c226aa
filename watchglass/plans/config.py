"""Settings from a file and the environment: what the caller gives wins over the environment, that over the file."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, fields, replace
from typing import Any

from watchglass.plans.schema import PRIORITIES, SEVERITIES, Settings

PREFIX = "WATCHGLASS_"
PLACES = ("watchglass.toml", "watchglass.json")


def _value(name: str, given: Any) -> Any:
    """A setting's value from text or a parsed file; ValueError or TypeError if it can't be one."""
    if isinstance(given, str) and name in ("weights", "thresholds"):
        given = dict(part.split("=") for part in given.split(",") if part)
    if name in ("weights", "thresholds"):
        known = SEVERITIES if name == "weights" else PRIORITIES[1:]
        if unknown := set(given) - set(known):
            raise ValueError(f"{name}: {', '.join(sorted(unknown))} is none of {', '.join(known)}")
        return getattr(Settings(), name) | {k: float(v) if name == "thresholds" else int(v) for k, v in given.items()}
    if name == "redact":
        return tuple(x.strip() for x in given.split(",") if x.strip()) if isinstance(given, str) else tuple(given)
    if name in ("dedup", "drop_raw"):
        return given if isinstance(given, bool) else {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(given).lower()]
    if name == "scope":
        if given not in ("file", "global"):
            raise ValueError(f"scope: {given} is neither file nor global")
        return given
    return None if given in (None, "", "none") else int(given)


def load(path: str | None = None, environment: Mapping[str, str] | None = None, **given: Any) -> Settings:
    """Settings of a TOML or JSON file (``path``, or watchglass.toml or .json here if there is one), WATCHGLASS_... and ``given``.

    Unknown names and values that make no sense raise ValueError, so a misspelt setting is never passed over.
    """
    found: dict[str, Any] = {}
    place = path or next((p for p in PLACES if os.path.exists(p)), None)
    if place:
        with open(place, "rb") as f:
            found = json.load(f) if place.endswith(".json") else tomllib.load(f)
    env = os.environ if environment is None else environment
    names = [f.name for f in fields(Settings)]
    found |= {n: env[PREFIX + n.upper()] for n in names if PREFIX + n.upper() in env}
    found |= {k: v for k, v in given.items() if v is not None}
    if unknown := set(found) - set(names):
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    try:
        return replace(Settings(), **{n: _value(n, v) for n, v in found.items()})
    except (KeyError, TypeError) as e:
        raise ValueError(f"a setting has no such value: {e}") from e


def as_text(settings: Settings) -> str:
    """The settings as JSON, as ``load`` reads it."""
    return json.dumps(asdict(settings), indent=2)


def auto_tune(settings: Settings, size_bytes: int) -> Settings:
    """The settings as they are: how much is read and held at once is Spark's to decide, whatever the input's size."""
    return settings
