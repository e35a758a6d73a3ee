"""Run settings: nested mappings, dot-path overrides, strict keys."""

from __future__ import annotations

import dataclasses
import json
from typing import Any


def cast(text: str) -> Any:
    """null, booleans, numbers and JSON lists by their look; other text stays text."""
    low = text.strip().lower()
    if low in ("null", "none", ""):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text.startswith("["):
        return json.loads(text)
    return text


def overridden(config: dict, overrides: list[str]) -> dict:
    """A copy with each `a.b=value` set; a path that does not exist is an error."""
    out = json.loads(json.dumps(config))
    for item in overrides:
        path, eq, value = item.partition("=")
        *parents, last = path.split(".")
        at = out
        for key in parents:
            if not isinstance(at, dict) or key not in at:
                raise KeyError(f"no setting {path!r}")
            at = at[key]
        if not eq or not isinstance(at, dict) or last not in at:
            raise KeyError(f"no setting {path!r}")
        at[last] = cast(value)
    return out


def nested(config: dict, path: str, default: Any = None) -> Any:
    at: Any = config
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            return default
        at = at[key]
    return at


def build(kind: type, values: dict) -> Any:
    """A settings dataclass from a mapping; unknown keys are an error, lists become tuples."""
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - known:
        raise KeyError(f"unknown settings {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
