"""The settings of a run: every one has a default and a rule, and unknown names, types and values raise."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, NamedTuple

from sightline.schema import SLICES


class Setting(NamedTuple):
    default: Any
    fits: Callable[[Any], bool]
    says: str


def _listed(*options: str) -> tuple[Callable[[Any], bool], str]:
    return lambda v: all(x in options for x in v) and len(set(v)) == len(v), f"names out of {', '.join(options)}, each once"


def _least(low: float) -> tuple[Callable[[Any], bool], str]:
    return lambda v: v >= low, f"at least {low:g}"


SETTINGS = {
    "evaluation.confidence": Setting(0.25, lambda v: 0 <= v <= 1, "between 0 and 1"),
    "mining.max_errors": Setting(6_000, *_least(1)),
    "mining.tp_sample": Setting(3_000, *_least(1)),
    "mining.seed": Setting(0, *_least(0)),
    "gate.targets": Setting(["night"], *_listed(*(s for s in SLICES if s != "overall"))),
    "gate.replicates": Setting(1_000, *_least(1)),
    "gate.seed": Setting(0, *_least(0)),
    "gate.level": Setting(0.95, lambda v: 0 < v < 1, "between 0 and 1, both excluded"),
}


def settings(given: dict[str, Any] | None = None) -> dict[str, Any]:
    """All settings by their dotted names, with those given in place of the defaults. A whole number may stand for a fraction; nothing else changes its type."""
    out = {name: s.default for name, s in SETTINGS.items()}
    for name, value in (given or {}).items():
        if name not in SETTINGS:
            raise ValueError(f"there is no setting {name}")
        kind = type(SETTINGS[name].default)
        if kind is float and type(value) is int:
            value = float(value)
        if type(value) is not kind or (kind is list and not all(isinstance(v, str) for v in value)):
            raise ValueError(f"{name} is a {kind.__name__}, not {value!r}")
        if not SETTINGS[name].fits(value):
            raise ValueError(f"{name} must be {SETTINGS[name].says}, not {value!r}")
        out[name] = value
    return out


def parsed(pairs: list[str]) -> dict[str, Any]:
    """Settings from texts like gate.replicates=200 or gate.targets=["night"]; values are JSON."""
    out = {}
    for pair in pairs:
        name, found, value = pair.partition("=")
        if not found:
            raise ValueError(f"{pair} is not name=value")
        try:
            out[name] = json.loads(value)
        except json.JSONDecodeError as e:
            raise ValueError(f"the value of {name} is not JSON: {value}") from e
    return out
