"""Parameter objects and fixed values of the observation engine."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from typing import Any

#: Fixed values the results depend on.
DEFAULT_WINDOW_MS = 1000
VALID_COUNT = 3
MISSING_KEY = "(none)"
LAYERS = ("pipeline", "observe", "schema")
DOMAINS = (  # name, first bit, last bit, target
    ("auth", 0, 31, 32),
    ("payment", 32, 63, 32),
    ("ui", 64, 127, 48),
    ("utils", 128, 255, 32),
)

_STEP = re.compile(r"^\s*step\(\s*cutoff\s*=\s*(?:now\s*-\s*)?(\d+(?:\.\d+)?)\s*(ms|s)\s*\)\s*$")
_EXP = re.compile(r"^\s*exp\(\s*(?:tau|τ)\s*=\s*(\d+(?:\.\d+)?)\s*(ms|s)\s*\)\s*$")


@dataclass(frozen=True)
class Decay:
    kind: str  # "step" or "exp"
    ms: float


def parse_decay(text: str) -> Decay:
    """``step(cutoff=[now-]D)`` or ``exp(tau=D)``; D is a number with ``ms`` or ``s``."""
    for kind, pattern in (("step", _STEP), ("exp", _EXP)):
        if m := pattern.match(text):
            ms = float(m[1]) * (1000 if m[2] == "s" else 1)
            if kind == "exp" and ms <= 0:
                break
            return Decay(kind, ms)
    raise ValueError(f"decay: cannot read {text!r}")


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def validate_observe(params: dict[str, Any]) -> None:
    """The one rulebook of lens parameters, used on writing and on applying. Unknown fields pass."""
    get = params.get
    if get("window_ms") is not None and not (_number(get("window_ms")) and get("window_ms") > 0):
        raise ValueError("window_ms must be a finite number above 0")
    if get("origin") is not None and not _number(get("origin")):
        raise ValueError("origin must be finite")
    if get("align") not in (None, "epoch", "first_event"):
        raise ValueError("align must be epoch or first_event")
    if get("decay_anchor") not in (None, "segment_end", "now"):
        raise ValueError("decay_anchor must be segment_end or now")
    factor = get("downsample_factor")
    if factor is not None and not (_number(factor) and factor == int(factor) and factor >= 1):
        raise ValueError("downsample_factor must be a whole number of 1 or more")
    by = get("group_by")
    if by is not None and not (isinstance(by, (list, tuple)) and all(isinstance(k, str) for k in by)):
        raise ValueError("group_by must be a list of strings")
    if get("decay") is not None:
        if not isinstance(get("decay"), str):
            raise ValueError("decay must be text")
        parse_decay(get("decay"))
    if get("agg_func") not in (None, "mean"):
        raise ValueError("agg_func: only mean can be pooled")


@dataclass(frozen=True)
class Lens:
    """How to look at a segment: grid, grouping, downsampling and recency."""

    window_ms: int = DEFAULT_WINDOW_MS
    origin: int | None = None
    align: str | None = None
    downsample_factor: int = 1
    group_by: tuple[str, ...] = ()
    decay: str | None = None
    decay_anchor: str = "segment_end"

    @classmethod
    def of(cls, params: dict[str, Any]) -> Lens:
        validate_observe(params)
        known = {f.name for f in fields(cls)}
        kept = {k: v for k, v in params.items() if k in known and v is not None}
        if "group_by" in kept:
            kept["group_by"] = tuple(kept["group_by"])
        return cls(**kept)

    @property
    def grid(self) -> str:
        """The alignment in force: explicit, else epoch if an origin is set, else the first event."""
        return self.align or ("epoch" if self.origin is not None else "first_event")

    @property
    def output_ms(self) -> int:
        return self.window_ms * self.downsample_factor


def effective_window_ms(row: dict[str, Any] | None, fallback_ms: int) -> int:
    """Width of the windows a row's lens puts out; the fallback, for rows without a width, is one already and is not scaled."""
    return fallback_ms if not row or row.get("window_ms") is None else Lens.of(row).output_ms


@dataclass(frozen=True)
class Curation:
    """Thresholds of the comparison."""

    spike_z: float = 2.0
    step_threshold: float = 0.3
    step_windows: int = 3
    min_gap_ms: int = 0
    max_tiles: int = 12
    include_baseline: bool = True
    divergence_z: float = 1.5
    strict_reference: bool = False


@dataclass(frozen=True)
class Rules:
    """Constants of the rule layer."""

    alpha: float = 0.05
    delta: float = 0.10
    warmup: int = 10
    least_events: int = 3
    floor: float = 0.0
    regression_ticks: int = 2
    gap_above: int = 4
    gap_ticks: int = 5
    dip_floor: float = 0.40
    dip_ticks: int = 2
    dip_most: int = 7
    fine_ms: int = 1000
    pad_ms: int = 5000
