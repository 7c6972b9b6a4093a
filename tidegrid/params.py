"""Store parameters: an epoch's duration, the resolution within it, retention."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from fractions import Fraction

from tidegrid.errors import InvalidParams

#: Nanoseconds of each unit of a duration string.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_TERM = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration such as "1h", "1h30m", "-1.5s" or "0": a sign, then numbers with units and nothing between."""
    if not isinstance(text, str):
        raise InvalidParams(f"not a duration: {text!r}")
    body = text[1:] if text[:1] in ("+", "-") else text
    if body == "0":
        return 0
    total, at = 0, 0
    while at < len(body):
        term = _TERM.match(body, at)
        if not term:
            raise InvalidParams(f"not a duration: {text!r}")
        total += int(Fraction(term[1].rstrip(".") if not term[1].startswith(".") else f"0{term[1]}") * UNITS[term[2]])
        at = term.end()
    if not body or total >= 1 << 63:
        raise InvalidParams(f"not a duration: {text!r}")
    return -total if text[0] == "-" else total


@dataclass(frozen=True)
class Params:
    """All times in nanoseconds. The two limits on open epochs are checked and kept, but Spark caches as it sees fit."""

    duration: int
    resolution: int
    retention: int
    max_ro_epochs: int = 1
    max_rw_epochs: int = 1

    def __post_init__(self):
        numbers = (self.duration, self.resolution, self.retention, self.max_ro_epochs, self.max_rw_epochs)
        if any(not isinstance(x, int) or x <= 0 for x in numbers):
            raise InvalidParams(f"parameters must be positive whole numbers: {self}")
        if self.duration % self.resolution or self.retention % self.duration:
            raise InvalidParams(f"resolution must divide duration, and duration retention: {self}")

    @property
    def points(self) -> int:
        """Points of a series in an epoch."""
        return self.duration // self.resolution

    @classmethod
    def of(cls, duration: str, resolution: str, retention: str, max_ro_epochs: int = 1, max_rw_epochs: int = 1) -> Params:
        return cls(parse_duration(duration), parse_duration(resolution), parse_duration(retention), max_ro_epochs, max_rw_epochs)

    @classmethod
    def from_json(cls, text: str) -> Params:
        try:
            read = json.loads(text)
            return cls.of(read["duration"], read["resolution"], read["retention"], read["maxROEpochs"], read["maxRWEpochs"])
        except (ValueError, KeyError, TypeError) as e:
            raise e if isinstance(e, InvalidParams) else InvalidParams(f"not store parameters: {e}") from e

    def to_json(self) -> str:
        times = {k: f"{getattr(self, k)}ns" for k in ("duration", "resolution", "retention")}
        return json.dumps(times | {"maxROEpochs": self.max_ro_epochs, "maxRWEpochs": self.max_rw_epochs})
