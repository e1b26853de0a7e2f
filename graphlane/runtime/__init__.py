"""Configuration, result records, logging and a command line."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

SCHEMA_VERSION = "0.1"
TRUE, FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}  # fixed values


class Config:
    """Text values by key, in order of keys."""

    def __init__(self, values: Mapping[str, str] | None = None) -> None:
        self._values: dict[str, str] = {}
        for k, v in (values or {}).items():
            self.set(k, v)

    def set(self, key: str, value: str) -> None:
        if not key:
            raise ValueError("a key must not be empty")
        self._values[key] = str(value)

    def contains(self, key: str) -> bool:
        return key in self._values

    def get(self, key: str) -> str:
        if key not in self._values:
            raise IndexError(f"no such key: {key}")
        return self._values[key]

    def get_or(self, key: str, default: str) -> str:
        return self._values.get(key, default)

    def get_int(self, key: str) -> int:
        return int(self.get(key))

    def get_double(self, key: str) -> float:
        return float(self.get(key))

    def get_bool(self, key: str) -> bool:
        v = self.get(key).lower()
        if v not in TRUE | FALSE:
            raise ValueError(f"not a truth value: {key}")
        return v in TRUE

    def values(self) -> dict[str, str]:
        return dict(sorted(self._values.items()))


@dataclass
class Result:
    experiment_id: str
    algorithm: str
    status: str = "success"
    timestamp: str = field(default_factory=lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    config: dict[str, str] = field(default_factory=dict)
    measurements: dict[str, float] = field(default_factory=dict)
    schema_version: str = SCHEMA_VERSION

    def to_json(self) -> str:
        own = {k: getattr(self, k) for k in ("schema_version", "experiment_id", "timestamp", "algorithm", "status")}
        return json.dumps(own | {"config": dict(sorted(self.config.items())), "measurements": dict(sorted(self.measurements.items()))}, indent=2, ensure_ascii=False)

    def write(self, path: str) -> bool:
        try:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(self.to_json() + "\n")
        except OSError:
            return False
        return True


def check_result(record: Mapping) -> None:
    """Raises ValueError if a record isn't a result."""
    for key in ("schema_version", "experiment_id", "timestamp", "algorithm", "status", "config", "measurements"):
        if key not in record:
            raise ValueError(f"{key} is missing")
    if record["status"] not in ("success", "failed"):
        raise ValueError("status must be success or failed")
    if any(isinstance(x, bool) or not isinstance(x, int | float) for x in record["measurements"].values()):
        raise ValueError("measurements must be numbers")


log = logging.getLogger("graphlane")


def set_log_level(level: str) -> None:
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)sZ [%(levelname)s] %(message)s"))
        logging.Formatter.converter = __import__("time").gmtime
        log.addHandler(handler)
    log.setLevel(level.upper())


def scalars(text: str) -> dict[str, str]:
    """`key: value` lines of a simple YAML file, nested keys joined by dots."""
    out, stack = {}, []
    for line in text.splitlines():
        if not (m := re.match(r"( *)([\w.-]+):\s*(.*?)\s*(?:#.*)?$", line)):
            continue
        stack = [s for s in stack if s[0] < len(m[1])]
        if m[3]:
            out[".".join([*(s[1] for s in stack), m[2]])] = m[3].strip("\"'")
        else:
            stack.append((len(m[1]), m[2]))
    return out
