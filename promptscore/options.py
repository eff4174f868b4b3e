"""Limits and retry settings, passed explicitly to every operator that needs them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Milliseconds per unit in duration texts such as "250ms" or "1m30s".
_UNIT_MS = {"h": 3_600_000.0, "m": 60_000.0, "s": 1_000.0, "ms": 1.0, "us": 0.001, "µs": 0.001, "ns": 0.000001}

# Section and key of each setting in a settings file.
_SETTINGS = {
    "pool_size": ("worker", "pool_size"),
    "claim_size": ("worker", "claim_batch_size"),
    "poll_interval_ms": ("worker", "poll_interval"),
    "max_attempts": ("retry", "max_attempts"),
    "base_backoff_ms": ("retry", "base_backoff"),
    "max_backoff_ms": ("retry", "max_backoff"),
    "max_batch_size": ("validation", "max_batch_size"),
    "max_prompt_bytes": ("validation", "max_prompt_len"),
    "request_timeout_ms": ("inference", "request_timeout"),
    "rate_per_sec": ("mock", "rate_per_sec"),
    "burst": ("mock", "burst"),
}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration text: one or more number-unit pairs, optionally signed."""
    body = text.lstrip("+-")
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(h|ms|us|µs|ns|m|s)", body)
    if body == "0":
        return 0
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    total = int(sum(float(n) * _UNIT_MS[u] for n, u in parts))
    return -total if text.startswith("-") else total


@dataclass(frozen=True)
class Options:
    pool_size: int = 8
    claim_size: int = 8
    poll_interval_ms: int = 500
    max_attempts: int = 5
    base_backoff_ms: int = 250
    max_backoff_ms: int = 30_000
    max_batch_size: int = 10_000
    max_prompt_bytes: int = 8_192
    request_timeout_ms: int = 10_000
    rate_per_sec: float = 20.0
    burst: int = 10
    body_limit: int | None = None

    def __post_init__(self) -> None:
        for name in ("pool_size", "claim_size", "max_attempts", "max_batch_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be >= 1, got {getattr(self, name)}")
        if self.rate_per_sec <= 0:
            raise ValueError(f"rate_per_sec must be > 0, got {self.rate_per_sec}")

    @property
    def max_body_bytes(self) -> int:
        """Largest accepted request body: every prompt at its limit plus 1 MiB of JSON framing."""
        if self.body_limit is not None:
            return self.body_limit
        return self.max_prompt_bytes * self.max_batch_size + (1 << 20)

    @classmethod
    def from_sections(cls, sections: Mapping[str, Mapping[str, object]]) -> Options:
        """Read nested settings, as parsed from a settings file; absent keys keep their defaults."""
        kinds = {f.name: f.type for f in fields(cls)}
        given = {}
        for name, (section, key) in _SETTINGS.items():
            value = (sections.get(section) or {}).get(key)
            if value is None:
                continue
            if name.endswith("_ms") and isinstance(value, str):
                value = duration_ms(value)
            given[name] = float(value) if kinds[name] == "float" else int(value)
        return cls(**given)
