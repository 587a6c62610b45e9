"""Settings of a log: limits given as text, where 0 means none and anything but a whole number is an error."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from driftlog.functions import schemas as S


def limit(name: str, text: str) -> int:
    try:
        n = int(text.strip())
    except ValueError:
        raise ValueError(f"{name}: {text!r} is no whole number") from None
    if n < 0:
        raise ValueError(f"{name}: {n} is negative")
    return n


def describe(n: int) -> str:
    return "unlimited" if n == 0 else str(n)


@dataclass(frozen=True)
class LogConfig:
    segment_bytes: int = S.SEGMENT_BYTES
    index_every: int = S.INDEX_EVERY
    flush_every: int = S.FLUSH_EVERY
    retention_ms: int = S.RETENTION_MS
    retention_bytes: int = 0
    max_partitions: int = 0

    @classmethod
    def from_text(cls, values: Mapping[str, str]) -> LogConfig:
        """Fields by name; others keep their defaults, unknown names and empty texts are errors."""
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: limit(k, v) for k, v in values.items()})
