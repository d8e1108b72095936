"""Spans as digests: kind:start:end in code points, end exclusive, comma-joined."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
