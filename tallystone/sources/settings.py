"""Limits that an environment may override: only a positive number does, anything else is ignored."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Limits:
    """The limits of indexing and retrieval."""

    ttl_minutes: float = 120
    max_indexed_chars: float = 200_000
    max_chunks: float = 400
    max_chunk_chars: float = 2_000
    top_k: float = 10
    excerpt_chars: float = 600
    context_chars: float = 6_000
    min_relevance: float = 0.12


def positive(raw: str | None, otherwise: float) -> float:
    try:
        value = float(raw) if raw is not None and raw.strip() else otherwise
    except ValueError:
        return otherwise
    return value if math.isfinite(value) and value > 0 else otherwise


def limits_from(env: Mapping[str, str] | None = None, prefix: str = "TALLYSTONE_") -> Limits:
    """The limits with what ``env`` (default: the process's) sets, such as TALLYSTONE_TOP_K."""
    env = os.environ if env is None else env
    base = Limits()
    return replace(base, **{f.name: positive(env.get(prefix + f.name.upper()), getattr(base, f.name)) for f in fields(Limits)})
