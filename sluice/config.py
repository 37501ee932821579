"""Parameters of the telemetry operators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_UNIT = {"min": 1, "h": 60, "d": 1440}


def rows_of(window: str, step_minutes: int = 15) -> int:
    """How many readings a window such as "2H", "24h" or "7D" holds."""
    m = re.fullmatch(r"\s*(\d+)\s*(min|h|d)\s*", window.lower())
    if not m:
        raise ValueError(f"not a window: {window!r}")
    return int(m[1]) * _UNIT[m[2]] // step_minutes


@dataclass(frozen=True)
class FeatureConfig:
    """Row counts of the rolling features, thresholds, and the parameters whose correlations are wanted."""

    flatline_rows: int = rows_of("2H")
    correlation_rows: int = rows_of("24H")
    lag_rows: int = 96
    rate_rows: int = rows_of("7D")
    flatline_std: float = 0.01
    hugging_share: float = 0.05
    parameters: tuple[str, ...] = field(default=("ETP-BOD", "ETP-COD", "ETP-Flow", "ETP-TSS", "ETP-pH"))
    ratio: tuple[str, str] = ("ETP-BOD", "ETP-COD")
