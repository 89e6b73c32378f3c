"""Where tables are, from the environment or from defaults under one root."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _place(variable: str, default: str):
    return field(default_factory=lambda: os.environ.get(variable, default))


@dataclass(frozen=True)
class Config:
    daily: str = _place("ISOTHERM_DAILY", "data/tmax_daily")
    monthly: str = _place("ISOTHERM_MONTHLY", "data/era5_monthly")
    units: str = _place("ISOTHERM_UNITS", "data/admin2")
    built: str = _place("ISOTHERM_BUILT", "data/built_surface")
    growth: str = _place("ISOTHERM_GROWTH", "data/gdp_growth")
    output: str = _place("ISOTHERM_OUTPUT", "data/output")

    def table(self, name: str) -> str:
        """Place of a derived table; one name for its writer and its readers."""
        return f"{self.output}/{name}"
