"""Registry of the engine's own queries and their DuckDB oracles."""

from __future__ import annotations

from . import calibration, evaluation, gating, imaging, modelling, vision

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (calibration, evaluation, gating, imaging, modelling, vision):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
