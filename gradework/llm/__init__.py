"""Training-data operators.  Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

#: Modules that hold an operator; each has QUERIES and, where SQL can express the result, ORACLES.
_MODULES = (
    "token_output",
    "winnowing",
    "decontamination",
    "crf_quality",
    "lm_interpolation",
    "jaccard_join",
    "secret_scan",
    "line_dedup",
    "packing",
    "language_id",
    "token_alignment",
    "quality_rules",
    "spelling_groups",
)


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        out.update(getattr(module, attribute, {}))
    return out


def queries() -> dict:
    """Name -> callable(spark, sf_dir) for the numbered operators."""
    return _collect("QUERIES")


def oracle_sql() -> dict:
    """Name -> DuckDB SQL for those results that SQL can express."""
    return _collect("ORACLES")
