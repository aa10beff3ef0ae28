"""All queries of the library's own operators, with their DuckDB SQL."""

from __future__ import annotations

from . import q_agg, q_concepts, q_econ, q_pipelines, q_quality, q_recode, q_spatial  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
