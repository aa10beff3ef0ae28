"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
