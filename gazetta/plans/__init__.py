"""Queries over the driver's tables, one per operator, with their SQL."""

from . import extras, frequency, geography, semantic  # noqa: I001
from . import reads  # over the others' queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extras", "frequency", "geography", "reads", "semantic"]
