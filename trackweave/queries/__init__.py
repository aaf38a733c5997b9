"""The registered queries by name, and DuckDB SQL for those that SQL can express."""

from .registry import ORACLES, QUERIES
from . import candidates, columns, game, geometry, readings, refine, relational, rims, texts, tracking  # noqa: F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
