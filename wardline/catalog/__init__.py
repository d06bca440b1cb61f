"""All registered queries. Importing the modules registers them."""

from wardline.catalog import authority, leakage, reading, scalar, timeline, trail  # noqa: F401
from wardline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
