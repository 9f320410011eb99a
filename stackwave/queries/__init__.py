"""Named queries over the business tables, each with SQL of its own for a second engine to check it by."""

from __future__ import annotations

from . import climate, networks, places, scenes, stacks
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "climate", "networks", "places", "scenes", "stacks"]
