"""All queries of the clip engine by name, with the SQL that states each for another engine."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import fitting, frames, jobs, lint, pixels, planner, probing, stacks, store, streams  # noqa: F401, E402, I001  (registering)

__all__ = ["ORACLES", "QUERIES"]
