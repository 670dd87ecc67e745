"""Imports every module of queries, so that they are registered."""

from tessera.plans import boxes, clips, control, decisions, frames, pixels, scalars, streams  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
