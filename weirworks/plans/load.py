"""Importing this module fills the registry."""

from weirworks.plans import (  # noqa: F401
    checks,
    core,
    history,
    observe,
    relational,
    sqlsteps,
    streams,
)
from weirworks.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
