"""All registered queries."""

from tidemark.plans import catalog, hierarchy, objects, restore, schedule, streams, values  # noqa: F401
from tidemark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
