"""Queries over the tables at hand; importing this package registers them all."""

from scoreline.plans import boards, catalog, imports, streams, titles  # noqa: F401
from scoreline.plans.registry import ORACLE, QUERIES  # noqa: F401
