"""All queries of the engine, by name."""

from heddle.plans import agents, answers, etl, press, streams, suites  # noqa: F401  (they register their queries)
from heddle.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
