"""All registered queries (importing the case modules fills the registry)."""

from spreadlake.plans import learning_cases, market_cases, research_cases, strategy_cases  # noqa: F401
from spreadlake.plans.registry import ORACLES, QUERIES  # noqa: F401
