"""The registered queries and the SQL that states them."""

from quillon.plans import QUERIES as PLANS
from quillon.plans.oracles import ORACLES
from quillon.plans.stores import QUERIES as STORES
from quillon.streaming import QUERIES as STREAMS

QUERIES = PLANS | STORES | STREAMS

__all__ = ["ORACLES", "QUERIES"]
