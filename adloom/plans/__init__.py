"""All checked queries of the library."""

from adloom.plans import copy_queries, data_queries, eval_queries, evidence_queries, retrieval_queries  # noqa: F401
from adloom.plans.base import ORACLES, QUERIES  # noqa: F401
