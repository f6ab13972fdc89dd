"""The registered queries of the operators, each with SQL for the same rows where SQL can express it."""

from strandlake.plans import pattern_queries, sequence_queries, similarity_queries, source_queries, structure_queries  # noqa: F401
from strandlake.plans.registry import ORACLES, QUERIES  # noqa: F401
