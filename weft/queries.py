"""All queries of the engine but the training-data operators."""

from weft import queries_catalog, queries_checks, queries_kernels, queries_quantize
from weft.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_catalog", "queries_checks", "queries_kernels", "queries_quantize"]
