"""All queries of this folder and their SQL."""

import corpus_pipeline
from facetry.llm import free_queries, native_queries  # noqa: F401
from facetry.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
