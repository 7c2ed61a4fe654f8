"""Corpus pipeline: quality, exact dedup, near dedup, mixing, tokens (the stages are in ``docloom.llm.pipeline``)."""

from docloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
