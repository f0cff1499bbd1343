"""The corpus pipeline of cellscape.llm.pipeline: quality classifier, near-dedup, decontamination, secret scans, source mixing."""

from cellscape.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
