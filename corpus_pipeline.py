"""Cleans a corpus and packs it: quality rules, near-duplicates, benchmark passages, personal data, packing.

The stages are in ``textscan.llm.stages``.
"""

from textscan.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
