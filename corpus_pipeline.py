"""The training-corpus pipeline: its stages, SQL and run() are in spanloom.llm.pipeline."""

from spanloom.llm.pipeline import NEAR, ORACLE_SQL, PASSAGE, STAGES, cut_repeated_passages, keep_good, keep_one_of_near_copies, pack_sequences, run

__all__ = ["NEAR", "ORACLE_SQL", "PASSAGE", "STAGES", "cut_repeated_passages", "keep_good", "keep_one_of_near_copies", "pack_sequences", "run"]
