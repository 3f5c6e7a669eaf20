"""The corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, packing. The
stages are those of the subpackage ``voxelyard.llm``."""

from voxelyard.llm.stages import COLUMNS, STAGES, run

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
