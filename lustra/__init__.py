"""Data cleaning, validation and feature preparation on Spark DataFrames."""

from lustra.plans import QualityRun, RunResult
from lustra.session import build_session
from lustra.sources import read_table, write_table

__all__ = ["QualityRun", "RunResult", "build_session", "read_table", "write_table"]
