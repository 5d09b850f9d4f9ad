"""Whole runs from a plain description."""

from lustra.plans.run import QualityRun, RunResult
from lustra.plans.spec import normalize_spec

__all__ = ["QualityRun", "RunResult", "normalize_spec"]
